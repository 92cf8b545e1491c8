"""Set algebra over IPv4 ranges.

All operators work per /16 bucket.  A bucket has 65,536 addresses, so after
duplicates are removed every group that is sorted in one task has a fixed upper
size, whatever the data volume or the popularity of one network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import ip as ipf

BUCKET_SIZE = 1 << ipf.BUCKET_BITS


def _bucket_start(bucket: Column | str) -> Column:
    c = F.col(bucket) if isinstance(bucket, str) else bucket
    return F.shiftleft(c.cast("bigint"), ipf.BUCKET_BITS)


def split_by_bucket(ranges: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Cut ranges at /16 borders: adds ``bucket`` and narrows ``lo`` and ``hi``."""
    valid = ranges.filter(F.col(lo).isNotNull() & (F.col(lo) <= F.col(hi)))
    first = _bucket_start("bucket")
    return (
        valid.withColumn("bucket", F.explode(F.sequence(ipf.bucket_of(lo), ipf.bucket_of(hi))))
        .withColumn(lo, F.greatest(F.col(lo), first))
        .withColumn(hi, F.least(F.col(hi), first + (BUCKET_SIZE - 1)))
    )


def expand(ranges: DataFrame, lo: str = "lo", hi: str = "hi", out: str = "address") -> DataFrame:
    """One row per address of each range, network and broadcast included.

    Wide ranges are first cut into /16 pieces and dealt out to all tasks, so the
    generated array per row stays within 65,536 entries.
    """
    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = split_by_bucket(ranges, lo, hi).repartition(tasks, "bucket", lo)
    return pieces.withColumn(out, F.explode(F.sequence(lo, hi))).drop(lo, hi, "bucket")


def cidr_blocks(ranges: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """One row per block of the smallest CIDR cover of each range."""
    block = F.explode(ipf.cidr_cover(lo, hi)).alias("block")
    others = [c for c in ranges.columns if c not in (lo, hi)]
    return ranges.select(*others, block).select(*others, "block.network", "block.prefix_len")


def merge_ranges(ranges: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Union of ranges as the fewest disjoint ranges; touching ones are joined."""
    pieces = split_by_bucket(ranges, lo, hi).groupBy("bucket", lo).agg(F.max(hi).alias(hi))
    in_bucket = Window.partitionBy("bucket").orderBy(lo)
    reached = F.max(hi).over(in_bucket.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        pieces.withColumn("_new", (reached.isNull() | (F.col(lo) > reached + 1)).cast("int"))
        .withColumn("_island", F.sum("_new").over(in_bucket))
        .groupBy("bucket", "_island")
        .agg(F.min(lo).alias(lo), F.max(hi).alias(hi))
    )
    first = _bucket_start("bucket")
    at_border = (F.col(lo) == first) | (F.col(hi) == first + (BUCKET_SIZE - 1))
    inner = islands.filter(~at_border).select(lo, hi)
    # At most two islands per bucket touch a border: 131,072 rows for all of IPv4,
    # so joining neighbours across borders in one sorted pass is bounded.
    across = Window.partitionBy(F.lit(0)).orderBy(lo)
    previous = F.lag(hi).over(across)
    border = (
        islands.filter(at_border)
        .select(lo, hi)
        .withColumn("_new", (previous.isNull() | (F.col(lo) > previous + 1)).cast("int"))
        .withColumn("_island", F.sum("_new").over(across))
        .groupBy("_island")
        .agg(F.min(lo).alias(lo), F.max(hi).alias(hi))
        .drop("_island")
    )
    return inner.unionByName(border)


def label_distinct(addresses: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """``(ip, in_set)`` for distinct addresses against ranges given as lo and hi.

    Ranges and addresses of a bucket are sorted together; an address is inside
    when the furthest end seen so far reaches it.
    """
    # The explode has numbers worked out once per distinct address: as a plain
    # column they would be pushed below the distinct.  Text that is no address
    # goes to buckets of its own, where there are no ranges.
    points = addresses.select(ip, F.explode(F.array(ipf.ip_to_long(ip))).alias("at")).selectExpr(
        ip,
        f"coalesce(int(shiftright(at, {ipf.BUCKET_BITS})), -1 - pmod(hash({ip}), {BUCKET_SIZE})) AS bucket",
        "at",
        "bigint(NULL) AS hi",
        "1 AS kind",
    )
    starts = split_by_bucket(ranges.select("lo", "hi")).groupBy("bucket", "lo").agg(F.max("hi").alias("hi"))
    known = points.unionByName(
        starts.selectExpr(f"string(NULL) AS {ip}", "bucket", "lo AS at", "hi", "0 AS kind")
    )
    order = Window.partitionBy("bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.max("hi").over(order)
    labelled = known.withColumn("in_set", F.coalesce(reached >= F.col("at"), F.lit(False)))
    return labelled.filter("kind = 1").select(ip, "in_set")


def membership(df: DataFrame, ranges: DataFrame, ip: str = "ip", unique: bool = False) -> DataFrame:
    """Every row of ``df`` with ``in_set``; ``unique`` says ``ip`` has no repeats.

    Distinct addresses are labelled and joined back by address.  A popular
    address makes a skewed join partition, which adaptive execution splits (the
    label side has one row per address).
    """
    if unique and df.columns == [ip]:
        return label_distinct(df, ranges, ip)
    labels = label_distinct(df.select(ip).distinct(), ranges, ip)
    return df.join(labels, ip, "left").fillna(False, ["in_set"])


def keep_members(df: DataFrame, ranges: DataFrame, ip: str = "ip", inside: bool = True, unique: bool = False) -> DataFrame:
    """Only the rows whose address is inside (or outside) the ranges."""
    labelled = membership(df, ranges, ip, unique)
    return labelled.filter(F.col("in_set") if inside else ~F.col("in_set")).drop("in_set")


def locate_distinct(addresses: DataFrame, networks: DataFrame, ip: str = "ip") -> DataFrame:
    """Attributes of the longest prefix holding each distinct address.

    ``networks`` has ``lo`` (network number), ``prefix_len`` and attribute
    columns.  Prefixes shorter than /16 cover whole buckets, so only the longest
    one per bucket matters.  For the 17 lengths from /16 to /32 the latest start
    of each length is carried along the sorted bucket; an address lies in a
    prefix of that length exactly when this start equals its own network number.
    """
    extra = [c for c in networks.columns if c not in ("lo", "hi", "prefix_len")]
    info = F.struct(*extra) if extra else F.lit(True)
    one_each = networks.groupBy("lo", "prefix_len").agg(F.min(info).alias("info"))
    long_ones = one_each.filter(F.col("prefix_len") >= ipf.BUCKET_BITS).withColumn("bucket", ipf.bucket_of("lo"))
    last_bucket = F.col("lo") + ipf.power_of_two(ipf.ADDRESS_BITS - F.col("prefix_len")) - 1
    short_ones = (
        one_each.filter(F.col("prefix_len") < ipf.BUCKET_BITS)
        .withColumn("bucket", F.explode(F.sequence(ipf.bucket_of("lo"), ipf.bucket_of(last_bucket))))
        .groupBy("bucket")
        .agg(F.max(F.struct("prefix_len", "lo", "info")).alias("best"))
        .select("best.lo", "best.prefix_len", "best.info", "bucket")
    )
    pieces = long_ones.unionByName(short_ones)

    # An explode instead of a filter on the number: a filter would be pushed into
    # the input and keep it from sharing exchanges with the caller's own rows.
    points = addresses.select(ip, F.explode(F.array_compact(F.array(ipf.ip_to_long(ip)))).alias("at"))
    stream = points.selectExpr(
        ip, f"int(shiftright(at, {ipf.BUCKET_BITS})) AS bucket", "at", "int(NULL) AS prefix_len", "1 AS kind"
    ).unionByName(
        pieces.selectExpr(
            f"string(NULL) AS {ip}",
            "bucket",
            f"greatest(lo, shiftleft(bigint(bucket), {ipf.BUCKET_BITS})) AS at",
            "prefix_len",
            "0 AS kind",
        )
    )
    so_far = "OVER (PARTITION BY bucket ORDER BY at, kind ROWS UNBOUNDED PRECEDING)"
    lengths = range(ipf.BUCKET_BITS, ipf.ADDRESS_BITS + 1)
    starts = [f"max(CASE WHEN prefix_len = {n} THEN at END) {so_far} AS s{n}" for n in lengths]
    short = f"max(CASE WHEN prefix_len < {ipf.BUCKET_BITS} THEN prefix_len END) {so_far} AS short"
    carried = stream.selectExpr("*", *starts, short).filter("kind = 1")
    hits = [f"CASE WHEN s{n} = at - at % {1 << (ipf.ADDRESS_BITS - n)} THEN {n} END" for n in lengths]
    keyed = carried.selectExpr(ip, "bucket", "at", f"greatest(short, {', '.join(hits)}) AS prefix_len").selectExpr(
        ip, "bucket", f"at - at % shiftleft(1L, {ipf.ADDRESS_BITS} - prefix_len) AS lo", "prefix_len"
    )
    # The bucket is part of the key, so no group passes 65,536 addresses even
    # when one short prefix holds most of them.
    joined = keyed.join(pieces, ["bucket", "lo", "prefix_len"], "left")
    return joined.select(ip, "prefix_len", *[f"info.{c}" for c in extra])


def enrich(
    df: DataFrame, networks: DataFrame, ip: str = "ip", addresses: DataFrame | None = None
) -> DataFrame:
    """Every row of ``df`` with the attributes of its network (NULL if unknown).

    Works on distinct addresses (given, or taken from ``df``) and joins back, as
    :func:`membership` does.
    """
    distinct = df.select(ip).distinct() if addresses is None else addresses
    located = locate_distinct(distinct, networks, ip).drop("prefix_len")
    return df.join(located, ip, "left")
