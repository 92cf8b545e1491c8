"""Finding listed addresses in lines, and filtering by a list of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Beyond this many literals a list is joined instead of written into the plan.
LITERAL_LIMIT = 1000
# Key tables up to this many rows and bytes of text are sent to every task.
SMALL_KEYS = 1_000_000
SMALL_BYTES = 64 << 20

_QUAD = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
_ANYWHERE = rf"(?=({_QUAD}))"
_WHOLE_TOKEN = rf"(?<![0-9.])({_QUAD})(?![0-9]|\.[0-9])"


def contained_quads(line: Column) -> Column:
    """Every dotted quad that is a substring of the line.

    The look-ahead finds the longest quad at each position (so also ``1.1.1.10``
    inside ``11.1.1.10``); cutting digits off its last octet gives the shorter
    ones that the line contains too.
    """
    longest = F.regexp_extract_all(line, F.lit(_ANYWHERE), F.lit(1))

    def with_cuts(quad: Column) -> Column:
        cut_one = F.regexp_extract(quad, r"^(.*\.[0-9]+)[0-9]$", 1)
        cut_two = F.regexp_extract(quad, r"^(.*\.[0-9]+)[0-9]{2}$", 1)
        return F.array(quad, cut_one, cut_two)

    return F.array_distinct(F.filter(F.flatten(F.transform(longest, with_cuts)), lambda q: q != ""))


def whole_quads(line: Column) -> Column:
    """Dotted quads that stand alone, not inside a longer run of digits and dots."""
    found = F.array_distinct(F.regexp_extract_all(line, F.lit(_WHOLE_TOKEN), F.lit(1)))
    return F.when(line.rlike(_QUAD), found)


def search_lines(
    lines: DataFrame, addresses: DataFrame, keys: list[str], ip: str = "ip", line: str = "line", whole: bool = False
) -> DataFrame:
    """``keys`` and address for each line that contains a listed address.

    ``keys`` identify a line.  Containment is plain (``1.1.1.1`` is found in
    ``11.1.1.10``) unless ``whole`` is set.  Candidates are read off each line, so
    the listed addresses are matched by an equality join that moves keys only,
    however long the line or many its addresses.
    """
    found = whole_quads(F.col(line)) if whole else contained_quads(F.col(line))
    candidates = lines.filter(F.col(line).rlike(_QUAD)).select(*keys, F.explode(found).alias(ip))
    return candidates.join(addresses.select(ip).distinct(), ip, "left_semi")


def with_lines(hits: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Hits with the text of their lines."""
    return hits.join(lines, keys)


def keep_listed(df: DataFrame, column: str, values: list | DataFrame, small: bool | None = None) -> DataFrame:
    """Rows whose column is in a short Python list or in a one-column DataFrame.

    ``small`` says whether the distinct values are sent to every task: True when
    they have a known bound (such as the hours of the retention time), False to
    leave the join to Spark, and by default after counting them.
    """
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias(column)).distinct()
        send = fits_in_tasks(keys) if small is None else small
        return df.join(F.broadcast(keys) if send else keys, column, "left_semi")
    if len(values) <= LITERAL_LIMIT:
        return df.filter(F.col(column).isin(list(values)))
    spark = df.sparkSession
    keys = spark.createDataFrame([(v,) for v in values], f"{column} {df.schema[column].dataType.simpleString()}")
    return keep_listed(df, column, keys)


def fits_in_tasks(keys: DataFrame, limit: int = SMALL_KEYS, size: int = SMALL_BYTES) -> bool:
    """Whether a key table has at most ``limit`` rows and ``size`` bytes of text.

    Both are added up where the rows are; only the two sums are gathered.
    """
    length = F.lit(0)
    for name, kind in keys.dtypes:
        if kind == "string":
            length = length + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
    found = keys.agg(F.count("*").alias("rows"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes")).first()
    return found["rows"] <= limit and found["bytes"] <= size
