"""Log-shaped inputs derived from the benchmark tables.

A view is one select over base tables, written in expressions both engines
accept; ``{MS}`` and ``{HR}`` stand for the event time in epoch milliseconds and
for its hour.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SPARK_TIME = {
    "MS": "unix_micros(cast(ts AS timestamp)) div 1000",
    "HR": "(unix_micros(cast(ts AS timestamp)) div 3600000000) * 3600000",
}
CHECK_TIME = {"MS": "epoch_us(ts) // 1000", "HR": "(epoch_us(ts) // 3600000000) * 3600000"}

IP = (
    "concat('10.', cast(user_id % 3 AS string), '.', cast(user_id % 7 AS string), '.', "
    "cast(user_id % 200 AS string))"
)
HOST = "concat('h', cast(event_id % 20 AS string), '.example')"
LATER_HOST = "concat('h', cast((event_id + 3) % 20 AS string), '.example')"

# Ids, every so many of them one that no score has.
SOME_UNKNOWN = "CASE WHEN event_id % {} = 0 THEN -1 - event_id ELSE event_id END"

AGENT = """CASE event_id % 6
    WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/96.0.4664.45 Safari/537.36'
    WHEN 1 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/14.1 Safari/605.1.15'
    WHEN 2 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 14_6 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/14.0 Mobile/15E148 Safari/604.1'
    WHEN 3 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:94.0) Gecko/20100101 Firefox/94.0'
    WHEN 4 THEN 'Mozilla/5.0 (Linux; Android 11; Pixel 5) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/95.0.4638.74 Mobile Safari/537.36'
    ELSE 'curl/7.68.0' END"""

EVIDENCES = (
    "replace(concat('[{{\"heuristic_name\": \"heur', cast(event_id % 4 AS string), ';v1\", \"category\": \"cat', "
    "cast(event_id % 3 AS string), '\", \"hosts\": [\"h', cast(event_id % 20 AS string), '.example\"]}}]'), "
    "'\"', chr(39))"
)


@dataclass(frozen=True)
class View:
    base: str
    select: tuple[str, ...]
    where: str | None = None
    distinct: bool = False


VIEWS: dict[str, tuple[View, ...]] = {
    "requests": (
        View(
            "events",
            (
                "event_id",
                f"{IP} AS ip",
                "cast(event_id % 100 AS bigint) AS cpcode",
                f"{AGENT} AS user_agent",
                "cast(event_id % 50 + 1 AS bigint) AS total_counter",
                "{MS} AS ts",
            ),
        ),
    ),
    "accounts": (
        View(
            "customer JOIN nation ON c_nationkey = n_nationkey",
            ("c_custkey AS cpcode", "cast(c_nationkey AS bigint) AS account", "n_name AS account_name"),
        ),
    ),
    "industries": (
        View(
            "nation",
            (
                "cast(n_nationkey AS bigint) AS account_id",
                "CASE n_nationkey % 4 WHEN 0 THEN 'Software as a Service' WHEN 1 THEN 'Business Services' "
                "WHEN 2 THEN 'Retail' ELSE 'Media' END AS vertical",
                "CASE n_nationkey % 5 WHEN 0 THEN 'Advertising Technology' WHEN 1 THEN 'Logistics' "
                "WHEN 2 THEN 'Grocery' WHEN 3 THEN NULL ELSE '' END AS subvertical",
            ),
        ),
    ),
    "networks": (
        View(
            "region",
            (
                "cast(167772160 + r_regionkey * 65536 AS bigint) AS lo",
                "16 AS prefix_len",
                "concat('Company ', r_name) AS company",
                "r_name AS country",
                "concat(lower(r_name), '.example') AS domain",
                "CASE r_regionkey % 2 WHEN 0 THEN 'cable' ELSE 'mobile' END AS network_type",
                "cast(64500 + r_regionkey AS bigint) AS asnum",
            ),
        ),
    ),
    # Nested prefixes of four lengths; several suppliers share one prefix.
    "owners": (
        View("supplier", ("cast(167772160 AS bigint) AS lo", "8 AS prefix_len", "s_name AS owner"), "s_suppkey % 4 = 0"),
        View(
            "supplier",
            ("cast(167772160 + s_suppkey % 2 * 65536 AS bigint) AS lo", "16 AS prefix_len", "s_name AS owner"),
            "s_suppkey % 4 = 1",
        ),
        View(
            "supplier",
            (
                "cast(167772160 + s_suppkey % 3 * 65536 + s_suppkey % 5 * 256 AS bigint) AS lo",
                "24 AS prefix_len",
                "s_name AS owner",
            ),
            "s_suppkey % 4 = 2",
        ),
        View(
            "supplier",
            (
                "cast(167772160 + s_suppkey % 3 * 65536 + s_suppkey % 7 * 256 + s_suppkey % 13 * 16 AS bigint) AS lo",
                "28 AS prefix_len",
                "s_name AS owner",
            ),
            "s_suppkey % 4 = 3",
        ),
    ),
    "logins": (
        View(
            "events",
            (f"{IP} AS ip", f"{HOST} AS host", "md5(cast(event_id % 37 AS string)) AS email_hash", "{MS} AS ts"),
        ),
    ),
    "intel": (
        View(
            "events",
            (
                "{MS} AS ts",
                f"{IP} AS ip",
                "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'false' ELSE 'true' END "
                "AS heuristic_detected",
                "concat('[', cast(event_id % 25 AS string), ',', cast((event_id + 7) % 25 AS string), ']') AS accounts",
                f"concat('[', {HOST}, ']') AS hosts",
                f"{EVIDENCES} AS evidences",
            ),
        ),
    ),
    "scores": (
        View(
            "events",
            (
                "event_id AS id",
                f"{IP} AS client_id",
                "CASE event_id % 5 WHEN 4 THEN 'TotalScore' ELSE concat('heur', cast(event_id % 5 AS string)) END "
                "AS heuristic_name",
                "cast(event_id % 10 AS int) AS score",
                "CASE event_id % 3 WHEN 0 THEN 'lab' ELSE 'a,production,b' END AS group_ids",
                "{HR} AS ts",
            ),
        ),
    ),
    "properties": (
        View(
            "events",
            (f"{SOME_UNKNOWN.format(7)} AS id", "{HR} AS ts", "concat('k', cast(event_id % 4 AS string)) AS key", "props AS value"),
        ),
    ),
    "host_stats": (
        View("events", (f"{SOME_UNKNOWN.format(2)} AS id", "{HR} AS ts", f"{HOST} AS host")),
        View("events", (f"{SOME_UNKNOWN.format(2)} AS id", "{HR} AS ts", f"{LATER_HOST} AS host")),
    ),
    "ips": (View("events", (f"{IP} AS ip",), distinct=True),),
    "ranges": (
        View(
            "supplier",
            (
                "s_suppkey AS range_id",
                "cast(167772160 + s_suppkey * 1024 AS bigint) AS lo",
                "cast(167772160 + s_suppkey * 1024 + s_suppkey % 300 AS bigint) AS hi",
            ),
        ),
    ),
    # Overlapping, touching and nested ranges, some across a /16 border.
    "overlaps": (
        View(
            "customer",
            (
                "cast(167772160 + c_custkey * 37 % 200000 AS bigint) AS lo",
                "cast(167772160 + c_custkey * 37 % 200000 + c_custkey % 41 AS bigint) AS hi",
            ),
        ),
    ),
    "prefix_old": (
        View("supplier", ("concat('172.16.', cast(s_suppkey % 60 AS string), '.0/24') AS prefix",), distinct=True),
    ),
    "prefix_new": (
        View("supplier", ("concat('172.16.', cast(s_suppkey % 60 + 5 AS string), '.0/24') AS prefix",), distinct=True),
    ),
    "cloud_entries": (
        View(
            "supplier",
            (
                "CASE s_suppkey % 3 "
                "WHEN 0 THEN concat('10.', cast(s_suppkey % 2 AS string), '.', cast(s_suppkey % 7 AS string), '.0/29') "
                "WHEN 1 THEN concat('10.2.', cast(s_suppkey % 7 AS string), '.', cast(s_suppkey % 200 AS string)) "
                "ELSE concat('10.1.3.', cast(s_suppkey % 100 AS string), '-', cast(s_suppkey % 100 + 9 AS string)) END "
                "AS value",
            ),
        ),
    ),
    "fingerprints": (
        View(
            "events",
            (
                "user_id",
                "CASE user_id % 5 WHEN 0 THEN '//@tcp/14400FFFF205B41301118400+0B' "
                "WHEN 1 THEN '//@tcp/147402000205B41308114+0B' WHEN 2 THEN '//@tcp/143907210205B4481307+0B' "
                "WHEN 3 THEN '//@tcp/14800FFFF205B4114+0B' ELSE '//@tcp/143C04000205B4+0AQ' END AS fp",
            ),
            distinct=True,
        ),
    ),
    "doc_lines": (View("documents", ("doc_id", "text")),),
    "address_tokens": (
        View(
            "events",
            (
                "event_id",
                f"CASE event_id % 7 WHEN 0 THEN {IP} WHEN 1 THEN concat('\"', {IP}, '\",') "
                f"WHEN 2 THEN concat('[', {IP}, ']') WHEN 3 THEN concat('10.0.0.', cast(256 + event_id % 9 AS string)) "
                "WHEN 4 THEN 'fe80::1' WHEN 5 THEN '10.1' ELSE concat('10.0.0.0', cast(event_id % 10 AS string)) END "
                "AS token",
            ),
        ),
    ),
    "json_texts": (
        View(
            "events",
            (
                "event_id",
                "CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN replace(props, '}}', ', \"k\": 0}}') "
                "WHEN 2 THEN replace(props, '}}', ', \"l\": [1, 2, 1]}}') "
                "WHEN 3 THEN concat('{{\"o\": {{\"l\": [\"x\", \"x\"], \"p\": ', props, '}}}}') "
                "WHEN 4 THEN concat('{{\"l\": [', props, ', {{\"m\": [1, 1]}}]}}') WHEN 5 THEN substring(props, 1, 4) "
                "WHEN 6 THEN concat(props, ' x') ELSE concat('{{\"a\": {{\"b\": 1, \"b\": 2}}, \"c\": ', props, '}}') END "
                "AS doc",
            ),
        ),
    ),
    "client_lines": (
        View(
            "events",
            (
                "event_id",
                "CASE event_id % 10 WHEN 0 THEN concat('x ', cast(event_id AS string), "
                "' Unable to load native-hadoop library for your platform...', chr(9), 'y') "
                "WHEN 1 THEN 'WARN: Please see http://www.slf4j.org/codes.html#release for an explanation.' "
                "WHEN 2 THEN concat('stage ', cast(event_id AS string), ' done') "
                "ELSE concat(cast(event_id AS string), chr(9), event_type) END AS value",
            ),
        ),
    ),
    "rule_rows": (
        View(
            "events",
            ("event_id", "cast((event_id % 7 + 1) * 1000 + event_id % 11 AS string) AS rule_id", "event_type"),
        ),
    ),
    "packed_urls": (
        View("pages", ("page_id", "concat(replace(replace(url, '/', '%2F'), '?', '%3f'), '+%zz') AS url")),
    ),
    "scan_feed": (
        View(
            "events",
            (
                f"{IP} AS ip",
                "CASE user_id % 2 WHEN 0 THEN concat('<b>BLACKLISTED ', cast(user_id % 9 AS string), '/40</b>') "
                "ELSE '<b>POSSIBLY SAFE 0/40</b>' END AS body",
            ),
        ),
    ),
    "category_feed": (
        View(
            "events",
            (
                f"{IP} AS ip",
                "CASE WHEN user_id % 5 < 2 THEN concat('{{\"ip\":1,\"Categories\":[\"c', cast(user_id % 4 AS string), "
                "'\"],\"x\":[]}}') ELSE '{{\"err\":\"not found\"}}' END AS body",
            ),
        ),
    ),
    "spam_feed": (
        View(
            "events",
            (
                f"{IP} AS ip",
                "concat('<appears>', CASE user_id % 3 WHEN 0 THEN 'yes' ELSE 'no' END, '</appears><frequency>', "
                "cast(user_id AS string), '</frequency><lastseen>2024-01-02</lastseen>') AS body",
            ),
        ),
    ),
    "threat_feed": (
        View(
            "events",
            (
                "concat(cast(user_id % 200 AS string), '.', cast(user_id % 7 AS string), '.', "
                "cast(user_id % 3 AS string), '.10') AS reversed_ip",
                "concat('127.1.2.', cast(user_id % 10 AS string)) AS body",
            ),
        ),
    ),
    "txt_records": (
        View(
            "supplier",
            (
                "concat('_spf.n', cast(s_nationkey AS string), '.example') AS name",
                "concat('v=spf1 include:_nb', cast(s_suppkey AS string), '.example ?all') AS txt",
            ),
        ),
        View(
            "supplier",
            (
                "concat('_nb', cast(s_suppkey AS string), '.example') AS name",
                "concat('v=spf1 ip4:10.', cast(s_suppkey % 200 AS string), '.0.0/16 ip4:172.16.', "
                "cast(s_suppkey % 250 AS string), '.0/24 ?all') AS txt",
            ),
        ),
    ),
    "order_lines": (
        View(
            "orders",
            (
                "o_orderkey",
                "concat(cast(o_orderkey AS string), chr(9), cast(o_custkey AS string), chr(9), "
                "cast(o_orderkey * 10000000 AS string), chr(9), o_orderstatus, chr(9), "
                "cast(o_totalprice AS string), chr(9), substring(cast(o_orderdate AS string), 1, 10), chr(9), "
                "CASE o_orderkey % 4 WHEN 3 THEN '1.5' ELSE '7' END, chr(9), "
                "concat('\"', o_orderpriority, '\"'), "
                "CASE o_orderkey % 97 WHEN 0 THEN concat(chr(9), 'extra') ELSE '' END) AS line",
            ),
        ),
    ),
    "customer_lines": (
        View(
            "customer",
            (
                "c_custkey",
                "concat(cast(c_custkey AS string), chr(9), c_name, chr(9), cast(c_nationkey AS string), chr(9), "
                "c_mktsegment, chr(9), cast(c_acctbal AS string)) AS line",
            ),
        ),
    ),
}

ORDER_HEADER = ["Order-Key", "Cust Key", "big", "Status", "Total Price!", "order_date", "mixed", "priority"]
CUSTOMER_HEADER = ["custkey", "name", "nation", "segment", "balance"]


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table; its schema is read from the files once per path."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _load(spark: SparkSession, sf_dir: str, base: str) -> DataFrame:
    left, _, rest = base.partition(" JOIN ")
    if not rest:
        return table(spark, sf_dir, left)
    right, _, condition = rest.partition(" ON ")
    return table(spark, sf_dir, left).join(table(spark, sf_dir, right), F.expr(condition))


def _event_time(ms: int) -> Column:
    return F.lit(datetime.fromtimestamp(ms / 1000, tz=timezone.utc).strftime("%F %T.%f")).cast("timestamp_ntz")


def view(spark: SparkSession, sf_dir: str, name: str, window: tuple[int, int] | None = None) -> DataFrame:
    """A derived input.  ``window`` also limits the raw event time, so that the
    parquet scan can skip row groups."""
    result = None
    for v in VIEWS[name]:
        df = _load(spark, sf_dir, v.base)
        if window:
            df = df.filter((F.col("ts") >= _event_time(window[0])) & (F.col("ts") < _event_time(window[1])))
        if v.where:
            df = df.filter(v.where)
        df = df.selectExpr(*[e.format(**SPARK_TIME) if "{" in e else e for e in v.select])
        df = df.distinct() if v.distinct else df
        result = df if result is None else result.unionByName(df)
    return result


def check_view(name: str) -> str:
    """The same input as SQL text for the check engine."""
    parts = []
    for v in VIEWS[name]:
        exprs = ", ".join(e.format(**CHECK_TIME) if "{" in e else e for e in v.select)
        where = f" WHERE {v.where}" if v.where else ""
        parts.append(f"SELECT {'DISTINCT ' if v.distinct else ''}{exprs} FROM {v.base}{where}")
    return " UNION ALL ".join(parts)
