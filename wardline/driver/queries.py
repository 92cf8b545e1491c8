"""Every registered query: (session, table folder) to DataFrame."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.driver.views import CUSTOMER_HEADER, ORDER_HEADER, SPARK_TIME, table, view
from wardline.functions import ip as ipf
from wardline.functions import timetokens as tt
from wardline.functions.jsonqa import json_report
from wardline.functions.text import url_unquote
from wardline.operators import activity, diff, infer, partials, ranges, rows, search, sketches
from wardline.operators.records import resolve_includes
from wardline.operators.rules import PRODUCTS, first_rules, product_rules, rule_table
from wardline.plans import cloud, config, evidence, fingerprint, intel, load, login, logs, metrics, nat, reputation
from wardline.session import shared_folder, stored
from wardline.sources import partitioned as by_hour
from wardline.sources import tables
from wardline.sources.archives import read_archives, write_archives
from wardline.sources.readers import drop_noise, keep_tabbed, read_lines, read_table
from wardline.sources.records import read_records
from wardline.sources.writers import metric_lines, save_table, tag_rows, with_row_ids, write_quoted_tsv, write_tsv
from wardline.streaming.metrics import HourlyCounts

AS_OF_MS = 1_706_659_200_000
MONTH = tt.relative_window("@month_ago", "@now", as_of_ms=AS_OF_MS)
EXCLUDED = "iran|iraq|kenya"
# Hours in one folder of the tables laid out by time.
SLOT_HOURS = 6
TOKENS = ("@hour_ago", "@5_hours_ago", "@day_ago", "@3_days_ago", "@week_ago", "@2_weeks_ago", "@month_ago", "@30_mins_ago")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name, less ``_query`` where a module has that name."""
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


def _listed(df: DataFrame, column: str) -> DataFrame:
    """A list column as comma-separated text."""
    return df.withColumn(column, F.array_join(column, ","))


# ---------------------------------------------------------------- shared addresses


def _detected(spark, sf_dir, networks: DataFrame | None = None) -> DataFrame:
    return nat.nat_detection(
        view(spark, sf_dir, "requests", MONTH),
        view(spark, sf_dir, "accounts"),
        view(spark, sf_dir, "industries"),
        networks,
        window=MONTH,
        excluded_names=EXCLUDED,
    )


@query
def nat_detection(spark, sf_dir):
    return _detected(spark, sf_dir, view(spark, sf_dir, "networks"))


@query
def nat_detection_listed(spark, sf_dir):
    """Detection for the addresses that also show up in client intelligence."""
    return nat.nat_detection(
        view(spark, sf_dir, "requests", MONTH),
        view(spark, sf_dir, "accounts"),
        view(spark, sf_dir, "industries"),
        view(spark, sf_dir, "networks"),
        window=MONTH,
        ips=intel.detected(view(spark, sf_dir, "intel")).select("ip"),
    )


@query
def nat_result_file(spark, sf_dir):
    return tag_rows(nat.with_agents(nat_detection(spark, sf_dir)), "nat_query")


@query
def nat_ua_distribution(spark, sf_dir):
    return nat.agent_distribution(_detected(spark, sf_dir))


@query
def nat_ua_kinds(spark, sf_dir):
    return nat.agent_kinds(_detected(spark, sf_dir))


@query
def nat_account_labels(spark, sf_dir):
    return nat.account_labels(_detected(spark, sf_dir))


@query
def nat_account_split(spark, sf_dir):
    return nat.account_split(_detected(spark, sf_dir))


@query
def nat_account_split_first_row(spark, sf_dir):
    return nat.account_split(_detected(spark, sf_dir), first_row=True)


@query
def nat_account_split_per_ip(spark, sf_dir):
    return nat.account_split(_detected(spark, sf_dir), by=["ip"])


@query
def nat_account_split_per_ip_first_row(spark, sf_dir):
    return nat.account_split(_detected(spark, sf_dir), by=["ip"], first_row=True)


@query
def nat_size_guess(spark, sf_dir):
    return nat.size_guess(_detected(spark, sf_dir))


@query
def nat_size_guess_per_ip(spark, sf_dir):
    return nat.size_guess(_detected(spark, sf_dir), by=["ip"])


@query
def nat_first_row_per_ip(spark, sf_dir):
    return nat.first_attributes(nat_detection(spark, sf_dir))


# ---------------------------------------------------------------- logins


@query
def ato_profile(spark, sf_dir):
    return _listed(login.login_profile(view(spark, sf_dir, "logins"), MONTH), "host_collection")


@query
def ato_totals(spark, sf_dir):
    return login.login_totals(login.login_counts(view(spark, sf_dir, "logins"), MONTH))


# ---------------------------------------------------------------- client intelligence


def _found(spark, sf_dir):
    return intel.detections(view(spark, sf_dir, "intel"))


@query
def client_intel_rollup(spark, sf_dir):
    return intel.rollup(_found(spark, sf_dir))


@query
def attack_hours(spark, sf_dir):
    return intel.attack_hours(intel.detected(view(spark, sf_dir, "intel")))


@query
def heuristic_hosts(spark, sf_dir):
    return _listed(intel.hosts_per_heuristic(_found(spark, sf_dir)), "hosts")


@query
def account_heuristics(spark, sf_dir):
    return _listed(intel.heuristics_per_account(_found(spark, sf_dir)), "heuristics")


@query
def attacked_accounts(spark, sf_dir):
    found = _found(spark, sf_dir)
    return _listed(intel.sorted_accounts(intel.attacked_accounts(found, view(spark, sf_dir, "accounts"))), "heuristics")


@query
def evidence_query(spark, sf_dir):
    hours = intel.attack_hours(intel.detected(view(spark, sf_dir, "intel")))
    gathered = evidence.gather_evidence(
        view(spark, sf_dir, "scores"),
        view(spark, sf_dir, "properties"),
        view(spark, sf_dir, "host_stats"),
        view(spark, sf_dir, "networks"),
        hours=hours,
        ips=view(spark, sf_dir, "ips"),
    )
    return _listed(gathered, "hosts")


# ---------------------------------------------------------------- metrics and time windows


@query
def heuristic_hourly(spark, sf_dir):
    return metrics.sorted_metrics(metrics.heuristic_metrics(view(spark, sf_dir, "scores"), "dc1", MONTH))


@query
def metric_points(spark, sf_dir):
    return metric_lines(metrics.heuristic_metrics(view(spark, sf_dir, "scores"), "dc1", MONTH), metrics.METRIC_PREFIX)


@query
def time_token_window(spark, sf_dir):
    """Events from each token up to now, all counted in one pass."""
    now = tt.resolve_token("@now", AS_OF_MS)
    starts = {token: tt.resolve_token(token, AS_OF_MS) for token in TOKENS}
    requests = view(spark, sf_dir, "requests", (min(starts.values()), now))
    counts = [
        F.struct(
            F.lit(token).alias("token"),
            F.lit(lo).cast("bigint").alias("lo"),
            F.lit(now).cast("bigint").alias("hi"),
            F.count_if(tt.in_window("ts", (lo, now))).alias("n"),
        )
        for token, lo in starts.items()
    ]
    return requests.agg(F.array(*counts).alias("w")).select(F.inline("w"))


@query
def templated_sql(spark, sf_dir):
    view(spark, sf_dir, "requests").createOrReplaceTempView("ddc_nat")
    text = """
        SELECT ip, count(*) AS requests, sum(total_counter) AS total FROM ddc_nat
        WHERE ts >= '@2_weeks_ago' AND ts < '@now' AND ts <> '@date: 20/1/24 8:30' GROUP BY ip
    """
    return spark.sql(tt.render(text, AS_OF_MS))


@query
def full_day_sql(spark, sf_dir):
    view(spark, sf_dir, "requests").createOrReplaceTempView("ddc_nat")
    text = "SELECT ip, count(*) AS requests FROM ddc_nat WHERE '@ddc_nat.full_day: 22/1/24' GROUP BY ip"
    return spark.sql(tt.render(text, AS_OF_MS))


@query
def span_window(spark, sf_dir):
    window = tt.span_window("monday,09:00,5,h", AS_OF_MS)
    requests = view(spark, sf_dir, "requests", window).filter(tt.in_window("ts", window))
    return activity.count_by(requests, "ip", out="requests")


# ---------------------------------------------------------------- stored sketches

SKETCH_ERROR = 0.03


def _near(about, exact):
    return F.abs(about - exact) <= F.lit(SKETCH_ERROR) * exact


@query
def sketched_clients(spark, sf_dir):
    """Distinct clients a day and event type from stored hourly sketches, loaded in two parts and one of them twice.

    The exact counts of the same events stand beside; the approximate ones are
    told by whether they are within 3 %.
    """
    path = shared_folder(spark, "client-sketches")
    events = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "user_id", f"{SPARK_TIME['MS']} AS ts")
    parts = {f"part-{k}": events.filter(F.col("event_id") % 2 == k) for k in (0, 1)}
    for load_id in ("part-0", "part-1", "part-0"):
        sketches.store_sketches(sketches.hourly_sketches(parts[load_id], ["event_type"], "user_id"), path, load_id)
    kept = sketches.read_sketches(spark, path, "event_type string")
    about = kept.groupBy("event_type", "day").agg(F.sum("n").alias("n"), sketches.distinct_count(F.col("sketch")).alias("about"))
    day = F.floor(F.col("ts") / sketches.DAY_MS).cast("int").alias("day")
    exact = events.groupBy("event_type", day).agg(F.count_distinct("user_id").alias("users"))
    return exact.join(about, ["event_type", "day"], "left").select("event_type", "day", "n", "users", _near(F.col("about"), F.col("users")).alias("near"))


@query
def sketched_window(spark, sf_dir):
    """Distinct clients of one window over all event types, from the sketches alone, beside the exact count."""
    path = shared_folder(spark, "client-sketches")
    events = table(spark, sf_dir, "events").selectExpr("event_type", "user_id", f"{SPARK_TIME['MS']} AS ts")
    sketches.store_sketches(sketches.hourly_sketches(events, ["event_type"], "user_id"), path, "all")
    hours = tuple(bound // sketches.HOUR_MS * sketches.HOUR_MS for bound in MONTH)
    found = sketches.window_counts(sketches.read_sketches(spark, path, "event_type string"), hours, [])
    exact = events.filter(tt.in_window("ts", hours)).agg(F.count_distinct("user_id").alias("users"))
    return found.select("n", exact.scalar().alias("users"), _near(F.col("about"), exact.scalar()).alias("near"))


@query
def ato_profile_approx(spark, sf_dir):
    """The login profile with approximate counts, told by whether they are within 3 % of the exact ones."""
    logins = view(spark, sf_dir, "logins", MONTH)
    about = login.login_counts(logins, MONTH, approximate=True)
    exact = login.login_counts(logins, MONTH).withColumnsRenamed({"count_hosts": "hosts", "count_emails": "emails"})
    return exact.join(about, "ip").select(
        "ip", "hosts", "emails", (_near(F.col("count_hosts"), F.col("hosts")) & _near(F.col("count_emails"), F.col("emails"))).alias("near")
    )


# ---------------------------------------------------------------- addresses and ranges


@query
def ip_expand(spark, sf_dir):
    expanded = ranges.expand(view(spark, sf_dir, "ranges"))
    return expanded.select("range_id", "address", ipf.long_to_ip("address").alias("ip"))


@query
def ip_cidr_cover(spark, sf_dir):
    blocks = ranges.cidr_blocks(view(spark, sf_dir, "ranges"))
    return blocks.select("range_id", ipf.cidr_text("network", "prefix_len").alias("cidr"))


@query
def ip_validate(spark, sf_dir):
    clean = ipf.clean_token("token")
    return view(spark, sf_dir, "address_tokens").select(
        "event_id",
        clean.alias("clean"),
        ipf.is_ipv4(clean).alias("is_ipv4"),
        ipf.is_address(clean).alias("is_address"),
        ipf.ip_to_long(clean).alias("address"),
    )


@query
def ip_range_normalise(spark, sf_dir):
    last = F.col("hi").bitwiseAND(F.lit(255).cast("bigint")).cast("string")
    text = F.concat(ipf.long_to_ip("lo"), F.lit("-"), last)
    bounds = view(spark, sf_dir, "ranges").select("range_id", text.alias("text")).withColumn("b", ipf.range_bounds("text"))
    return bounds.select("range_id", "text", ipf.long_to_ip(F.col("b.lo")).alias("first"), ipf.long_to_ip(F.col("b.hi")).alias("last"))


@query
def ip_reverse(spark, sf_dir):
    return view(spark, sf_dir, "ips").select("ip", ipf.reverse_octets("ip").alias("reversed"))


@query
def ip_numbers(spark, sf_dir):
    numbers = view(spark, sf_dir, "requests").select("event_id", ipf.ip_to_long("ip").alias("number"))
    stored = numbers.withColumn("stored", F.unhex(F.lpad(F.hex("number"), 8, "0")))
    return stored.select(
        "event_id", "number", ipf.long_to_ip("number").alias("back"), ipf.binary_to_ip("stored").alias("from_binary")
    )


@query
def ip_membership(spark, sf_dir):
    return ranges.membership(view(spark, sf_dir, "ips"), view(spark, sf_dir, "ranges"), unique=True)


@query
def request_membership(spark, sf_dir):
    requests = view(spark, sf_dir, "requests").select("event_id", "ip")
    return ranges.membership(requests, view(spark, sf_dir, "ranges"))


@query
def ip_not_in(spark, sf_dir):
    return ranges.keep_members(view(spark, sf_dir, "ips"), view(spark, sf_dir, "ranges"), inside=False, unique=True)


@query
def ip_in(spark, sf_dir):
    return ranges.keep_members(view(spark, sf_dir, "ips"), view(spark, sf_dir, "ranges"), unique=True)


@query
def ip_enrich(spark, sf_dir):
    requests = view(spark, sf_dir, "requests").select("event_id", "ip")
    return ranges.enrich(requests, view(spark, sf_dir, "owners"))


@query
def merge_intervals(spark, sf_dir):
    singles = view(spark, sf_dir, "ips").select(ipf.ip_to_long("ip").alias("lo"), ipf.ip_to_long("ip").alias("hi"))
    return ranges.merge_ranges(view(spark, sf_dir, "overlaps").unionByName(singles))


@query
def prefix_drift(spark, sf_dir):
    return diff.drift(view(spark, sf_dir, "prefix_old"), view(spark, sf_dir, "prefix_new"), ["prefix"])


@query
def prefix_drift_summary(spark, sf_dir):
    return diff.drift_summary(view(spark, sf_dir, "prefix_old"), view(spark, sf_dir, "prefix_new"), ["prefix"])


@query
def range_symmetric_difference(spark, sf_dir):
    left = view(spark, sf_dir, "ranges").select("lo", "hi")
    return diff.symmetric_difference(left, view(spark, sf_dir, "overlaps"), ["lo", "hi"])


@query
def cloud_range_drift(spark, sf_dir):
    """Published lists and provider documents of at most eight prefixes each."""
    eighth = F.floor(F.split_part("prefix", F.lit("."), F.lit(3)).cast("int") / 8).alias("g")
    old = view(spark, sf_dir, "prefix_old").groupBy(eighth).agg(F.collect_list("prefix").alias("list"))
    entry = F.struct(F.when(F.col("prefix").like("%.7.%"), "S3").otherwise("EC2").alias("service"), F.col("prefix").alias("ip_prefix"))
    new = view(spark, sf_dir, "prefix_new").groupBy(eighth).agg(F.collect_list(entry).alias("prefixes"))
    published = old.select(F.to_json(F.struct("list")).alias("value"))
    provider = new.select(F.to_json(F.struct("prefixes")).alias("value"))
    return cloud.range_drift(published, provider)


@query
def cloud_membership(spark, sf_dir):
    requests = view(spark, sf_dir, "requests").select("event_id", "ip")
    return cloud.cloud_membership(requests, view(spark, sf_dir, "cloud_entries"))


@query
def listed_requests(spark, sf_dir):
    """Requests of the addresses that logged in."""
    listed = view(spark, sf_dir, "logins").select("ip")
    return search.keep_listed(view(spark, sf_dir, "requests").select("event_id", "ip"), "ip", listed, small=False)


def _document_lines(spark, sf_dir):
    lines = F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    return view(spark, sf_dir, "doc_lines").select("doc_id", lines).withColumn("line_no", F.col("line_no") + 1)


def _wanted_addresses(spark, sf_dir):
    """Addresses named in documents, also without their last digit, and all clients."""
    named = _document_lines(spark, sf_dir).select(F.explode(search.whole_quads(F.col("line"))).alias("ip"))
    both = F.array("ip", F.regexp_replace("ip", "([0-9])[0-9]$", "$1"))
    return named.select(F.explode(both).alias("ip")).unionByName(view(spark, sf_dir, "ips")).distinct()


@query
def ip_search_lines(spark, sf_dir):
    lines, keys = _document_lines(spark, sf_dir), ["doc_id", "line_no"]
    hits = search.search_lines(lines, _wanted_addresses(spark, sf_dir), keys)
    return search.with_lines(hits, lines, keys)


@query
def ip_search_tokens(spark, sf_dir):
    lines = _document_lines(spark, sf_dir)
    return search.search_lines(lines, _wanted_addresses(spark, sf_dir), ["doc_id", "line_no"], whole=True)


# ---------------------------------------------------------------- typed load


def _order_votes(spark, sf_dir):
    good = infer.accepted(infer.parse_lines(view(spark, sf_dir, "order_lines"), ORDER_HEADER))
    return infer.type_votes(good, ORDER_HEADER, [f"_f{i}" for i in range(len(ORDER_HEADER))], "o_orderkey")


def _customer_votes(spark, sf_dir):
    good = infer.accepted(infer.parse_lines(view(spark, sf_dir, "customer_lines"), CUSTOMER_HEADER))
    return infer.type_votes(good, CUSTOMER_HEADER, [f"_f{i}" for i in range(len(CUSTOMER_HEADER))], "c_custkey")


@query
def type_vote(spark, sf_dir):
    return _order_votes(spark, sf_dir)


@query
def schema_diff(spark, sf_dir):
    """Positions and types that only one of two inferred layouts has."""
    columns = ["ordinal", "type"]
    return diff.symmetric_difference(_order_votes(spark, sf_dir), _customer_votes(spark, sf_dir), columns)


@query
def typed_load(spark, sf_dir):
    typed, _, _ = load.typed_lines(view(spark, sf_dir, "order_lines"), ORDER_HEADER, "o_orderkey")
    return with_row_ids(typed, "o_orderkey").withColumn("order_date", F.col("order_date").cast("string"))


@query
def rejected_lines(spark, sf_dir):
    parsed = infer.parse_lines(view(spark, sf_dir, "order_lines"), ORDER_HEADER)
    return infer.rejected(parsed).select("line")


@query
def unfit_values(spark, sf_dir):
    """Values of a wrong type per column when a narrower layout is asked for."""
    good = infer.accepted(infer.parse_lines(view(spark, sf_dir, "order_lines"), ORDER_HEADER))
    types = ["int", "int", "int", "double", "int", "datetime", "int", "date"]
    return infer.unfit_values(good, ORDER_HEADER, [f"_f{i}" for i in range(len(ORDER_HEADER))], types)


@query
def split_files(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return rows.split_rows(orders, "o_orderkey")


@query
def evidence_by_hour(spark, sf_dir):
    """The evidence of the attack hours from tables laid out by time, of which only those slots are read."""
    hours = intel.attack_hours(intel.detected(view(spark, sf_dir, "intel")))
    pruned = []
    for name in ("scores", "properties", "host_stats"):
        rows_ = view(spark, sf_dir, name)
        path = shared_folder(spark, f"by-hour-{name}")
        by_hour.write_by_hour(rows_, path, width=SLOT_HOURS)
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows_.schema)
        pruned.append(by_hour.in_hours(by_hour.read_by_hour(spark, path, kind), hours, width=SLOT_HOURS))
    gathered = evidence.gather_evidence(*pruned, view(spark, sf_dir, "networks"))
    return _listed(gathered, "hosts")


@query
def counted_files(spark, sf_dir):
    """Requests per address, counted file by file in two runs, of which the second reads the later files only."""
    folder, store = shared_folder(spark, "request-files"), shared_folder(spark, "request-counts")
    requests = view(spark, sf_dir, "requests")
    for part in (0, 1):
        requests.filter(F.col("event_id") % 2 == part).select("ip").write.parquet(f"{folder}/part-{part}")
        partials.update_counts(spark, folder, store, "ip", lambda names: spark.read.schema("ip string").parquet(*names), "*.parquet")
    return partials.total_counts(spark, store)


def _product_agents(spark, sf_dir) -> DataFrame:
    """Agents of two products each; their number grows with the events."""
    names = F.array(*map(F.lit, PRODUCTS))
    product = lambda n: F.get(names, (n % len(PRODUCTS)).cast("int"))
    event, user = F.col("event_id"), F.col("user_id")
    parts = [F.lit("Mozilla/5.0 "), product(event), F.lit("/"), user % 1200, F.lit(".1 "), product(event * 7 + 3), F.lit("/"), event % 40]
    return table(spark, sf_dir, "events").select(F.concat(*[p.cast("string") for p in parts]).alias("agent"))


@query
def agent_rules(spark, sf_dir):
    """The first of some hundred product rules for each distinct agent."""
    found = first_rules(_product_agents(spark, sf_dir), rule_table(spark, product_rules()), "agent")
    return found.select(F.col("text").alias("agent"), "rule_no", "label", "part")


# ---------------------------------------------------------------- files, archives and tables


def _noted(spark, sf_dir) -> DataFrame:
    """Documents whose texts hold quotes, tabs and line breaks."""
    text = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(" the "), F.lit(' "the"\t')), F.lit(". "), F.lit(".\n")), F.lit("ab"), F.lit("a\\"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", text.alias("text"))


def _read_back(spark, path: str, escape: str) -> DataFrame:
    records = read_records(spark, path, escape=escape).filter("record_no > 1 AND problem IS NULL")
    parsed = infer.accepted(infer.parse_lines(records.select("record"), ["doc_id", "lang", "text"], "record", escape=escape))
    return parsed.select(F.col("_f0").cast("bigint").alias("doc_id"), F.col("_f1").alias("lang"), F.md5("_f2").alias("text_md5"))


@query
def quoted_records(spark, sf_dir):
    """Documents written as quoted values with line breaks and read back, block by block."""
    path = shared_folder(spark, "quoted-records")
    write_tsv(_noted(spark, sf_dir), path)
    return _read_back(spark, path, '"')


@query
def quoted_sink(spark, sf_dir):
    """The same with every value quoted and a backslash as escape."""
    path = shared_folder(spark, "quoted-sink")
    write_quoted_tsv(_noted(spark, sf_dir), path)
    return _read_back(spark, path, "\\")


@query
def archived_lines(spark, sf_dir):
    """Lines of documents written into archives and read back with their numbers."""
    path = shared_folder(spark, "archives")
    texts = _noted(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "text"))
    write_archives(texts.select(F.concat_ws("\t", "doc_id", "place", "text").alias("line")), path)
    parts = F.split("line", "\t", 3)
    lines = read_archives(spark, path).select(
        F.get(parts, 0).cast("bigint").alias("doc_id"), F.get(parts, 1).cast("int").alias("place"), F.get(parts, 2).alias("text"), "path", "line_no"
    )
    # A document's lines follow one another; a large one may go on in the next archive.
    runs = lines.groupBy("doc_id", "path").agg(F.count("*").alias("n"), (F.max("line_no") - F.min("line_no") + 1).alias("span"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    texts = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.md5(F.array_join(ordered, "\n")).alias("text_md5"))
    numbered = runs.groupBy("doc_id").agg(F.bool_and(F.col("n") == F.col("span")).alias("numbered"))
    return texts.join(numbered, "doc_id")


@query
def listed_lines(spark, sf_dir):
    """A list of one value a line, white space at the end removed, and how often each value is listed."""
    path = shared_folder(spark, "line-list")
    listed = view(spark, sf_dir, "address_tokens").select(F.concat("token", F.when(F.col("event_id") % 3 == 0, " \t").otherwise("")).alias("value"))
    listed.write.text(path)
    return read_lines(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query
def table_lifecycle(spark, sf_dir):
    """A table of orders through its life: created, appended to twice under one load id, replaced, refused, renamed, dropped."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    name = f"orders_{uuid.uuid4().hex[:12]}"
    states = []

    def told(step: str, name: str) -> None:
        found = read_table(spark, name).groupBy("o_orderstatus").agg(
            F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"), F.sum("cents").alias("cents")
        )
        states.append(stored(found.select(F.lit(step).alias("step"), "*"), "table-states"))

    parts = {part: orders.filter(F.col("o_orderkey") % 4 == part) for part in range(4)}
    for part in (0, 1, 1, 2):
        tables.append(parts[part], name, f"part-{part}")
    told("appended", name)
    tables.append(parts[3].filter("o_orderstatus = 'F'"), name, "part-1")
    told("load repeated with other rows", name)
    broken = orders.select(F.when(F.col("o_orderkey") > 0, F.raise_error(F.lit("broken"))).cast("bigint").alias("o_orderkey"), "o_orderstatus", "cents")
    for rows_, refused in ((broken, "replace"), (orders.drop("cents"), "append")):
        try:
            save_table(rows_, name, "overwrite" if refused == "replace" else "append")
        except (ValueError, PySparkException):
            told(f"{refused} refused", name)
    save_table(orders, name, "overwrite")
    told("replaced", name)
    renamed = save_table(parts[0], name, "rename", f"{name}_2")
    told("renamed", renamed)
    for gone in (name, renamed):
        tables.drop(spark, gone)
        if spark.catalog.tableExists(gone):
            told("still there", gone)
    return functools.reduce(DataFrame.unionByName, states)


# ---------------------------------------------------------------- logs, rules, JSON


def _access_lines(spark, sf_dir):
    """Access-log lines of 73 fields from the request events."""
    filled = {
        2: F.col("ts").cast("string"),
        10: F.col("ip"),
        11: F.lit("GET"),
        12: F.concat(F.lit("/a%20b/"), F.col("event_id").cast("string"), F.lit("?q=x+y%2fz")),
        13: F.when(F.col("event_id") % 5 == 0, "404").otherwise("200"),
        17: F.lit("www.example"),
        20: F.concat(F.lit('"'), F.col("user_agent"), F.lit('"')),
        23: F.col("total_counter").cast("string"),
        61: F.lit('"rule ""2005"" %zz"'),
        73: F.concat(F.lit("end"), F.col("cpcode").cast("string")),
    }
    fields = [filled.get(i, F.lit("-")) for i in range(1, logs.LOG_WIDTH + 1)]
    return view(spark, sf_dir, "requests").select("event_id", F.concat_ws(" ", *fields).alias("line"))


@query
def log_parse(spark, sf_dir):
    return logs.parse_access_log(_access_lines(spark, sf_dir))


@query
def url_unquote_query(spark, sf_dir):
    return view(spark, sf_dir, "packed_urls").select("page_id", url_unquote("url").alias("url"))


@query
def noise_filter(spark, sf_dir):
    return drop_noise(view(spark, sf_dir, "client_lines"))


@query
def tab_lines(spark, sf_dir):
    return keep_tabbed(view(spark, sf_dir, "client_lines"))


@query
def rule_category(spark, sf_dir):
    return logs.categorise_rules(view(spark, sf_dir, "rule_rows"), 1)


@query
def json_quality(spark, sf_dir):
    report = view(spark, sf_dir, "json_texts").select("event_id", json_report("doc").alias("r"))
    values = F.transform("r.duplicate_values", lambda v: F.concat(v["path"], F.lit("="), v["value"]))
    return report.select(
        "event_id",
        F.col("r.valid").alias("valid"),
        F.array_join("r.duplicate_keys", ",").alias("duplicate_keys"),
        F.array_join(values, ",").alias("duplicate_values"),
    )


@query
def json_override(spark, sf_dir):
    return config.score_override(view(spark, sf_dir, "ranges"))


@query
def json_whitelist(spark, sf_dir):
    codes = view(spark, sf_dir, "requests").select(F.col("cpcode").cast("string").alias("code"))
    entries = view(spark, sf_dir, "prefix_new").select(F.col("prefix").alias("entry"))
    return config.whitelist(codes, entries, "global", list_entries=20)


# ---------------------------------------------------------------- fingerprints, reputation


@query
def tcp_fingerprint(spark, sf_dir):
    return fingerprint.decode_fingerprints(view(spark, sf_dir, "fingerprints"))


@query
def tcp_os_match(spark, sf_dir):
    return fingerprint.operating_systems(view(spark, sf_dir, "fingerprints")).select("user_id", "os", "signature")


@query
def tcp_os_match_strict(spark, sf_dir):
    found = fingerprint.operating_systems(view(spark, sf_dir, "fingerprints"), strict=True)
    return found.select("user_id", "os", "signature")


@query
def blacklist_consolidate(spark, sf_dir):
    return reputation.consolidate(
        view(spark, sf_dir, "ips"),
        view(spark, sf_dir, "scan_feed"),
        view(spark, sf_dir, "threat_feed"),
        view(spark, sf_dir, "category_feed"),
        view(spark, sf_dir, "spam_feed"),
    )


@query
def spf_include(spark, sf_dir):
    return resolve_includes(view(spark, sf_dir, "txt_records"))


# ---------------------------------------------------------------- counting and activity


@query
def ip_counter(spark, sf_dir):
    return activity.count_by(view(spark, sf_dir, "requests"), "ip")


@query
def active_days(spark, sf_dir):
    return activity.active_days(view(spark, sf_dir, "logins"))


@query
def activity_gaps(spark, sf_dir):
    return activity.activity_profile(view(spark, sf_dir, "logins"))


@query
def heuristic_stream(spark, sf_dir):
    """Hourly metrics as a stream over the event files, run to the end of the input."""
    columns = [
        "cast(ts AS timestamp) AS at",
        "concat('10.', user_id % 3, '.', user_id % 7, '.', user_id % 200) AS client_id",
        "CASE event_id % 5 WHEN 4 THEN 'TotalScore' ELSE concat('heur', event_id % 5) END AS heuristic_name",
        "CASE event_id % 3 WHEN 0 THEN 'lab' ELSE 'a,production,b' END AS group_ids",
    ]
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    scores = events.selectExpr(*columns)
    folder = shared_folder(spark, "heuristic-stream")
    counts = HourlyCounts(f"{folder}/points", "dc1")
    counts.start(scores, f"{folder}/state").awaitTermination()
    return counts.points(spark)
