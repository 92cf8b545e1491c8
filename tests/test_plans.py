"""Investigations, lists, signatures and streams on small fixtures."""

import random

from pyspark.sql import functions as F

from wardline.functions import tcp
from wardline.operators import activity, diff
from wardline.operators.records import resolve_includes
from wardline.operators.signatures import SIGNATURES, match_signatures, signature_table
from wardline.operators.skew import chunked_lists
from wardline.plans import config, evidence, fingerprint, intel, login, metrics, nat, reputation
from wardline.session import shared_folder
from wardline.streaming.metrics import hourly_clients, write_points

NAT_SCHEMA = "ip string, account_name string, subvertical string, ua string, total bigint"


def nat_fixture(spark):
    requests = spark.createDataFrame(
        [("10.0.0.1", 1, "ua1", 5, 100), ("10.0.0.1", 1, "ua1", 6, 150), ("10.0.0.1", 2, "ua2", 1, 100),
         ("10.0.0.2", 3, "ua1", 9, 100), ("10.0.0.2", 1, "ua1", 7, 999), ("11.0.0.1", 1, "ua3", 2, 120), ("10.0.0.1", 4, "ua1", 3, 100)],
        "ip string, cpcode int, user_agent string, total_counter bigint, ts bigint",
    )
    accounts = spark.createDataFrame(
        [(1, "Acme", 10), (1, "Acme", 10), (2, "Adco", 20), (3, "Shop", 30), (4, "BadCo", 10), (5, None, 10)],
        "cpcode int, account_name string, account int",
    )
    industries = spark.createDataFrame(
        [(10, "Business Services", ""), (20, "Media", "Advertising Technology"), (30, "Retail", None)],
        "account_id int, vertical string, subvertical string",
    )
    networks = spark.createDataFrame(
        [(167772160, 8, "Big", "XX", "big.example", "cable", 1)],
        "lo bigint, prefix_len int, company string, country string, domain string, network_type string, asnum int",
    )
    return requests, accounts, industries, networks


def test_nat_detection(spark):
    got = nat.nat_detection(*nat_fixture(spark), window=(100, 200), excluded_names="badco|other")
    assert got.columns == nat.RESULT_COLUMNS
    rows = sorted((r.ip, r.account_name, r.ua, r.total, r.company) for r in got.collect())
    assert rows == [
        ("10.0.0.1", "Acme", "ua1", 11, "Big"),
        ("10.0.0.1", "Adco", "ua2", 1, "Big"),
        ("11.0.0.1", "Acme", "ua3", 2, None),
    ]
    one = nat.nat_detection(*nat_fixture(spark), ips=["10.0.0.2"])
    assert [(r.ip, r.total) for r in one.collect()] == [("10.0.0.2", 7)]
    assert [r.ip for r in nat.sorted_result(got).collect()] == ["10.0.0.1", "10.0.0.1", "11.0.0.1"]


def test_account_split(spark):
    rows = [
        ("a", "A", "Advertising Technology", "u1", 1),
        ("a", "A", "Advertising Technology", "u2", 10),
        ("b", "A", "Advertising Technology", "u3", 100),
        ("a", "B", "", "u1", 1000),
        ("a", "B", None, "u4", 10000),
        ("b", "C", "Logistics", "u1", 5),
    ]
    frame = spark.createDataFrame(rows, NAT_SCHEMA).repartition(3)
    assert tuple(nat.account_split(frame).first()) == (1, 3, 111, 2, 1, 11005)
    assert tuple(nat.account_split(frame, first_row=True).first()) == (1, 1, 1, 2, 3, 1005)
    per_ip = {r.ip: tuple(r)[1:] for r in nat.account_split(frame, by=["ip"]).collect()}
    assert per_ip == {"a": (1, 2, 11, 1, 1, 11000), "b": (1, 1, 100, 1, 1, 5)}
    labels = [r.label for r in nat.account_labels(frame).collect()]
    assert labels == ["Advertising Technology --> A", "Logistics --> C", "Sub-Vertical Not Found --> B"]
    assert nat.size_guess(frame).first().guess.endswith("Not Seem To Be Shared")


def test_login_totals_count_shared_hosts_twice(spark):
    logins = spark.createDataFrame(
        [("1.1.1.1", "h", "e1", 1), ("2.2.2.2", "h", "e1", 1), ("2.2.2.2", None, "e2", 1)], "ip string, host string, email_hash string, ts bigint"
    )
    assert tuple(login.login_totals(login.login_counts(logins)).first()) == (2, 3)
    profile = {r.ip: (r.count_hosts, r.count_emails, r.host_collection, r.list_part) for r in login.login_profile(logins, (0, 5)).collect()}
    assert profile == {"1.1.1.1": (1, 1, ["h"], 0), "2.2.2.2": (1, 2, ["h"], 0)}
    empty = login.login_profile(logins.filter("host IS NULL")).first()
    assert (empty.count_hosts, empty.host_collection, empty.list_part) == (0, [], 0)


def test_long_lists_are_cut_but_whole(spark):
    rng = random.Random(2)
    pairs = [("hot", f"v{i}") for i in range(2000)] + [(f"k{i}", f"v{rng.randrange(9)}") for i in range(300)] + [(None, "x")]
    frame = spark.createDataFrame(pairs + pairs[:500], "k string, v string").repartition(4)
    got = chunked_lists(frame, ["k"], "v", "vs", "part", list_items=100).collect()
    hot = [r for r in got if r.k == "hot"]
    assert len(hot) > 20 and max(len(r.vs) for r in hot) <= 100
    assert sorted(v for r in hot for v in r.vs) == sorted(f"v{i}" for i in range(2000))
    assert all(r.vs == sorted(r.vs) for r in got)
    rest = {r.k: r for r in got if r.k != "hot"}
    assert len(rest) == 301 and all(r.part == 0 for r in rest.values()) and rest[None].vs == ["x"]


def test_skewed_join_is_split(spark):
    """Adaptive execution cuts the partition of a popular address."""
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    from wardline.operators.ranges import membership

    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        one_third = F.when(F.col("id") % 3 == 0, "10.0.0.1").otherwise(F.concat(F.lit("10.0."), F.col("id") % 200, F.lit("."), F.col("id") % 250))
        facts = spark.range(60000, numPartitions=8).select(one_third.alias("ip"), F.md5(F.col("id").cast("string")).alias("payload"))
        got = membership(facts, spark.createDataFrame([(167772160, 167772161)], "lo bigint, hi bigint"))
        assert got.filter("in_set").count() >= 20000
        got.write.format("noop").mode("overwrite").save()
        frame = got.groupBy("in_set").agg(F.sum(F.length("payload")))
        frame.collect()
        assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in small:
            spark.conf.unset(key)


def intel_fixture(spark):
    def packed(name, hosts):
        return str([{"heuristic_name": name, "category": "c", "hosts": hosts}])

    rows = [
        (3_600_001, "1.1.1.1", "true", "['10',\"20\"]", "[h1,h2]", packed("sqli;v1", ["h1", "h3"])),
        (3_700_000, "1.1.1.1", "TRUE", "[]", "[]", packed("xss;v2", ["h1"])),
        (9_000_000, "1.1.1.1", "False", "[30]", "[h9]", packed("no;v", ["h9"])),
        (9_000_000, "1.1.1.1", None, "[30]", "[h9]", packed("no;v", ["h9"])),
        (9_000_000, "2.2.2.2", "true", "[10]", "[h1]", packed("xss;v2", ["h4"])),
    ]
    return spark.createDataFrame(rows, "ts bigint, ip string, heuristic_detected string, accounts string, hosts string, evidences string")


def test_client_intel(spark):
    found = intel.detections(intel_fixture(spark))
    assert sorted(r.hour for r in intel.attack_hours(found).collect()) == [3_600_000, 7_200_000]
    kinds = sorted((r.kind, r.value) for r in intel.rollup(found).collect())
    assert kinds == [("account", "10"), ("account", "20"), ("category", "c"), ("host", "h1"), ("host", "h2")]
    hosts = {r.heuristic: r.hosts for r in intel.hosts_per_heuristic(found).collect()}
    assert hosts == {"sqli": ["h1", "h3"], "xss": ["h1", "h4"]}
    per_account = {r.account: r.heuristics for r in intel.heuristics_per_account(found).collect()}
    assert per_account == {"10": ["sqli", "xss"], "20": ["sqli"], "": ["xss"]}
    names = spark.createDataFrame([(10, "Zed"), (10, "Acme"), (99, "Other")], "account int, account_name string")
    rows = intel.sorted_accounts(intel.attacked_accounts(found, names)).collect()
    assert [(r.account, r.account_name) for r in rows] == [("20", "(ACCOUNT DETAILS MISSING)"), ("10", "Acme")]
    assert intel.detections(intel_fixture(spark), window=(0, 8_000_000), ips=["1.1.1.1"]).count() == 2


def test_evidence(spark):
    scores = spark.createDataFrame(
        [(1, "10.0.0.1", "xss", 5, "a,production", 100), (2, "10.0.0.1", "TotalScore", 5, "production", 100),
         (3, "10.0.0.1", "xss", 5, "lab", 100), (4, "10.0.0.1", "xss", 6, "production", 200), (5, "10.0.0.1", "xss", 6, "production", 300)],
        "id int, client_id string, heuristic_name string, score int, group_ids string, ts bigint",
    )
    properties = spark.createDataFrame([(i, t, "k", f"v{i}") for i, t in [(1, 100), (2, 100), (4, 200), (4, 999), (5, 300)]], "id int, ts bigint, key string, value string")
    hosts = spark.createDataFrame([(1, 100, "h2"), (1, 100, "h1"), (1, 100, "h1"), (4, 300, "x")], "id int, ts bigint, host string")
    networks = spark.createDataFrame([(167772160, 24, "Co", "co.example")], "lo bigint, prefix_len int, company string, domain string")
    hours = spark.createDataFrame([(100,), (200,), (100,)], "hour bigint")
    rows = evidence.gather_evidence(scores, properties, hosts, networks, hours=hours, ips=["10.0.0.1"]).orderBy("score").collect()
    assert [(r.ip, r.company, r.value, r.hosts, r.list_part, r.ts) for r in rows] == [
        ("10.0.0.1", "Co", "v1", ["h1", "h2"], 0, 100), ("10.0.0.1", "Co", "v4", None, 0, 200),
    ]


def test_metrics(spark):
    scores = spark.createDataFrame(
        [("c1", "h", "production", 3_600_000), ("c1", "h", "production", 3_600_000), ("c2", "h", "production", 7_200_000), ("c3", "h", "lab", 3_600_000)],
        "client_id string, heuristic_name string, group_ids string, ts bigint",
    )
    points = metrics.sorted_metrics(metrics.heuristic_metrics(scores, "dc9", (0, 7_200_000)))
    assert [tuple(r) for r in points.collect()] == [("heuristics.h.dc9", 1, "3600000"), ("heuristics.h.dc9", 1, "7200000")]


def test_stream_counts_clients_once_per_hour(spark, tmp_path):
    def batch(name, rows):
        frame = spark.createDataFrame(rows, "at string, client_id string, heuristic_name string, group_ids string")
        frame.withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    folder = shared_folder(spark, "test-stream")

    def run():
        schema = "at timestamp, client_id string, heuristic_name string, group_ids string"
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        write_points(hourly_clients(stream, "dc"), f"{folder}/points", f"{folder}/state").awaitTermination()
        return sorted((r.path, r.count_ips, r.ts) for r in spark.read.parquet(f"{folder}/points").collect())

    batch("one", [("2024-01-01 00:10:00", "a", "h", "production"), ("2024-01-01 00:20:00", "a", "h", "production")])
    assert run() == []
    batch("two", [("2024-01-01 00:50:00", "b", "h", "production"), ("2024-01-01 00:55:00", "a", "h", "production"),
                  ("2024-01-01 00:55:00", "x", "h", "lab"), ("2024-01-01 02:30:00", "a", "h", "production")])
    assert run() == [("heuristics.h.dc", 2, 1704067200)]
    batch("three", [("2024-01-01 00:01:00", "late", "h", "production"), ("2024-01-01 05:00:00", "a", "h", "production")])
    assert run() == [("heuristics.h.dc", 1, 1704074400), ("heuristics.h.dc", 2, 1704067200)]


def expected_matches(raw, strict):
    """Plain reading of the matching rules, as brute force."""
    c = raw.split(":")
    out = set()
    for label, texts in SIGNATURES.items():
        for text in texts:
            s = text.split(":")
            ttl = s[1] if strict else s[1].rstrip("-")
            window, scale = s[4].split(",")
            c_window, c_scale = c[4].split(",")
            if window == "*":
                fits = True
            elif "*" in window:
                unit = int(c[3]) + (40 if window.startswith("mtu") else 0)
                fits = not strict and unit * int(window.split("*")[1]) == int(c_window)
            else:
                fits = window == c_window
            if fits and s[0] in ("*", c[0]) and ttl in ("*", c[1]) and s[2] == c[2] and s[3] in ("*", c[3]) and scale in ("*", c_scale) and s[5:] == c[5:]:
                out.add((label, text))
    return out


def test_signatures_against_brute_force(spark):
    rng = random.Random(11)
    pool = [t.split(":") for texts in SIGNATURES.values() for t in texts]
    raws = set()
    for s in pool * 3:
        mss = s[3] if s[3] != "*" else rng.choice(["1460", "1380", "536"])
        window, scale = s[4].split(",")
        if "*" in window[1:]:
            window = str((int(mss) + (40 if window.startswith("mtu") else 0)) * int(window.split("*")[1]))
        window = "5840" if window == "*" else window
        scale = rng.choice(["0", "7"]) if scale == "*" else scale
        raws.add(":".join([rng.choice("46") if s[0] == "*" else s[0], s[1].rstrip("-"), s[2], mss, f"{window},{scale}", *s[5:]]))
    rows = []
    for raw in sorted(raws):
        c = raw.split(":")
        rows.append((raw, c[0], int(c[1]), c[2], int(c[3]), int(c[4].split(",")[0]), int(c[4].split(",")[1]), c[5], c[6], c[7]))
    fields = "ip_version string, initial_ttl bigint, ip_options string, mss bigint, window bigint, scale bigint, options string, quirks string, payload string"
    frame = spark.createDataFrame(rows, "raw string, " + fields).select("raw", F.struct(*[f.split()[0] for f in fields.split(", ")]).alias("decoded"))
    for strict in (False, True):
        got = {}
        for r in match_signatures(frame, strict=strict).collect():
            got.setdefault(r.raw, set()).add((r.os, r.signature))
        for raw in raws:
            assert got.get(raw, set()) == expected_matches(raw, strict), raw
    assert signature_table(spark).count() == 91 and len(SIGNATURES) == 45


def test_fingerprint_decoding(spark):
    cases = {
        "//@tcp/14390001+0B": None,
        "//@tcp/1439000105+0": None,
        "//@tcp/14390001020598+0Z": None,
        "//@tcp/143900010205981z3+0": None,
        "//@tcp/14390001020zz8+0": None,
        "//@tcp/1439000102059851!zz9+0AD": "4:64:0:1432:16,0:mss,sack,nop:df,ecn:0",
        "//@tcp/1439100102057810000+5": "4:64:1:1400:16,0:mss,nop,eol+3::5",
        "//@tcp/14390001020578301302+0": "4:64:0:1400:16,2:mss,ws,ws::0",
        "//@tcp/1439000102057800300": "4:64:0:1400:16,0:mss,eol,ws+1::1",
        "//@tcp/14390001020578114": "4:64:0:1400:16,0:mss,nop,nop::1",
        "other": None,
        "": None,
    }
    frame = spark.createDataFrame([(c,) for c in cases], "fp string").select("fp", tcp.raw_signature(tcp.decode("fp")).alias("raw"))
    assert {r.fp: r.raw for r in frame.collect()} == cases


def test_mtu_and_ttl(spark):
    sizes = {1500: "Ethernet or modem (PPPoE)", 1280: "Generic Tunnel Interface (VPN, IPSec, ...)", 1279: "OpenVPN", 7: "Unknown", 16436: "Loopback interface"}
    frame = spark.createDataFrame([(s,) for s in sizes], "m int").select("m", tcp.mtu_type("m").alias("t"))
    assert {r.m: r.t for r in frame.collect()} == sizes
    ttls = spark.createDataFrame([(t,) for t in (0, 32, 33, 57, 116, 128, 129, 255)], "t bigint").select("t", tcp.initial_ttl("t").alias("i"))
    assert [r.i for r in ttls.orderBy("t").collect()] == [32, 32, 64, 64, 128, 128, 255, 255]


def test_decode_columns(spark):
    frame = spark.createDataFrame([("//@tcp/143907210205B4481307+0B",), ("junk",)], "fp string")
    rows = {r.fp: r for r in fingerprint.decode_fingerprints(frame).collect()}
    good = rows["//@tcp/143907210205B4481307+0B"]
    assert (good.distance, good.initial_ttl, good.mtu, good.general_signature) == (7, 64, 1500, "*:64:0:*:20*mss,7:mss,sok,ts,nop,ws:df,id+:0")
    assert rows["junk"].raw_signature is None and rows["junk"].link_type is None


def test_drift_counts_copies(spark):
    old = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "p string")
    new = spark.createDataFrame([("a",), ("c",), (None,)], "p string")
    got = {r.p: (r.status, r.change) for r in diff.drift(old, new, ["p"]).collect()}
    assert got == {"a": ("removed", -1), "b": ("removed", -1), "c": ("added", 1), None: ("unchanged", 0)}
    assert tuple(diff.drift_summary(old, old, ["p"]).first()) == (0, 0, 3, True)
    assert sorted(r.p for r in diff.symmetric_difference(old, new, ["p"]).collect()) == ["b", "c"]


def test_activity(spark):
    day = 86_400_000
    frame = spark.createDataFrame([("a", 0), ("a", 5), ("a", 3 * day), ("b", day), ("c", 0), ("c", 3 * day + 1)], "ip string, ts bigint")
    assert sorted(tuple(r) for r in activity.activity_profile(frame).collect()) == [(1, 0, 1), (2, 2, 2)]
    first = activity.first_row_per(frame, ["ip"], ["ts"], ["ts"])
    assert {r.ip: r.ts for r in first.collect()} == {"a": 0, "b": day, "c": 0}


def test_reputation(spark):
    ips = spark.createDataFrame([("1.2.3.4",), ("5.6.7.8",)], "ip string")
    scans = spark.createDataFrame([("1.2.3.4", "BLACKLISTED 1/40", 1), ("1.2.3.4", "clean", 2)], "ip string, body string, captured_at int")
    threats = spark.createDataFrame([("4.3.2.1", "127.1.1.2")], "reversed_ip string, body string")
    none = spark.createDataFrame([], "ip string, body string")
    out = reputation.consolidate(ips, scans, threats, none, none)
    rows = {r.ip: tuple(r)[1:] for r in out.collect()}
    assert rows == {"1.2.3.4": ("Not Listed", "Harvester", "Not Listed", "Not Listed"), "5.6.7.8": ("Not Listed",) * 4}
    assert reputation.as_result_file(out).columns == list(reputation.RESULT_HEADER)


def test_includes(spark):
    records = spark.createDataFrame(
        [("root.", "v=spf1 include:a.example include:b.example ?all"), ("a.example", "v=spf1 ip4:1.0.0.0/8 ip6:2::/16 ?all"), ("b.example.", "ip4:3.0.0.0/8"), ("c.example", "ip4:4.0.0.0/8")],
        "name string, txt string",
    )
    got = sorted((r.target, r.token) for r in resolve_includes(records, "root.").collect())
    assert got == [("a.example", "ip4:1.0.0.0/8"), ("a.example", "ip6:2::/16"), ("b.example", "ip4:3.0.0.0/8")]


def test_config_documents(spark):
    import json

    blocks = config.score_override(spark.createDataFrame([(250, 260), (255, 257)], "lo bigint, hi bigint")).collect()
    whole = {}
    for r in blocks:
        whole.update(json.loads(r.document))
    assert len(blocks) == 2 and whole == {f"0.0.{n // 256}.{n % 256}": {"Other": 0} for n in range(250, 261)}
    codes = spark.createDataFrame([("1",), ("2",), ("2",)], "code string")
    entries = spark.createDataFrame([(f"10.0.0.{i}",) for i in range(100)] * 2, "entry string")
    rows = config.whitelist(codes, entries, "global", list_entries=10).collect()
    for code in ("1", "2"):
        listed = [e for r in rows if r.code == code for e in json.loads(r.document)["global"][code]]
        assert sorted(listed) == sorted(f"10.0.0.{i}" for i in range(100))
