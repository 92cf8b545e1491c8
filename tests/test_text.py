import random

from pyspark.sql import functions as F

from wardline.functions import classify, feeds, text
from wardline.functions.jsonqa import inspect_document, json_report
from wardline.functions.useragent import parsed_columns
from wardline.operators import search


def column(spark, values, expr, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = frame.select("i", expr(F.col("v")).alias("out")).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.i)]


def test_url_unquote(spark):
    values = ["a+b%20c", "100%zz", "%2B", "%C3%A9", "%", "", None]
    assert column(spark, values, text.url_unquote) == ["a+b c", "100%zz", "+", "é", "%", "", None]


def test_names(spark):
    names = ["C-d! x", "__A  b__", "Total Price!", "ok"]
    want = ["c_d_x", "a_b", "total_price", "ok"]
    assert [text.safe_name(n) for n in names] == want
    assert column(spark, names, text.safe_name_column) == want
    assert column(spark, ["a;b;c", "abc"], text.heuristic_base_name) == ["a", "abc"]
    assert column(spark, ["a;b;c", "abc"], lambda c: text.heuristic_base_name(c, strict=True)) == ["a", "ab"]


def test_packed_lists(spark):
    values = ["[a,b]", "[ 'a', \"b\" ]", "[]", None]
    assert column(spark, values, text.bracket_list) == [["a", "b"], ["a", "b"], [""], None]
    packed = ["[{u'heuristic_name': u'h;v', 'category': 'c', 'hosts': ['a', 'b']}]", '[{"heuristic_name": "x"}]', "bad", "[]"]
    got = column(spark, packed, text.parse_evidences)
    assert (got[0][0].heuristic_name, got[0][0].category, got[0][0].hosts) == ("h;v", "c", ["a", "b"])
    assert got[1][0].heuristic_name == "x" and got[2] is None and got[3] == []


TYPES = {
    "5": "int", " 5 ": "int", "+7": "int", "-2147483647": "int", "-2147483648": "bigint", "2147483648": "bigint",
    "9" * 40: "bigint", "1.5": "double", ".5": "double", "5.": "double", "1e5": "double", "nan": "double", "-Inf": "double",
    "1d": "text", "0x1": "text", "": "text", "1,5": "text", "2016-01-02": "date", "2016-1-2": "date", "2016-02-30": "text",
    "2016-01-02 03:04:05": "datetime", "2016-01-02 03:04:05.123456": "datetime", "2016-02-30 03:04:05": "text",
    "2016-01-02T03:04:05": "text", "23:59:59": "time", "24:00:00": "text", "23:59:61": "time",
}


def test_value_types(spark):
    values = list(TYPES)
    assert column(spark, values, text.value_type) == list(TYPES.values())
    # A value always fits its own type, save numbers beyond 64 bits.
    for kind in ("int", "double", "datetime", "date"):
        own = [v for v in values if TYPES[v] == kind]
        assert None not in column(spark, own, lambda c, k=kind: text.typed_value(c, k))
    assert column(spark, ["9" * 40, "2147483648"], lambda c: text.typed_value(c, "bigint")) == [None, 2147483648]
    assert column(spark, ["23:59:59", "x"], lambda c: text.typed_value(c, "datetime")) == [None, None]


def test_in_list():
    assert text.in_list_text(["a", "b'c"]) == "('a','b''c')"


def test_nat_guess(spark):
    counts = [0, 9, 10, 30, 31, 100, 101, 150, 151]
    got = column(spark, counts, classify.nat_size_guess, "int")
    c = classify
    assert got == [c.NAT_NOT_SHARED] * 2 + [c.NAT_SMALL] * 2 + [c.NAT_MEDIUM] * 2 + [c.NAT_LARGE] * 2 + [c.NAT_UNDECIDED]


def test_rules_and_threats(spark):
    assert column(spark, ["2005", "9999", "6003", None], classify.rule_category) == ["RFIi", None, "LFI", None]
    assert column(spark, ["127.1.2.5", "127.1.2.9"], classify.threat_label) == ["Suspicious Comment Spammer", None]


def test_feed_fields(spark):
    assert column(spark, ["x BLACKLISTED 3/40 y", "clean", None], feeds.scan_result) == ["BLACKLISTED 3/40", "Not Listed", "Not Listed"]
    bodies = ['{"Categories":["ssh","x"],"y":[]}', "{}"]
    assert column(spark, bodies, feeds.category_result) == ['Threat Categories":["ssh","x"]', "Not Listed"]
    spam = "<appears>yes</appears><frequency>7</frequency><lastseen>2020-01-01</lastseen>"
    assert column(spark, [spam, spam.replace("yes", "no"), "<appears>yes</appears><frequency>7"], feeds.spam_result) == [
        "Listed (Frequency: 7, Last Seen: 2020-01-01)", "Not Listed", "Listed (Frequency: 7)",
    ]


JSON_CASES = [
    ('{"a":1}', True, [], []),
    ('{"a":1,"a":2}', True, ["a"], []),
    ('{"l":[1,1]}', True, [], [("l", "1")]),
    ('{"o":{"l":["x","x"]}}', True, [], [("o.l", "x")]),
    ('{"l":[{"m":[1,1]}]}', True, [], []),
    ('{"l":[{"m":1,"m":2}]}', True, ["m"], []),
    ("{bad", False, [], []),
    ('{"a":1} x', False, [], []),
    ('{"a":"}","a":1}', True, ["a"], []),
    ("[1,1]", True, [], []),
    ("", False, [], []),
]


def test_json_report(spark):
    got = column(spark, [c[0] for c in JSON_CASES] + [None], json_report)
    for case, r in zip(JSON_CASES, got):
        assert (r.valid, r.duplicate_keys, [(v.path, v.value) for v in r.duplicate_values]) == case[1:], case
        assert inspect_document(case[0])["valid"] == case[1]
    assert got[-1] is None


def test_agents(spark):
    agents = {
        "Mozilla/5.0 (iPad; CPU OS 12_2 like Mac OS X) AppleWebKit/605 (KHTML) CriOS/90.0.1.2 Mobile/15E148 Safari/604.1": ("iOS", "iPad", "Chrome Mobile iOS", "90.0.1"),
        "Mozilla/5.0 (Windows NT 6.1; Trident/7.0; rv:11.0) like Gecko": ("Windows", "Other", "IE", "11.0"),
        "Mozilla/5.0 (Linux; U; Android 4.0; en-us; GT-I9100 Build/IML74K) AppleWebKit/534 Version/4.0 Mobile Safari/534": ("Android", "GT-I9100", "Android", "4.0"),
        "Mozilla/5.0 (compatible; SomeBot/2.1)": ("Other", "Spider", "Other", ""),
        "Mozilla/5.0 (Windows NT 10.0) Chrome/90.0.1.1 Safari/537 Edg/91.2": ("Windows", "Other", "Edge", "91.2"),
    }
    frame = spark.createDataFrame([(a,) for a in agents] + [(None,)], "ua string")
    rows = frame.select("ua", *parsed_columns("ua")).collect()
    got = {r.ua: (r.os, r.device, r.browser, r.browser_version) for r in rows}
    assert got == {**agents, None: ("Other", "Other", "Other", "")}


def test_search_is_plain_containment(spark):
    rng = random.Random(5)
    pieces = ["1.1.1.1", "11.1.1.10", "x", " ", ".", "1", "10.0.0.255", "1.2.3.4.5", "999.1.1.1", "\n"]
    lines = ["".join(rng.choice(pieces) for _ in range(6)) for _ in range(150)]
    wanted = ["1.1.1.1", "1.1.1.10", "11.1.1.1", "0.0.0.2", "10.0.0.25", "2.3.4.5", "1.2.3.4", "99.1.1.1", "8.8.8.8"]
    frame = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    ips = spark.createDataFrame([(w,) for w in wanted], "ip string")
    got = sorted((r.n, r.ip) for r in search.search_lines(frame, ips, ["n"]).collect())
    assert got == sorted((n, w) for n, line in enumerate(lines) for w in wanted if w in line)
    shown = search.with_lines(search.search_lines(frame, ips, ["n"]), frame, ["n"]).collect()
    assert len(shown) == len(got) and all(r.ip in r.line for r in shown)


def test_search_whole_tokens(spark):
    frame = spark.createDataFrame([(1, "11.1.1.1"), (2, "(1.1.1.1)."), (3, "1.1.1.1.5"), (4, "1.1.1.1 1.1.1.1")], "n int, line string")
    ips = spark.createDataFrame([("1.1.1.1",)], "ip string")
    assert sorted(r.n for r in search.search_lines(frame, ips, ["n"], whole=True).collect()) == [2, 4]


def test_keep_listed(spark):
    frame = spark.range(3000).withColumn("k", F.col("id").cast("string"))
    assert search.keep_listed(frame, "k", ["1", "x", "2999"]).count() == 2
    assert search.keep_listed(frame, "k", [str(i) for i in range(0, 4000, 2)]).count() == 1500
    for small in (None, True, False):
        assert search.keep_listed(frame, "id", frame.filter("id < 7").select("id"), small).count() == 7
    assert search.fits_in_tasks(frame, 3000) and not search.fits_in_tasks(frame, 2999)
    assert not search.fits_in_tasks(frame, 3000, size=100)
    assert search.fits_in_tasks(frame.limit(0)) and search.fits_in_tasks(frame.selectExpr("CAST(NULL AS STRING) AS `a.b`"), 3000, size=0)
