import ipaddress
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline.functions import ip as ipf

ADDRESS = st.integers(0, 2**32 - 1)


def covers(spark, pairs):
    frame = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(pairs)], "i int, lo bigint, hi bigint")
    rows = frame.select("i", ipf.cidr_cover("lo", "hi").alias("c")).collect()
    return {r.i: [(b.network, b.prefix_len) for b in r.c] for r in rows}


def expected(lo, hi):
    blocks = ipaddress.summarize_address_range(ipaddress.ip_address(lo), ipaddress.ip_address(hi))
    return [(int(b.network_address), b.prefixlen) for b in blocks]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(ADDRESS, ADDRESS), min_size=1, max_size=40))
def test_cover_is_the_smallest(spark, pairs):
    pairs = [(min(p), max(p)) for p in pairs]
    got = covers(spark, pairs)
    for i, (lo, hi) in enumerate(pairs):
        assert got[i] == expected(lo, hi)


def test_cover_edges(spark):
    top = 2**32 - 1
    pairs = [(0, top), (1, top - 1), (0, 0), (top, top), (167772161, 167772166), (0, 2**31), (2**31 - 1, 2**31)]
    got = covers(spark, pairs)
    for i, pair in enumerate(pairs):
        assert got[i] == expected(*pair)
    assert len(got[1]) == 62


def test_numbers_round_trip(spark):
    numbers = [0, 1, 2**32 - 1, 167772161] + [random.Random(1).randrange(2**32) for _ in range(200)]
    frame = spark.createDataFrame([(n, str(ipaddress.ip_address(n)), bytes(n.to_bytes(4, "big"))) for n in numbers], "n bigint, t string, b binary")
    rows = frame.select(
        "n", "t", ipf.ip_to_long("t").alias("n2"), ipf.long_to_ip("n").alias("t2"), ipf.binary_to_ip("b").alias("t3")
    ).collect()
    assert all(r.n == r.n2 and r.t == r.t2 == r.t3 for r in rows)


def test_validity(spark):
    texts = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "1", "", "1.2.3.4.5", "::1", "1.2.3.4 ", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", ipf.is_ipv4("t").alias("v"), ipf.is_address("t").alias("a"), ipf.ip_to_long("t").alias("n")).collect()
    assert [r.t for r in rows if r.v] == ["1.2.3.4"]
    assert [r.t for r in rows if r.a] == ["1.2.3.4", "::1"]
    assert [r.n for r in rows if r.n is not None] == [16909060]


def test_bounds(spark):
    cases = {
        "1.1.1.1-10": ("1.1.1.1", "1.1.1.10"),
        "1.1.1.10-1": ("1.1.1.1", "1.1.1.10"),
        "1.1.1.9-1.1.2.2": ("1.1.1.9", "1.1.2.2"),
        "1.1.1.1–3": ("1.1.1.1", "1.1.1.3"),
        "(10.0.0.0/8),": ("10.0.0.0", "10.255.255.255"),
        "10.0.0.7/30": ("10.0.0.4", "10.0.0.7"),
        "0.0.0.0/0": ("0.0.0.0", "255.255.255.255"),
        "'10.0.0.5'": ("10.0.0.5", "10.0.0.5"),
        "[9.9.9.9/32]": ("9.9.9.9", "9.9.9.9"),
        "10.0.0.0/33": None,
        "10.0.0.0/x": None,
        "10.0.0.1-300": None,
        "-": None,
        "": None,
        "a.b": None,
    }
    frame = spark.createDataFrame([(t,) for t in cases], "t string").select("t", ipf.address_bounds("t").alias("b"))
    got = frame.select("t", ipf.long_to_ip(F.col("b.lo")).alias("lo"), ipf.long_to_ip(F.col("b.hi")).alias("hi")).collect()
    assert {r.t: (r.lo, r.hi) if r.lo else None for r in got} == cases


def test_reverse(spark):
    row = spark.range(1).select(ipf.reverse_octets(F.lit("1.2.3.4")).alias("r")).first()
    assert row.r == "4.3.2.1"
