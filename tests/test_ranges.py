import ipaddress
import random

import pytest

from wardline.operators import ranges
from wardline.plans import cloud


def text(n):
    return str(ipaddress.ip_address(n))


def random_ranges(rng, count):
    out = []
    for _ in range(count):
        width = rng.choice([0, 1, 5, 255, 65535, 70000, 300000])
        lo = rng.choice([rng.randrange(2**24, 2**24 + 400000), 2**24 - 3, 2**24 + 65536 * rng.randrange(6)])
        out.append((lo, lo + rng.randrange(width + 1)))
    return out


def merged(pairs):
    out = []
    for lo, hi in sorted(pairs):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(p) for p in out]


@pytest.mark.parametrize("seed", range(4))
def test_merge(spark, seed):
    pairs = random_ranges(random.Random(seed), 60) + [(0, 3), (4, 9), (2**32 - 2, 2**32 - 1)]
    frame = spark.createDataFrame(pairs, "lo bigint, hi bigint")
    got = sorted((r.lo, r.hi) for r in ranges.merge_ranges(frame).collect())
    assert got == merged(pairs)


def test_merge_everything(spark):
    frame = spark.createDataFrame([(0, 2**31), (2**31 + 1, 2**32 - 1)], "lo bigint, hi bigint")
    assert [tuple(r) for r in ranges.merge_ranges(frame).collect()] == [(0, 2**32 - 1)]


@pytest.mark.parametrize("seed", range(3))
def test_membership(spark, seed):
    rng = random.Random(seed)
    pairs = random_ranges(rng, 30)
    edges = [p for lo, hi in pairs for p in (lo - 1, lo, hi, hi + 1)]
    addresses = [text(n) for n in edges + [rng.randrange(2**24, 2**24 + 500000) for _ in range(300)]]
    rows = [(i, a) for i, a in enumerate(addresses + addresses[:50])] + [(-1, "bad"), (-2, None)]
    frame = spark.createDataFrame(rows, "i int, ip string")
    got = {r.i: r.in_set for r in ranges.membership(frame, spark.createDataFrame(pairs, "lo bigint, hi bigint")).collect()}
    assert len(got) == len(rows)
    for i, a in rows:
        n = int(ipaddress.ip_address(a)) if i >= 0 else None
        assert got[i] == (n is not None and any(lo <= n <= hi for lo, hi in pairs))


def test_membership_without_ranges(spark):
    frame = spark.createDataFrame([("1.1.1.1",)], "ip string")
    none = spark.createDataFrame([], "lo bigint, hi bigint")
    assert [tuple(r) for r in ranges.membership(frame, none, unique=True).collect()] == [("1.1.1.1", False)]


@pytest.mark.parametrize("with_default", [False, True])
def test_longest_prefix(spark, with_default):
    rng = random.Random(7)
    networks = {}
    for _ in range(120):
        length = rng.choice([8, 12, 15, 16, 17, 20, 24, 28, 30, 31, 32])
        base = 2**24 + rng.randrange(300000)
        networks[(base >> (32 - length) << (32 - length), length)] = f"n{len(networks)}"
    if with_default:
        networks[(0, 0)] = "default"
    frame = spark.createDataFrame([(lo, n, name) for (lo, n), name in networks.items()], "lo bigint, prefix_len int, name string")
    points = [lo for lo, _ in networks] + [rng.randrange(2**24 - 100, 2**24 + 310000) for _ in range(400)] + [2**32 - 1]
    facts = spark.createDataFrame([(i, text(p)) for i, p in enumerate(points)] + [(-1, None), (-2, "x")], "i int, ip string")

    def best(p):
        fits = [(n, name) for (lo, n), name in networks.items() if lo <= p < lo + 2 ** (32 - n)]
        return max(fits)[1] if fits else None

    got = {r.i: r.name for r in ranges.enrich(facts, frame).collect()}
    assert got == {**{i: best(p) for i, p in enumerate(points)}, -1: None, -2: None}


def test_expand_wide(spark):
    frame = spark.createDataFrame([(1, 2**24 + 65000, 2**24 + 65536 * 3 + 5), (2, 7, 7), (3, 9, 8)], "id int, lo bigint, hi bigint")
    got = ranges.expand(frame).groupBy("id").agg({"address": "count"}).collect()
    assert {r[0]: r[1] for r in got} == {1: 65536 * 3 + 5 - 65000 + 1, 2: 1}


def test_blocks_expand_back(spark):
    pairs = [(i, lo, hi) for i, (lo, hi) in enumerate(random_ranges(random.Random(3), 20))]
    frame = spark.createDataFrame(pairs, "id int, lo bigint, hi bigint")
    back = ranges.cidr_blocks(frame).selectExpr("id", "network AS lo", "network + shiftleft(1L, 32 - prefix_len) - 1 AS hi")
    got = {r.id: (r.n, r.d, r.a, r.b) for r in ranges.expand(back).groupBy("id").agg(
        *[__import__("pyspark.sql.functions", fromlist=["x"]).expr(e) for e in
          ("count(address) AS n", "count(DISTINCT address) AS d", "min(address) AS a", "max(address) AS b")]).collect()}
    assert got == {i: (hi - lo + 1, hi - lo + 1, lo, hi) for i, lo, hi in pairs}


def test_cloud_labels(spark):
    entries = spark.createDataFrame([("10.0.0.0/30",), ("9.9.9.9",), ("8.8.8.1-3",), ("junk",)], "value string")
    addresses = spark.createDataFrame([("10.0.0.3",), ("10.0.0.4",), ("9.9.9.9",), ("8.8.8.2",), ("8.8.8.2",)], "ip string")
    got = sorted((r.ip, r.label) for r in cloud.cloud_membership(addresses, entries).collect())
    assert got == [("10.0.0.3", "IN"), ("10.0.0.4", "NOT IN"), ("8.8.8.2", "IN"), ("8.8.8.2", "IN"), ("9.9.9.9", "IN")]
