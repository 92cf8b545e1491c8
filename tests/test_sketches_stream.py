"""Stored sketches and the stream's exact hourly counts."""

import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import sketches
from wardline.plans.login import login_counts
from wardline.streaming.metrics import HourlyCounts

HOUR = sketches.HOUR_MS


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, *map(str, range(4000))]), rng.randrange(60 * HOUR)) for _ in range(30_000)]
    return spark.createDataFrame([*rows, ("c", None, 5)], "kind string, client string, ts long")


def test_windows_from_stored_sketches(spark, events, tmp_path):
    path = str(tmp_path / "store")
    first, second = events.where("ts < 100000000"), events.where("ts >= 100000000")
    for load_id, part in (("a/1 %", first), ("b", events), ("b", second), ("a/1 %", first)):
        sketches.store_sketches(sketches.hourly_sketches(part, ["kind"], "client"), path, load_id)
    kept = sketches.read_sketches(spark, path, "kind string")
    for window in ((0, 60 * HOUR), (3 * HOUR, 4 * HOUR), (20 * HOUR, 50 * HOUR), (70 * HOUR, 80 * HOUR)):
        inside = events.where((F.col("ts") >= window[0]) & (F.col("ts") < window[1]))
        for keys in (["kind"], []):
            exact = {tuple(r[k] for k in keys): (r.n, r.u) for r in inside.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("client").alias("u")).collect()}
            got = {tuple(r[k] for k in keys): (r.n, r.about) for r in sketches.window_counts(kept, window, keys).collect()}
            if keys or exact != {(): (0, 0)}:
                assert set(got) == set(exact)
            for key, (n, users) in got.items():
                if n is not None:
                    assert n == exact[key][0] and abs(users - exact[key][1]) <= 0.03 * exact[key][1]
    whole = sketches.compact(kept)
    assert whole.count() == kept.select("kind", "hour").distinct().count() and whole.agg(F.sum("n")).first()[0] == events.count()
    with pytest.raises(ValueError):
        sketches.stored_window(kept, (1, HOUR))


def test_windows_read_their_days_only(spark, events, tmp_path):
    path = str(tmp_path / "store")
    sketches.store_sketches(sketches.hourly_sketches(events, ["kind"], "client"), path, "a")
    kept = sketches.read_sketches(spark, path, "kind string")
    plan = sketches.window_counts(kept, (25 * HOUR, 26 * HOUR), ["kind"])._jdf.queryExecution().executedPlan().toString()
    assert "day#" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_approximate_logins(spark):
    rows = [(f"ip{k % 3}", f"h{k % 50}", f"m{k}", k) for k in range(9000)] + [(None, "h", "m", 1), ("ip9", None, None, 1)]
    logins = spark.createDataFrame(rows, "ip string, host string, email_hash string, ts long")
    exact = {r.ip: r for r in login_counts(logins).collect()}
    for r in login_counts(logins, approximate=True).collect():
        for name in ("count_hosts", "count_emails"):
            assert abs(r[name] - exact[r.ip][name]) <= 0.03 * exact[r.ip][name]


def scores(spark, rows):
    frame = spark.createDataFrame(rows, "heuristic_name string, client_id string, s long, group_ids string")
    return frame.withColumn("at", F.timestamp_seconds("s")).drop("s")


def points(counts, spark):
    return {(r.path, r.ts): r.count_ips for r in counts.points(spark).collect()}


def test_batches_run_again_and_late_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("xy"), rng.choice([None, *map(str, range(40))]), rng.randrange(5 * 3600), rng.choice(["production", "lab"])) for _ in range(900)]
    rows.append(("x", "1", None, "production"))
    counts = HourlyCounts(str(tmp_path / "points"), "dc")
    assert points(counts, spark) == {}
    cuts = [rows[:300], rows[300:600], rows[600:]]  # every batch has rows of all hours: all but the first come late
    for batch, again in ((0, False), (1, True), (2, False)):
        counts.add(scores(spark, cuts[batch]), batch)
        if again:
            counts.add(scores(spark, cuts[batch]), batch)
    counts.add(scores(spark, cuts[0]), 3)  # a source that repeats itself
    want = {}
    for name, client, s, group in rows:
        if group == "production" and s is not None:
            want.setdefault((f"heuristics.{name}.dc", s // 3600 * 3600), set()).add(client)
    assert points(counts, spark) == {k: len(v - {None}) for k, v in want.items()}


def test_stream_that_fails_and_starts_again(spark, tmp_path):
    folder, state, source = str(tmp_path / "points"), str(tmp_path / "state"), tmp_path / "in"
    rows = [("x", str(k % 70), k * 60, "production") for k in range(300)]
    for k in range(3):
        scores(spark, rows[k * 100 : k * 100 + 100]).coalesce(1).write.parquet(str(source / f"f{k}"))
    schema = "heuristic_name string, client_id string, group_ids string, at timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))

    class Failing(HourlyCounts):
        def add(self, rows, batch):
            super().add(rows, batch)
            if batch == 1:
                raise RuntimeError("lost after writing")

    with pytest.raises(Exception, match="lost after writing"):
        Failing(folder, "dc").start(stream, state).awaitTermination()
    counts = HourlyCounts(folder, "dc")
    counts.start(stream, state).awaitTermination()
    want = {}
    for name, client, s, _ in rows:
        want.setdefault((f"heuristics.{name}.dc", s // 3600 * 3600), set()).add(client)
    assert points(counts, spark) == {k: len(v) for k, v in want.items()}
