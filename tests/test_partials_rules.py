"""Counts kept per file, tables laid out by hour, and rule indexes."""

import re

import pytest
from pyspark.sql import functions as F

from wardline.operators import partials, rules
from wardline.sources import partitioned


def test_only_new_files_are_read(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    opened = []

    def read(names):
        opened.append(sorted(n.rsplit("/")[-1] for n in names))
        return spark.read.schema("value string").text(names)

    def put(name, text):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text)

    def total():
        return {r.key: r.n for r in partials.total_counts(spark, store).collect()}

    put("a", "x\ny\nx\n")
    put("b", "y\n")
    update = lambda fn=read: partials.update_counts(spark, folder, store, "value", fn)
    assert total() == {} and len(update()) == 2 and total() == {"x": 2, "y": 2}
    assert update() == [] and opened == [["a", "b"]]
    put("c", "z\n")
    put("a", "x\nnew and longer\n")  # changed: counted again, and its old counts go
    assert len(update()) == 2 and opened[-1] == ["a", "c"]
    assert total() == {"x": 1, "new and longer": 1, "y": 1, "z": 1}
    put("d", "w\n")
    with pytest.raises(ZeroDivisionError):
        update(lambda names: 1 / 0)
    # Counts of a run that failed before its list was written do not count.
    spark.createDataFrame([("p", "lost", 9)], "path string, key string, n long").write.parquet(f"{store}/counts/run=3")
    assert "lost" not in total()
    assert len(update()) == 1 and total() == {"x": 1, "new and longer": 1, "y": 1, "z": 1, "w": 1}


@pytest.mark.parametrize("width", [1, 6])
def test_hours_prune_folders(spark, tmp_path, width):
    hour = partitioned.HOUR_MS
    rows = spark.range(2000).select("id", (F.col("id") * 60_000 - 3 * hour).alias("ts"))
    path = str(tmp_path / "t")
    partitioned.write_by_hour(rows, path, width=width)
    table = partitioned.read_by_hour(spark, path, "id long, ts long")
    assert sorted(r.id for r in partitioned.in_window(table, (-hour, 26 * hour + 5), "ts", width).collect()) == list(range(120, 29 * 60 + 1))
    hours = spark.createDataFrame([(-2 * hour,), (4 * hour,), (4 * hour,), (900 * hour,)], "hour long")
    found = partitioned.in_hours(table, hours, width=width)
    assert found.columns == ["id", "ts"]
    assert sorted(r.id for r in found.collect()) == [*range(60, 120), *range(420, 480)]
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: [^\n]*dynamicpruning", plan), plan


def test_rules_equal_trying_all(spark):
    table = [
        rules.Rule("bot", "(?i)(bot)/9", "late bot"), *rules.product_rules(["Chrome", "Safari", "curl"]), rules.Rule("", "^(.)$", "one"),
        rules.Rule("bot", "(?i)([a-z]*bot)", "bot"),
    ]
    texts = ["Mozilla/5.0 Chrome/96.1 Safari/537.36", "curl/7.1", "xChrome/1", "Chrome", "a", "", "é", "GOOGLE BOT/9", "some-bot", None, "Safari/12 Chrome/1234", "curl/7.1"]

    def first(text):
        for n, rule in enumerate(table, 1):
            if found := re.search(rule.pattern, text):
                return n, rule.label, found[1] or None
        return None, None, None

    frame = spark.createDataFrame([(t, "x") for t in texts], "agent string, text string").withColumn("label", F.lit(1))
    found = rules.first_rules(frame, rules.rule_table(spark, table), "agent").collect()
    assert {(r.text, r.rule_no, r.label, r.part) for r in found} == {(t, *first(t)) for t in texts if t is not None}
    labelled = rules.with_first_rule(frame, rules.rule_table(spark, table), "agent", "kind")
    assert sorted((r.agent or "", r.kind or "") for r in labelled.collect()) == sorted((t or "", "" if t is None else first(t)[1] or "Other") for t in texts)
    assert len(rules.product_rules()) > 300
    with pytest.raises(ValueError):
        rules.Rule("Upper", "x", "y")
