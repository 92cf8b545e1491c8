"""Readers, row numbers, inference, typed load and writers on small files."""

import gzip
import io
import os
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from wardline.operators import infer, rows
from wardline.plans.load import load_tsv, typed_lines
from wardline.plans.logs import LOG_FIELDS, categorise_rules, parse_access_log, select_log_fields
from wardline.sources import readers, writers


def write(path, content, mode="w"):
    path.parent.mkdir(exist_ok=True)
    with open(path, mode) as f:
        f.write(content)
    return str(path)


def test_numbered_lines(spark, tmp_path):
    for name, count in (("a.txt", 5000), ("b.txt", 1), ("c.txt", 333)):
        write(tmp_path / name, "".join(f"{name} {i}\n" for i in range(1, count + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        frame = rows.read_numbered_lines(spark, str(tmp_path))
        assert frame.rdd.getNumPartitions() > 5
        got = frame.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5334
    assert all(r.line == f"{os.path.basename(r.path)} {r.line_no}" for r in got)
    assert [r.row_no for r in sorted(got, key=lambda r: (r.path, r.line_no))] == list(range(1, 5335))


@pytest.mark.parametrize("bits", [12, 20])
def test_number_rows(spark, bits):
    rng = random.Random(bits)
    keys = [-5, 0, 7, 9, 100, 10**9, 2**63 - 1, -(2**63)] + [rng.randrange(-(2**62), 2**62) for _ in range(300)]
    keys += range(5000, 6000)
    frame = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(3)
    got = {r.k: r.row_no for r in rows.number_rows(frame, "k", bits=bits).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys), start=1)}


@pytest.mark.parametrize("lines, last", [(16, 8), (17, 9), (4, 4), (800, 8)])
def test_split_counts(spark, lines, last):
    frame = spark.range(lines - 1)
    got = {r.part: r["count"] for r in rows.split_rows(frame, "id").groupBy("part").count().collect()}
    size = max(lines // 8, 1)
    # The first file has one data line less, so none at all when the size is 1.
    assert max(got) == last and got.get(1, 0) == size - 1
    assert all(got[part] == size for part in range(2, last))


def test_write_split(spark, tmp_path):
    frame = spark.range(40).withColumn("v", F.concat(F.lit("v"), "id"))
    writers.write_split(frame, "id", str(tmp_path / "out"))
    first = spark.read.csv(str(tmp_path / "out" / "part=1"), sep="\t", header=True).collect()
    assert [r.id for r in first] == ["0", "1", "2", "3"] and first[0].v == "v0"
    assert len(list((tmp_path / "out").glob("part=*"))) == 9
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).count() == 40


def test_line_readers(spark, tmp_path):
    path = write(tmp_path / "l.txt", "1.1.1.1  \n2.2.2.2\t\n\n")
    assert [r.value for r in readers.read_lines(spark, path).collect()] == ["1.1.1.1", "2.2.2.2", ""]
    noise = "\n".join([*readers.NOISE_MESSAGES, "a\tb", "plain", "x " + readers.NOISE_MESSAGES[0]])
    lines = spark.read.text(write(tmp_path / "n.txt", noise))
    assert [r.value for r in readers.drop_noise(lines).collect()] == ["a\tb", "plain"]
    assert [r.value for r in readers.keep_tabbed(lines).collect()] == ["a\tb"]


def test_tsv_readers(spark, tmp_path):
    path = write(tmp_path / "t.tsv", 'a\tb\n"x\ty"\t"q""r"\n1\t2\n')
    assert [tuple(r) for r in readers.read_tsv(spark, path).collect()] == [("x\ty", 'q"r'), ("1", "2")]
    raw = write(tmp_path / "r.tsv", 'a\tb\n5" disk\tz\n')
    assert [tuple(r) for r in readers.read_tsv(spark, raw, quoted=False).collect()] == [('5" disk', "z")]


def test_json_documents(spark, tmp_path):
    doc = '{"prefixes": [\n{"service": "EC2", "ip_prefix": "1.0.0.0/8"}, {"service": "S3", "ip_prefix": "2.0.0.0/8"}]}'
    frame = readers.read_documents(spark, write(tmp_path / "d.json", doc))
    assert [r.prefix for r in readers.cloud_prefixes(frame).collect()] == ["1.0.0.0/8"]
    assert readers.cloud_prefixes(frame, service=None).count() == 2
    listed = spark.createDataFrame([('{"list": ["1.0.0.0/8", "3.0.0.0/8"]}',)], "value string")
    assert readers.published_prefixes(listed).count() == 2


def test_archives(spark, tmp_path):
    body = "".join(f"line {i}\n" for i in range(25_000)).encode()
    for name, mode in (("a.tar", "w"), ("b.tgz", "w:gz"), ("c.gz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as tar:
            for member, data in (("readme.txt", b"no"), ("ips.db.txt", body), ("later.db", b"no")):
                info = tarfile.TarInfo(member)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    with gzip.open(tmp_path / "plain.gz", "wb") as f:
        f.write(b"one\ntwo")
    got = readers.read_archive_lines(spark, str(tmp_path)).groupBy("path").agg(
        F.count("*").alias("n"), F.max("line_no").alias("m"), F.max_by("line", "line_no").alias("last")
    )
    found = {os.path.basename(r.path): (r.n, r.m, r.last) for r in got.collect()}
    whole = (25_000, 25_000, "line 24999")
    assert found == {"a.tar": whole, "b.tgz": whole, "c.gz": whole, "plain.gz": (2, 2, "two")}
    assert readers.is_archive("x.tgz") and not readers.is_archive("x.txt")


def test_read_table(spark):
    spark.range(3).withColumn("b", F.lit(1)).createOrReplaceTempView("some_rows")
    assert readers.read_table(spark, "some_rows", ["id"]).columns == ["id"]


VOTES = [
    (["1", "2", "2.5"], "int"),
    (["1", "3000000000"], "bigint"),
    (["1.5", "2.5", "3000000000"], "bigint"),
    (["1", "x"], "text"),
    (["1", "2.5"], "int"),
    (["2.5", "1"], "double"),
    (["", "1", "1"], "text"),
    (["2020-01-01", "2020-01-01 00:00:00", "2020-01-02"], "date"),
]


@pytest.mark.parametrize("values, winner", VOTES)
def test_votes(spark, values, winner):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "at int, c string").repartition(3)
    assert infer.infer_types(frame, ["C"], ["c"], "at") == [winner]


def test_votes_of_equal_names_merge(spark):
    frame = spark.createDataFrame([(1, "1", "x")], "at int, a string, b string")
    assert infer.infer_types(frame, ["n", "n"], ["a", "b"], "at") == ["text", "text"]
    with pytest.raises(ValueError):
        infer.infer_types(frame.limit(0), ["n"], ["a"], "at")


def test_typed_lines(spark):
    lines = ["1\t2.5\tx", "2\tbad", "3\t1\t\"a\tb\"", "4\t7\ty\tz", "5\t\t"]
    frame = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    typed, rejected, types = typed_lines(frame, ["A b", "c!", "d"], "n")
    assert types == ["int", "text", "text"]
    assert [tuple(r) for r in typed.orderBy("n").collect()] == [(0, 1, "2.5", "x"), (2, 3, "1", "a\tb"), (4, 5, "", "")]
    assert typed.columns == ["n", "a_b", "c", "d"]
    assert sorted(r.line for r in rejected.collect()) == ["2\tbad", "4\t7\ty\tz"]


def test_load_and_conflicts(spark, tmp_path):
    path = write(tmp_path / "in.tsv", "Key\tValue\n5\t1.5\n6\t2.5\nbroken\n7\t3.5\n")
    spark.sql("DROP TABLE IF EXISTS loaded")
    assert load_tsv(spark, path, "loaded") == "loaded"
    assert [tuple(r) for r in spark.table("loaded").orderBy("id").collect()] == [(1, 5, 1.5), (2, 6, 2.5), (3, 7, 3.5)]
    with pytest.raises(ValueError):
        load_tsv(spark, path, "loaded")
    load_tsv(spark, path, "loaded", "append")
    assert sorted(r.id for r in spark.table("loaded").collect()) == [1, 2, 3, 4, 5, 6]
    renamed = write(tmp_path / "renamed.tsv", "Name\tValue\n5\t1.5\n")
    with pytest.raises(ValueError, match="column names"):
        load_tsv(spark, renamed, "loaded", "append")
    assert load_tsv(spark, path, "loaded", "rename", "loaded_two") == "loaded_two"
    other = write(tmp_path / "other.tsv", "Key\tValue\na\tb\n")
    with pytest.raises(ValueError):
        load_tsv(spark, other, "loaded", "append")
    load_tsv(spark, other, "loaded", "overwrite")
    assert [tuple(r) for r in spark.table("loaded").collect()] == [(1, "a", "b")]
    write(tmp_path / "two" / "b.tsv", "Key\tValue\n3\t3\n")
    write(tmp_path / "two" / "a.tsv", "Key\tValue\n1\t1\n2\t2\n")
    load_tsv(spark, str(tmp_path / "two"), "loaded", "overwrite")
    assert [tuple(r) for r in spark.table("loaded").orderBy("id").collect()] == [(1, 1, 1), (2, 2, 2), (3, 3, 3)]
    write(tmp_path / "two" / "c.tsv", "4\t4\n5\t5\n")
    with pytest.raises(ValueError, match="different headers"):
        load_tsv(spark, str(tmp_path / "two"), "loaded", "overwrite")
    for name in ("loaded", "loaded_two"):
        writers.drop_table(spark.range(1), name)
        assert not spark.catalog.tableExists(name)


def test_layouts(spark):
    a = infer.loader_schema(["x", "y"], ["int", "text"])
    b = infer.loader_schema(["p", "q"], ["int", "text"])
    assert infer.same_layout(a, b) and not infer.same_layout(a, infer.loader_schema(["x", "y"], ["int", "date"]))
    assert infer.table_ddl("t", ["X y"], ["datetime"]) == "CREATE TABLE IF NOT EXISTS t (id BIGINT NOT NULL, x_y timestamp) USING parquet"
    assert [tuple(r) for r in infer.layout_rows(spark, a).collect()] == [(1, "int"), (2, "string")]


def test_quoted_sink(spark, tmp_path):
    frame = spark.createDataFrame([('a"b', "c\td", None)], "x string, y string, z string")
    writers.write_quoted_tsv(frame.coalesce(1), str(tmp_path / "q"))
    part = next((tmp_path / "q").glob("part-*")).read_text()
    assert part.splitlines() == ['"x"\t"y"\t"z"', '"a\\"b"\t"c\td"\t""']


def test_metric_and_tsv_sinks(spark, tmp_path):
    points = spark.createDataFrame([("heuristics.a.dc", 3, "1700000000"), ("other", 1, "1")], "path string, n int, ts string")
    writers.write_metrics(points, str(tmp_path / "m"), "heuristics")
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["heuristics.a.dc 3 1700000000"]
    writers.write_tsv(points, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 2
    assert writers.tag_rows(points, "run1").filter("query_file = 'run1'").count() == 2


def log_line(position_values):
    return " ".join(position_values.get(i, "-") for i in range(1, 75))


def test_access_log(spark, tmp_path):
    line = log_line({2: "123", 10: "1.1.1.1", 12: "/a%20b+c", 20: '"Mozilla 5"', 73: "end", 74: "ignored"})
    frame = spark.createDataFrame([(1, line)], "n int, line string")
    row = parse_access_log(frame).first()
    assert (row["TimeStamp"], row["ARL"], row["User Agent"], row["QuickRetry Information"]) == ("123", "/a b+c", "Mozilla 5", "end")
    assert parse_access_log(frame).columns == ["n", *LOG_FIELDS.values()] and len(LOG_FIELDS) == 24
    from_file = select_log_fields(readers.read_space_log(spark, write(tmp_path / "a.log", line + "\n")))
    assert tuple(from_file.first()) == tuple(row)[1:]


def test_rule_categories(spark):
    frame = spark.createDataFrame([("a", "2005"), ("b", "9999"), ("c", "1000")], "x string, rule string")
    assert sorted(tuple(r) for r in categorise_rules(frame, 1).collect()) == [("a", "2005", "RFIi"), ("c", "1000", "SQLi")]
