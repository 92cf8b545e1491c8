"""Tables keep their rows through failed and repeated loads."""

import uuid

import pytest
from pyspark.sql import functions as F

from wardline.plans.load import load_tsv
from wardline.sources import tables
from wardline.sources.writers import drop_table, save_table


@pytest.fixture
def name(spark):
    table = f"t_{uuid.uuid4().hex[:8]}"
    yield table
    for t in spark.catalog.listTables():
        if t.name.startswith(table):
            tables.drop(spark, t.name)


def ids(spark, table):
    return sorted(r[0] for r in spark.table(table).select("id").collect())


def left(spark, table):
    return [t.name for t in spark.catalog.listTables() if t.name.startswith(table) and t.name != table]


def failing(spark):
    return spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))


def test_replace(spark, name):
    tables.create(spark.range(3).toDF("id"), name)
    with pytest.raises(tables.LoadError):
        tables.create(spark.range(1).toDF("id"), name)
    with pytest.raises(Exception, match="broken"):
        tables.replace(failing(spark), name)
    assert ids(spark, name) == [0, 1, 2] and left(spark, name) == []
    with pytest.raises(tables.LoadError):
        tables.replace(spark.range(2).selectExpr("cast(id AS string) AS id"), name, same=True)
    # The new rows may come from the table itself.
    tables.replace(spark.table(name).where("id > 0"), name, same=True)
    assert ids(spark, name) == [1, 2] and left(spark, name) == []


def test_recover(spark, name):
    tables.create(spark.range(3).toDF("id"), name)
    tables.rename(spark, name, name + "__old")  # a replacement was cut off between its renames
    assert not spark.catalog.tableExists(name)
    assert tables.recover(spark, name) and ids(spark, name) == [0, 1, 2]
    tables.create(spark.range(9).toDF("id"), name + "__old")  # or before the old rows were dropped
    assert tables.recover(spark, name) and ids(spark, name) == [0, 1, 2] and not tables.recover(spark, name)


def test_append_is_repeatable(spark, name):
    first, second = spark.range(3).toDF("id"), spark.range(10, 12).toDF("id")
    tables.append(first, name, "it's \\1")
    tables.append(second, name, "b")
    tables.append(second, name, "b")
    tables.append(first.where("id > 0"), name, "it's \\1")
    assert ids(spark, name) == [1, 2, 10, 11]
    assert sorted(tuple(r) for r in tables.loads(spark, name).collect()) == [("b", 2), ("it's \\1", 2)]
    with pytest.raises(Exception, match="broken"):
        tables.append(failing(spark), name, "b")
    tables.append(first.limit(0), name, "it's \\1")
    assert ids(spark, name) == [10, 11]
    for wrong in (first.toDF("other"), first.withColumn("x", F.lit(1)), first.withColumn("load_id", F.lit(1))):
        with pytest.raises(tables.LoadError):
            tables.append(wrong, name, "c")


def test_overwrite_that_fails_keeps_the_table(spark, name):
    save_table(spark.range(3).toDF("id"), name)
    with pytest.raises(Exception, match="broken"):
        save_table(failing(spark), name, "overwrite")
    assert ids(spark, name) == [0, 1, 2]
    drop_table(spark.range(1), name)
    assert not spark.catalog.tableExists(name)


def test_typed_load_of_values_with_breaks(spark, name, tmp_path):
    (tmp_path / "a.tsv").write_text('num\tnote\n1\t"two\nlines"\n2\t"tab\there ""q"""\n3\tplain\n4\t"never closed\n5\tx\n')
    assert load_tsv(spark, str(tmp_path), name) == name
    got = sorted(tuple(r) for r in spark.table(name).select("num", "note").collect())
    assert [r[1] for r in got] == ["two\nlines", 'tab\there "q"', "plain"]
