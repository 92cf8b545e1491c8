"""Inputs that once lost rows or ended the job."""

from pyspark.sql import functions as F

from wardline.functions import jsonqa, text
from wardline.operators import rows


def test_extreme_integer(spark):
    df = spark.createDataFrame([("-9223372036854775808",), ("12",), ("-2147483648",)], "c string")
    got = df.select(text.value_type("c"), text.typed_value("c", "int"), text.typed_value("c", "bigint")).collect()
    assert [r[0] for r in got][:2] == ["bigint", "int"]
    assert got[0][1] is None and got[0][2] == -(1 << 63)


def test_null_order_key_is_numbered(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c"), (-(1 << 62), "d")], "k long, v string")
    got = {r.v: r.row_no for r in rows.number_rows(df, "k").collect()}
    assert got == {"b": 1, "d": 2, "a": 3, "c": 4}


def test_deep_documents(spark):
    deep = '{"a":' * 900 + "[1,1]" + "}" * 900
    report = jsonqa.inspect_document(deep)
    assert report["valid"] and report["duplicate_values"][0]["value"] == "1"
    assert jsonqa.inspect_document("[" * 200_000 + "]" * 200_000)["valid"] is None
    assert jsonqa.inspect_document("{")["valid"] is False


def test_python_literals_in_evidence(spark):
    packed = "[{'category': None, u'heuristic': 'None, really'}]"
    got = spark.createDataFrame([(packed,)], "c string").select(F.size(text.parse_evidences("c"))).first()[0]
    assert got == 1


def test_quoted_literals_stay(spark):
    packed = "[{u'heuristic_name': u'x, None, \\'u', 'category': None, 'hosts': ['True', u\"it's False\", None]}]"
    got = spark.createDataFrame([(packed,), ("[{'category': 'u'}]",), (None,), ("[None, 'open",)], "c string").select(text.parse_evidences("c"))
    first, second, none, broken = [r[0] for r in got.collect()]
    assert first[0].heuristic_name == "x, None, 'u" and first[0].category is None and first[0].hosts == ["True", "it's False", None]
    assert second[0].category == "u" and none is None and not broken
