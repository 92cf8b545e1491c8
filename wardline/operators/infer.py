"""Schema inference by vote over all rows, schema comparison, typed projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.text import SPARK_TYPE, safe_name, typed_value, value_type

REJECT = "_rejected"


def parse_lines(lines: DataFrame, header: list[str], line: str = "line", sep: str = "\t", escape: str = '"') -> DataFrame:
    """Delimited lines, or records with line breaks, to text columns ``_f0.._fn`` plus ``_rejected``.

    ``_rejected`` holds the raw line when its width differs from the header, and
    is NULL otherwise.  Empty fields are kept as ``''``.
    """
    schema = ", ".join([f"_f{i} string" for i in range(len(header))] + [f"{REJECT} string"])
    # Line breaks belong to the values; without ``multiLine`` the parser would change them.
    options = {"sep": sep, "escape": escape, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT, "multiLine": "true", "maxCharsPerColumn": "-1"}
    # The explode makes one parsed row that all fields and later filters share.
    parsed = lines.withColumn("_row", F.explode(F.array(F.from_csv(F.col(line), schema, options))))
    fields = [F.coalesce(F.col(f"_row._f{i}"), F.lit("")).alias(f"_f{i}") for i in range(len(header))]
    others = [c for c in lines.columns if c != line]
    return parsed.select(*others, *fields, F.col(f"_row.{REJECT}").alias(REJECT))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(REJECT).isNull()).drop(REJECT)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(REJECT).isNotNull()).select(F.col(REJECT).alias("line"))


def type_votes(rows: DataFrame, names: list[str], columns: list[str], order: str) -> DataFrame:
    """Winning loader type per column name over all rows.

    ``names`` are the header names of ``columns``; columns sharing a name vote
    together.  ``order`` is an integer row number.  Any text wins, then any bigint, then the most frequent type with
    ties going to the type seen first.  Each task reduces its rows to one count
    per column and type before anything is exchanged.
    """
    cells = [
        F.struct(F.lit(name).alias("column"), F.lit(i).alias("ordinal"), F.col(c).alias("value"))
        for i, (name, c) in enumerate(zip(names, columns))
    ]
    # Turning columns into rows first keeps one copy of the detection code.
    seen = rows.select(F.col(order).alias("_at"), F.inline(F.array(*cells))).select(
        "_at", "column", "ordinal", value_type("value").alias("type")
    )
    # Row and position as one number, so that counting needs no sort.
    place = F.col("_at").cast("bigint") * len(columns) + F.col("ordinal")
    counts = seen.groupBy("column", "type").agg(
        F.count("*").alias("_n"), F.min(place).alias("_first"), F.min("ordinal").alias("_ordinal")
    )
    # Most votes first, then earliest seen; a column has at most seven types.
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.col("_n")).alias("rank"), F.col("_first").alias("first"), F.col("type").alias("type")))
    )
    return counts.groupBy("column").agg(
        F.min("_ordinal").alias("ordinal"),
        F.when(F.bool_or(F.col("type") == "text"), "text")
        .when(F.bool_or(F.col("type") == "bigint"), "bigint")
        .otherwise(F.element_at(ranked, 1)["type"])
        .alias("type"),
        F.sum("_n").alias("votes"),
    )


def infer_types(rows: DataFrame, names: list[str], columns: list[str], order: str) -> list[str]:
    """Loader types in column order.  The result has one small row per column."""
    votes = {row["column"]: row["type"] for row in type_votes(rows, names, columns, order).collect()}
    if not votes:
        raise ValueError("no usable rows to infer a schema from")
    return [votes[name] for name in names]


def typed_rows(rows: DataFrame, names: list[str], columns: list[str], loader_types: list[str], keep: list[str] = []) -> DataFrame:
    """Cast text columns to their loader types under safe names."""
    casted = [
        typed_value(c, t).alias(safe_name(name)) for name, c, t in zip(names, columns, loader_types, strict=True)
    ]
    return rows.select(*keep, *casted)


def unfit_values(rows: DataFrame, names: list[str], columns: list[str], loader_types: list[str]) -> DataFrame:
    """Per column the number of non-empty values that do not fit its type."""
    checks: list[Column] = [
        F.struct(
            F.lit(safe_name(name)).alias("column"),
            F.count_if((F.col(c) != "") & typed_value(c, t).isNull()).alias("unfit"),
        )
        for name, c, t in zip(names, columns, loader_types, strict=True)
    ]
    return rows.agg(F.array(*checks).alias("checks")).select(F.inline("checks"))


def loader_schema(names: list[str], loader_types: list[str]) -> T.StructType:
    """Spark schema of the loaded table, without the row id."""
    ddl = ", ".join(f"`{safe_name(n)}` {SPARK_TYPE[t]}" for n, t in zip(names, loader_types, strict=True))
    return T.StructType.fromDDL(ddl)


def table_ddl(table: str, names: list[str], loader_types: list[str]) -> str:
    """CREATE TABLE text for the loaded table, with its row id first."""
    body = ", ".join(["id BIGINT NOT NULL"] + [f.simpleString().replace(":", " ") for f in loader_schema(names, loader_types)])
    return f"CREATE TABLE IF NOT EXISTS {table} ({body}) USING parquet"


def same_layout(left: T.StructType, right: T.StructType) -> bool:
    """Whether two schemas agree in position and type; names do not count."""
    return [f.dataType for f in left] == [f.dataType for f in right]


def layout_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A schema as ``(ordinal, data_type)`` rows."""
    rows = [(i + 1, f.dataType.simpleString()) for i, f in enumerate(schema)]
    return spark.createDataFrame(rows, "ordinal int, data_type string")
