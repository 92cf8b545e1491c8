"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.session import shared_folder

WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table cuts the lineage, is computed once however often it is
    used, and outlives any executor.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``staged`` table that nothing reads any more."""
    spark = df.sparkSession
    folders = {name.rsplit("/", 1)[0] for name in df.inputFiles()[:1]}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(df: DataFrame, name: str) -> Column:
    """A text column, null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hash_key(value: Column) -> Column:
    """60 bits of the md5 of a value as text, as a long; null counts as empty text."""
    digits = F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def long_type(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
