"""A training-data pipeline over the table ``documents``.

Every stage takes (session, documents, table folder) and returns a DataFrame;
it is written as Parquet and read again as the next stage's documents.  All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bag_minhash, exact_dedup, lang_id, mixing, piece_sampling
from wardline.llm.bloom import rows_not_in
from wardline.llm.common import staged
from wardline.llm.queries import PIECES, labelled, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that the classifier rejects go."""
    found = lang_id.predict(docs, lang_id.learn(labelled(docs)))
    return found.where("not rejected").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with the same text but for white space."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    classes = bag_minhash.near_classes(docs)
    dropped = staged(classes.where("not kept").select("doc_id").distinct(), "near-dropped")
    return rows_not_in(docs, "doc_id", dropped)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or cut, to the sources' target weights."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document."""
    found = piece_sampling.encode_samples(docs, PIECES, keep=F.struct("doc_id", "lang", "source"))
    return found.select("row.*", "sample", F.size("ids").alias("n_pieces"), "ids", "log_prob", "perturbed", "log_inclusion")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

# Compression, weighted signatures and sampled segmentations have no SQL form;
# tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the table ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_CHECKS = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
