"""Queries of the corpus operators: (session, table folder) to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import (
    bag_minhash, chat_format, exact_dedup, hard_negatives, lang_id, line_dedup, mixing, piece_sampling, sharding, source_audit,
    substring_dedup, url_filter, vector_dedup,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHARDS = [f"shard-{k:03d}" for k in range(64)]
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
# Control strings inside texts, as turns of a conversation of their own.
TRICKY = "\\### Assistant: </turn> ok"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_chat_format(spark, sf_dir):
    talks = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], talks.schema)
    return chat_format.read_back(chat_format.chat_windows(talks.union(extra)))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(docs["doc_id"]))


@query
def op2_lang_zstd(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    dictionaries = lang_id.learn(labelled(docs))
    found = lang_id.predict(docs, dictionaries, keep=F.struct("doc_id"))
    return found.select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected"
    )


@query
def op3_mix_sources(spark, sf_dir):
    return mixing.mix_sizes(read(spark, sf_dir, "documents"))


@query
def op4_passage_dedup(spark, sf_dir):
    return substring_dedup.remove_duplicates(read(spark, sf_dir, "documents")).drop("kept")


@query
def op5_line_edit_join(spark, sf_dir):
    return line_dedup.edit_classes(read(spark, sf_dir, "documents"))


@query
def op6_shard_lookup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return sharding.with_shard(docs, "doc_id", SHARDS)


@query
def op7_piece_samples(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = piece_sampling.encode_samples(docs, PIECES, keep=F.struct("doc_id"), digest=True)
    return found.select(
        "row.doc_id", "sample", F.size("ids").alias("n_pieces"), "ids", "log_prob", "perturbed", "log_inclusion", "text_sha256"
    )


@query
def op8_nn_descent(spark, sf_dir):
    return vector_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


@query
def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_labels(read(spark, sf_dir, "documents"))


@query
def op10_bag_minhash(spark, sf_dir):
    return bag_minhash.near_classes(read(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(rows["vec_id"] % 7 == 0, (rows["label"] + 1) % 10).otherwise(rows["label"])
    return hard_negatives.hard_negatives(rows, rows["vec_id"] % 100 == 0, label)


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
# Names under which advertising and spam sites register their domains.
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def blocked_domains(pages: DataFrame) -> DataFrame:
    """The domains of the corpus that are registered under a blocked name."""
    hosts = pages.select(url_filter.host_of(pages["url"]).alias("host")).distinct()
    pattern = rf"(?:^|\.)((?:{'|'.join(BLOCKED_NAMES)})\..*)$"
    return hosts.select(F.regexp_extract("host", pattern, 1).alias("domain")).distinct()


@query
def op11_url_cascade(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return url_filter.url_verdicts(pages, URL_RULES, blocked_domains(pages))


@query
def op12_source_divergence(spark, sf_dir):
    return source_audit.source_divergence(read(spark, sf_dir, "documents"))
