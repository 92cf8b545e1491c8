"""Near duplicates and the pipeline's stages that drop documents, against all pairs in plain Python."""

import collections
import re

import numpy as np
import pytest

import corpus_pipeline
from wardline.llm import bag_minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text):
    words = WORD.findall(text or "")
    if 0 < len(words) < 5:
        return collections.Counter([tuple(words)])  # one shingle of all its words
    return collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def overlap(a, b):
    """Weighted Jaccard similarity of two multisets."""
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def near_classes(docs):
    """The smallest id of every document's class; all pairs that share a shingle are compared."""
    bags = {doc_id: bag(text) for doc_id, text in docs}
    held = collections.defaultdict(list)
    for doc_id, shingles in bags.items():
        for shingle in shingles:
            held[shingle].append(doc_id)
    parent = {doc_id: doc_id for doc_id in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for ids in held.values() for a in ids for b in ids if a < b}:
        x, y = sorted((root(a), root(b)))
        if x != y and overlap(bags[a], bags[b]) >= 0.8:
            parent[y] = x
    return {doc_id: root(doc_id) for doc_id in bags}


def family_docs():
    """Families of texts with 0 to 12 changed words, and with phrases repeated so that counts decide."""
    rng = np.random.default_rng(11)
    docs, number = [], 100
    for family in range(12):
        base = [f"f{family}w{k}" for k in rng.integers(0, 60 if family % 2 else 1 << 30, 150)]
        for changes in (0, 1, 2, 3, 4, 6, 9, 12):
            words = list(base)
            for at in rng.integers(0, 150, changes):
                words[at] = f"x{rng.integers(1 << 40)}"
            docs.append((int(number), " ".join(words)))
            number += 1
        docs.append((int(number), " ".join(base + base[:60])))  # the same shingles, other counts
        docs.append((int(number) + 1, " ".join(base + base[:15])))
        number += 2
    return docs


def test_classes_equal_all_pairs(spark):
    docs = family_docs()
    want = near_classes(docs)
    assert 12 < len(set(want.values())) < len(docs)  # some link and some do not
    got = bag_minhash.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want and len(got) == len(docs)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_exact_stage(spark, sf_dir, documents):
    best = {}
    for row in documents.collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", row.text or "")
        rank = (-len(row.text or ""), row.doc_id)
        best[key] = min(best.get(key, (rank, row)), (rank, row), key=lambda entry: entry[0])
    got = corpus_pipeline.exact(spark, documents, sf_dir)
    assert got.columns == documents.columns
    assert sorted(map(str, got.collect())) == sorted(str(row) for _, row in best.values())


def test_near_stage(spark, sf_dir, documents):
    rows = documents.collect()
    want = near_classes([(row.doc_id, row.text) for row in rows])
    got = corpus_pipeline.near(spark, documents, sf_dir)
    assert got.columns == documents.columns
    assert sorted(map(str, got.collect())) == sorted(str(row) for row in rows if want[row.doc_id] == row.doc_id)


def test_stages_take_empty_tables_and_null_ids(spark, sf_dir, documents):
    odd = spark.createDataFrame([(None, "a b c d e f g"), (None, None), (3, "a b c d e f g")], "doc_id long, text string")
    for column in documents.columns:
        if column not in odd.columns:
            odd = odd.selectExpr("*", f"cast(null AS {documents.schema[column].dataType.simpleString()}) AS {column}")
    odd = odd.select(*documents.columns)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        assert stage(spark, documents.limit(0), sf_dir).collect() == []
    kept = corpus_pipeline.exact(spark, odd, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "None"]  # a null id comes after all others
    assert corpus_pipeline.near(spark, odd, sf_dir).count() == 3  # a row without an id is never dropped
