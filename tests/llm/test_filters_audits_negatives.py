"""URL cascades, the source audit and hard negatives against brute force, on small tables with odd rows."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardline.llm import hard_negatives, lang_id, piece_sampling, source_audit, url_filter, vector_dedup
from wardline.llm.queries import PIECES


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---------------------------------------------------------------- urls

URLS = [
    (1, "https://www.Example.com/en/1?x=/es/"), (2, "http://example.com/en/"), (3, "https://a.www.example.com/en/x#y"),
    (4, "https://example.com"), (5, "ftp://x.net/es/1"), (6, "x.net/fr/2"), (7, None), (8, ""), (9, "http://"),
    (10, "http:///en/"), (11, "https://m.ads.org/p://q"), (12, "https://badexample.com/EN/"), (13, "https://net/fr/?q"),
    (14, "https://ads.org.example.net/en/"), (15, "http://ads.org"), (15, "http://ads.org"), (None, "http://..ads.org./x"),
    (16, "http://É.ads.org/" + "y" * 100_000), (17, "http://" + "a." * 3000 + "ads.org/\n?x"),
]
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("WWW.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"), ("net", "/fr/", "allow"), ("É.ads.org", "", "allow"),
]
BLOCKED = ["ads.org", "Example.net", "unseen.example", None, "", "com"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def judged(url):
    _, found, rest = (url or "").partition("://")
    cut = re.search(r"[/?#]|$", rest)
    host = lower(rest[: cut.start()]) if found else ""
    path = re.match(r"[^?#]*", rest[cut.start() :])[0] if found else ""
    inside = lambda domain: domain != "" and (host == lower(domain) or host.endswith("." + lower(domain)))
    fits = [(len(h + p), v == "block", lower(h) + p, v) for h, p, v in RULES if inside(h) and path.startswith(p)]
    listed = max((lower(b) for b in BLOCKED if b and inside(b)), key=len, default=None)
    if fits:
        return host, path, max(fits)[2], listed, max(fits)[3]
    return host, path, None, listed, "block" if listed else "allow"


@pytest.fixture(scope="module")
def pages(spark):
    extra = {name: F.lit(name) for name in ("host", "rule", "key", "keys_", "allow_", "marks_", "left", "listed")}
    return spark.createDataFrame(URLS, "page_id long, url string").withColumns(extra)


@pytest.mark.parametrize("slice_keys", [url_filter.SLICE_KEYS, 1])
def test_verdicts(spark, pages, slice_keys):
    blocked = spark.createDataFrame([(b,) for b in BLOCKED], "listed string")
    got = rows(url_filter.url_verdicts(pages, RULES, blocked, slice_keys=slice_keys))
    assert sorted(got, key=str) == sorted([(k, *judged(u)) for k, u in URLS], key=str)


def test_verdicts_of_nothing(spark, pages):
    none = spark.createDataFrame([], "d string")
    assert rows(url_filter.url_verdicts(pages.limit(0), RULES, none)) == []
    assert {r[-1] for r in rows(url_filter.url_verdicts(pages, [], none))} == {"allow"}


def test_cascade_needs_several_levels_and_is_exact(spark):
    """Few cells a key would answer wrongly; the later levels mend every mistake."""
    universe = spark.range(60_000).select(F.xxhash64("id", F.lit(1)).alias("left"), F.xxhash64("id", F.lit(2)).alias("right"), (F.col("id") % 7 == 0).alias("listed"))
    levels = url_filter.build_cascade(universe)
    assert len(levels) >= 3
    keys = universe.toPandas()
    found = url_filter.listed(levels, keys["left"].to_numpy(), keys["right"].to_numpy())
    assert (found == keys["listed"].to_numpy()).all()


def test_filters_stay_within_their_bound():
    bits = url_filter.SLICE_KEYS * (url_filter.FIRST_LEVEL[0] + 1)
    assert bits / 8 <= 16 << 20


# ---------------------------------------------------------------- sources

TEXTS = [
    *[("en", f"s{k % 3}", f"The quick CAT{k} ÄÖ x1y the") for k in range(9)],
    *[("en", "s0", "alpha beta"), ("en", "s0", "alpha beta"), ("en", "big", "beta " * 50_000 + "the\x00the")],
    *[("de", None, "über Über und"), ("de", "", "und und"), ("de", "z", None), ("de", "empty", " \n12 ")],
    *[(None, "s0", "und the"), ("", "s1", ""), (None, None, None), ("xx", "only", "rare words"), ("fr", "a", "un"), ("fr", "b", "deux")],
]


def divergence(texts, least, top):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))) for lang, source, text in texts]
    documents = collections.Counter((lang, t) for lang, _, terms in words for t in set(terms))
    kept = collections.defaultdict(set)
    for (lang, term), n in documents.items():
        if n >= least:
            kept[lang].add(term)
    counts = collections.defaultdict(collections.Counter)
    for lang, source, terms in words:
        for key in ((lang, source), (lang, None)):
            counts[key].update(t for t in terms if t in kept[lang])

    def share(key):
        whole = sum(counts[key].values()) + 5 * len(kept[key[0]])
        return {t: 1 + 10**9 * (counts[key][t] + 5) // whole for t in kept[key[0]]}

    out = []
    for lang, source in {w[:2] for w in words}:
        p, q = share((lang, source)), share((lang, None))
        pairs = []
        for other in {w[1] for w in words if w[0] == lang and w[1] != source}:
            r = share((lang, other))
            pairs.append((sum(abs(p[t] - r[t]) for t in p), other))
        rising = [(p[t] - q[t], t) for t in p if counts[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", rising, top)):
            found.sort(key=lambda f: (-f[0], f[1].encode()))
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,options", [(2, {}), (1, {"top": 2, "shard_terms": 8, "round_bytes": 1000, "source_block": 1}), (99, {})])
def test_divergence(spark, least, options):
    extra = {name: F.lit(name) for name in ("term", "n", "shard", "part", "counts", "block", "number", "item")}
    docs = spark.createDataFrame(TEXTS, "lang string, source string, text string").withColumns(extra)
    got = rows(source_audit.source_divergence(docs, least=least, **options))
    assert sorted(got) == divergence(TEXTS, least, options.get("top", source_audit.TOP_TERMS))
    assert rows(source_audit.source_divergence(docs.limit(0))) == []


def test_perfect_hash_is_minimal_and_verifies_keys():
    shards = [[f"t{k}".encode() for k in range(a, b)] for a, b in ((0, 500), (500, 501), (501, 501), (600, 2000))]
    made = source_audit.ShardedHash([source_audit.build_hash(terms) for terms in shards])
    for k, terms in enumerate(shards):
        slots = made.slots(terms, source_audit.term_hashes(terms), np.full(len(terms), k))
        assert sorted(slots) == list(range(made.starts[k], made.starts[k + 1]))
        assert [made.keys[s] for s in slots] == terms
        others = [t + b"x" for t in terms]
        assert (made.slots(others, source_audit.term_hashes(others), np.full(len(terms), k)) == -1).all()


def test_perfect_hash_of_equal_hashes(monkeypatch):
    monkeypatch.setattr(source_audit, "term_hashes", lambda terms: np.full(len(terms), 7, np.uint64))
    terms = [b"a", b"b", b"c"]
    made = source_audit.ShardedHash([source_audit.build_hash(terms)])
    found = made.slots([*terms, b"d"], source_audit.term_hashes([*terms, b"d"]), np.zeros(4, int))
    assert sorted(found[:3]) == [0, 1, 2] and found[3] == -1


def test_shares_are_exact():
    for count, n, v in ((0, 0, 1), (0, 7, 3), (10**11, 10**12, 10**6), (3, 10**12, 10**6)):
        assert source_audit.shares(np.array([count]), n, v)[0] == 1 + 10**9 * (count + 5) // (n + 5 * v)


# ---------------------------------------------------------------- earlier operators


def test_repeated_vector_ids_are_rows_of_their_own(spark):
    table = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [1.0, 0.01]), (8, [0.01, 1.0]), (9, [-1.0, 0.0]), (9, [-1.0, 0.0])]
    frame = spark.createDataFrame([(k, v, "a") for k, v in table], "vec_id long, embedding array<double>, label string")
    frame = frame.withColumns({name: F.lit(name) for name in ("node", "least", "copies", "component", "links", "dim")})
    got = sorted(rows(vector_dedup.near_vectors(frame)))
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (8, 1, 5, False), (9, 1, 9, True), (9, 1, 9, True)]


def test_a_quoted_passage_does_not_decide_the_language(spark):
    rng = np.random.default_rng(2)
    syllables = {"en": ["th", "er", "ing", "ow"], "de": ["sch", "en", "ung", "ei"]}
    word = lambda lang: "".join(rng.choice(syllables[lang], 3))
    learnt = spark.createDataFrame([(" ".join(word(x) for _ in range(200)), x) for x in ("en", "de") for _ in range(20)], "text string, lang string")
    made = []
    for lang, other in (("en", "de"), ("de", "en")) * 6:
        few = [word(lang) for _ in range(12)]
        made.append((lang, " ".join([*few * 120, *(word(other) for _ in range(90))])))
    found = lang_id.predict(spark.createDataFrame(made, "lang string, text string"), lang_id.learn(learnt)).select("row.lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 9


def test_digests_of_decoded_samples(spark):
    texts = [(1, "some text, über 'quotes'"), (2, ""), (3, None), (4, "日本 \U0001f600 x" * 50)]
    found = piece_sampling.encode_samples(spark.createDataFrame(texts, "doc_id long, text string"), PIECES, digest=True)
    for r in found.select("row.text", "text_sha256").collect():
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


# ---------------------------------------------------------------- negatives


def vectors(seed=5):
    rng = np.random.default_rng(seed)
    out = [(int(k), [float(x) for x in rng.normal(size=6).astype(np.float32)], int(k) % 3) for k in range(400)]
    out += [(int(k), out[int(k) % 40][1], int(k) % 3) for k in range(400, 460)]  # equal vectors: ties
    out += [out[100], out[100], out[7]]  # repeated rows
    out += [(500, None, 1), (600, [1.0, None], 1), (700, [float("nan")], 1), (800, [float("inf"), 1.0], 1), (900, [0.5] * 6, None)]
    out += [(None, [0.3] * 6, 1), (None, [0.3] * 6, 2), (1000, [], 1), (1100, [1.0], 1), (1200, [2.0] * 9, 2), (1300, [0.0] * 6, 0)]
    out += [(1400, [3e9, -2e8, 1.0, 0.0], 1), (1401, [2.5e9, 1.0], 1), (1402, [1e9, 5e8], 2), (1500, [1e38] * 6, 2), (1501, [1e38] * 2, 2)]
    return out


def mined(table, positives=5, negatives=10):
    clean = [
        (k, i, [math.floor(256 * x) for x in v], label)
        for k, (i, v, label) in enumerate(table)
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    most = (1 << 63) - 1
    out = []
    for k, i, v, label in clean:
        if i is None or i % 100:
            continue
        score = lambda w: min(max(sum(a * b for a, b in zip(v, w)), -most), most)  # noqa: B023, E731
        ranked = sorted(((-score(w), j is None, j or 0, n, other) for n, j, w, other in clean if n != k))
        best = [r for r in ranked if r[4] == label][:positives]
        for p in best:
            inside = [r for r in ranked if r[4] != label and 30 * -p[0] <= 100 * -r[0] <= 90 * -p[0]][:negatives]
            out += [(i, None if p[1] else p[2], n, None if r[1] else r[2], -p[0], -r[0]) for n, r in enumerate(inside, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [(256, 8192), (2, 50)])
def test_mined(spark, blocks):
    extra = {name: F.lit(name) for name in ("row_no", "no_id", "vector", "anchor", "wanted", "score", "all", "rank")}
    table = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int").withColumns(extra)
    got = hard_negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, F.col("label"), anchor_block=blocks[0], block=blocks[1])
    assert sorted(rows(got), key=str) == mined(vectors())
    assert rows(hard_negatives.hard_negatives(table.limit(0), F.col("vec_id") % 100 == 0, F.col("label"))) == []
    assert rows(hard_negatives.hard_negatives(table, F.lit(None).cast("boolean"), F.col("label"))) == []


@pytest.mark.parametrize("low,high,width", [(-256, 257, 64), (-(1 << 20), 1 << 20, 5), (0, 2, 3), (-5, -4, 7)])
def test_packed_products(low, high, width):
    rng = np.random.default_rng(1)
    a, c = rng.integers(low, high, (4, width)), rng.integers(low, high, (11, width))
    want = a.astype(object) @ c.astype(object).T
    assert (hard_negatives.packed_products(a, c) == want).all()
    wide = hard_negatives.packed_products(a.astype(object) * 10**30, c.astype(object), 512)
    assert (wide == want * 10**30).all()


def test_scores_of_mixed_sizes():
    sides = pd.Series([[1e5, -3.0], [2.0], []]), pd.Series([[7.0, 1e9], [0.25, 0.25]])
    want = [[sum(math.floor(256 * x) * math.floor(256 * y) for x, y in itertools.zip_longest(a, c, fillvalue=0)) for c in sides[1]] for a in sides[0]]
    assert hard_negatives.scores(*sides).tolist() == want
