"""The corpus operators against brute force, on small tables with odd rows."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.llm import (
    bag_minhash, bloom, chat_format, exact_dedup, lang_id, line_dedup, mixing, piece_sampling, sharding, substring_dedup, vector_dedup,
)
from wardline.llm.components import components
from wardline.llm.queries import PIECES, QUERIES, TRICKY

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{k}" for k in range(120))
TEXTS = [
    (1, BASE, "src0", "en"),
    (2, BASE.replace(" ", "\n", 1), "src0", "en"),
    (3, BASE.replace("w60 ", "x "), "src1", "en"),
    (4, None, "src1", None),
    (5, "", None, None),
    (6, " \n\t", "src2", "de"),
    (7, "short text", "src2", "de"),
    (7, "short text", "src2", "de"),
    (8, "lead in " + " ".join(f"w{k}" for k in range(30, 90)) + " tail", "src2", "de"),
    (None, BASE, None, "en"),
    (9, "rep " * 3000, "src0", "en"),
]
SCHEMA = "doc_id long, text string, source string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with extra columns named like the operators' own."""
    extra = {name: F.lit(name) for name in ("row", "digest", "size", "key", "suspect", "word", "bucket", "kept", "cell0_")}
    return spark.createDataFrame(TEXTS, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_exact(docs, empty):
    got = rows(exact_dedup.exact_labels(docs))
    assert len(got) == len(TEXTS)
    groups = collections.defaultdict(list)
    for doc_id, text, _, _ in TEXTS:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()].append((doc_id, len(text or "")))
    for doc_id, keep_id, size, _, digest in got:
        best = min(groups[digest], key=lambda g: (-g[1], g[0] is None, g[0] or 0))
        assert (keep_id, size) == (best[0], len(groups[digest]))
    assert sum(r[3] for r in got) == len(groups)
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert rows(exact_dedup.exact_labels(empty)) == [] and rows(exact_dedup.drop_exact(empty)) == []


def test_passages(docs, empty):
    split = [(d, WORD.findall(t or "")) for d, t, _, _ in TEXTS]
    first = {}
    for d, w in split:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, math.inf), math.inf if d is None else d)
    want = []
    for d, w in split:
        gone = set()
        for k in range(len(w) - 49):
            if d is not None and first[tuple(w[k : k + 50])] < d:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = rows(substring_dedup.remove_duplicates(docs).drop("kept"))
    assert sorted(got, key=str) == sorted(want, key=str)
    spans = rows(substring_dedup.duplicate_spans(docs))
    assert all(length >= 50 and source < d for d, _, length, source in spans) and spans
    assert rows(substring_dedup.remove_duplicates(empty)) == []


@pytest.mark.parametrize("block", [7, 64, 256])
def test_longest_factors(spark, block):
    """A copy is one span though part of it also lies in a smaller document; spans agree word by word with their sources."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"v{k}" for k in rng.integers(0, 1 << 40, n)]
    whole = word(200)
    texts = {
        3: word(9) + whole[60:130] + word(11),
        4: whole[:55] + word(5),
        5: word(33) + whole + word(2),
        9: word(300) + whole + word(7),
        10: whole[:100] + word(3) + whole[100:] + whole[40:95],
        11: whole[20:70] + ["end"],
        12: ["rep"] * 400,
        13: ["rep"] * 130 + whole[150:],
    }
    table = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    spans = collections.defaultdict(list)
    for doc_id, start, length, source in rows(substring_dedup.duplicate_spans(table, block=block)):
        mine, other = texts[doc_id][start : start + length], texts[source]
        assert length >= 50 and source < doc_id
        assert any(other[k : k + length] == mine for k in range(len(other)))
        spans[doc_id].append((start, length, source))
    assert spans[9] == [(300, 200, 5)]
    assert sorted(spans[10]) == [(0, 100, 5), (103, 100, 5), (203, 55, 5)]
    assert spans[11] == [(0, 50, 5)]
    assert sorted(spans[13]) == [(0, 130, 12), (130, 50, 5)]
    first = {}
    for d in sorted(texts):
        for k in range(len(texts[d]) - 49):
            first.setdefault(tuple(texts[d][k : k + 50]), d)
    for d, w in texts.items():
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < d for j in range(k, k + 50)}
        assert gone == {j for start, length, _ in spans[d] for j in range(start, start + length)}


def test_factors_of_spans():
    factors = substring_dedup.greedy_factors
    assert factors([], 5) == []
    assert factors([(0, 9, 4), (0, 9, 3), (2, 8, 1)], 5) == [(0, 9, 3)]
    assert factors([(0, 6, 1), (1, 12, 2), (3, 9, 0)], 5) == [(0, 6, 1), (2, 10, 2)]
    assert factors([(0, 6, 1), (10, 15, 2)], 5) == [(0, 6, 1), (10, 5, 2)]
    # Equal hashes of different words: a run whose words differ is no candidate.
    run = substring_dedup.Run(4, 4, 1, 0)
    assert substring_dedup.extents([run], [(0, substring_dedup.WITHIN, 0, 3, False)], 5) == []
    assert substring_dedup.extents([run], [(0, substring_dedup.WITHIN, 0, 5, True)], 5) == [(4, 9, 1)]


def test_near(docs, empty):
    got = {r.doc_id: r.class_id for r in bag_minhash.near_classes(docs).collect()}
    assert got[2] == 1 and got[3] == 1 and got[7] == 7 and got[4] == 4 and got[8] == 8 and got[None] is None
    assert rows(bag_minhash.near_classes(empty)) == []


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    a = {int(k): int(c) for k, c in enumerate(rng.integers(1, 9, 60))}
    b = {k + 15: a.get(k + 15, 3) + int(rng.integers(0, 4)) for k in range(60)}
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
    agree = []
    for salt in range(40):
        sigs = []
        for bag in (a, b):
            values = np.array(sorted(bag), np.uint64) + np.uint64(1000 * salt + 7)
            counts = np.array([bag[k] for k in sorted(bag)])
            sigs.append(bag_minhash.signatures(np.zeros(len(bag), np.int64), bag_minhash.wh.mix(values), counts, 1, 128)[0])
        agree.append((sigs[0] == sigs[1]).mean())
    assert abs(np.mean(agree) - true) < 0.02


def test_mix(docs, empty):
    got = mixing.mix_sizes(docs).collect()
    sizes = sorted(len(WORD.findall(t or "")) for _, t, _, _ in TEXTS)
    assert sorted(r["size"] for r in got) == sizes
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert rows(mixing.mix_sizes(docs)) == rows(mixing.mix_sizes(docs))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == sum(r.taken for r in got)
    assert rows(mixing.mix_sizes(empty)) == [] and rows(mixing.mix(empty)) == []


def test_targets_by_rounds(spark):
    sizes = {"a": 100, "b": 7, "c": 2000, "d": 1, "é": 50, None: 400}
    order = sorted((s for s in sizes if s is not None), key=str) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in sizes if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in rest)
        above = [s for s in rest if weight[s] * level > 3 * sizes[s]]
        if not above:
            break
        capped |= {s: 3 * sizes[s] for s in above}
    want = {s: capped.get(s, weight[s] * level) for s in sizes}
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    assert got == pytest.approx(want)


def test_shards(docs, empty):
    names = [f"s{k}" for k in range(7)]
    owner = sharding.lookup_table(names, 1009)
    assert max(collections.Counter(owner).values()) - min(collections.Counter(owner).values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 6) < 0.25 * 1009
    got = sharding.with_shard(docs, "doc_id", names, 1009)
    assert got.count() == len(TEXTS) and {r.shard for r in got.collect()} <= set(names)
    assert rows(sharding.with_shard(empty, "doc_id", names)) == []


def test_chat(spark):
    long = " ".join(f"t{k}" for k in range(700))
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "user", long), (1, 2, "assistant", long), (1, 3, "user", None), (1, 4, "assistant", "ok"),
        (2, 0, "user", TRICKY), (2, 1, "assistant", TRICKY), (2, 2, None, "\\\\##"), (3, 5, "assistant", ""), (None, None, "user", "x"),
        (4, 0, "system", "####"), (5, 1, "a: b", "</turn>"),
    ] + [(6, k, ("user", "assistant")[k % 2], f"{k} " + "word " * (k % 90)) for k in range(120)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = chat_format.chat_windows(frame, budget=200, history=40)
    got = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    for conv in {t[0] for t in turns}:
        own = [(r or "", t or "") for c, _, r, t in turns if c == conv]
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        trained = "".join(t for r, t in own if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(trained), hashlib.sha256(trained.encode()).hexdigest())
    assert windows.where("conv_id = 6").agg(F.max("n_words")).first()[0] <= 200
    assert windows.where("conv_id = 1 and formatted not like '%be kind%'").count() == 0
    assert rows(chat_format.read_back(chat_format.chat_windows(frame.limit(0)))) == []


def test_language(docs, empty, spark):
    words = {"en": "the and with from that this", "de": "der und mit von nicht dass", "fr": "les est avec pour dans une"}
    rng = np.random.default_rng(1)
    made = [(k, " ".join(rng.choice(words[lang].split(), 40)), lang) for k, lang in enumerate(["en", "de", "fr"] * 30)]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string")
    dictionaries = lang_id.learn(frame.where("doc_id % 4 <> 0"))
    found = lang_id.predict(frame.where("doc_id % 4 = 0"), dictionaries).select("row.lang", "lang_pred", "rejected").collect()
    assert np.mean([r.lang == r.lang_pred and not r.rejected for r in found]) > 0.95
    odd = lang_id.predict(docs, dictionaries).select("row.text", "lang_pred", "score", "rejected").collect()
    assert all((r.lang_pred, r.score, r.rejected) == ("und", 0.0, True) for r in odd if not re.search("[a-z]", r.text or ""))
    assert lang_id.learn(empty) == {} and {r.lang_pred for r in lang_id.predict(docs, {}).collect()} == {"und"}
    assert rows(lang_id.predict(empty, dictionaries)) == []


def edits(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (x != y)))
        line = new
    return line[-1]


def test_lines(spark, docs, empty):
    rng = np.random.default_rng(5)
    pool = ["".join(rng.choice(list("abcé 😀"), n)) + "." for n in (24, 25, 30, 41) for _ in range(4)] + ["ab", "abc"]
    pool += ["the same start of a line, " + "".join(rng.choice(list("xyz"), 6)) for _ in range(25)]
    for line in list(pool):
        at = int(rng.integers(0, len(line)))
        pool += [line[:at] + "q" + line[at:], line[:at] + line[at + 1 :]]
    pool += ["Page 1 of 12", "Page 2 of 12", "Page 12 of 12", "2024-01-02, Reuters", "2024-01-03, Reuters", "2024-01-13, Reuters", "abcd", "abcdefg", "abcdefh"]
    pool += ["a common line of 22 " + c for c in "uvw"] + ["a common line of 23 c" + c for c in "uvw"] + ["a common line of 24 ch" + c * 2 for c in "uvw"]
    pool = sorted({line for line in pool if line.strip()})
    frame = spark.createDataFrame([(k % 9, "\n".join([line, "", line])) for k, line in enumerate(pool)] + [(99, None)], "doc_id long, text string")
    digest = {hashlib.sha256(line.encode()).hexdigest(): line for line in pool}
    got = {digest[r.line_sha256]: r for r in line_dedup.edit_classes(frame).collect()}
    assert set(got) == set(pool) and all(r.n_copies == 2 for r in got.values())
    links = collections.Counter()
    class_of = {line: {line} for line in pool}
    for a, b in itertools.combinations(pool, 2):
        shorter = min(len(a), len(b))
        if edits(a, b) <= (0 if shorter < 8 else 1 if shorter < 24 else 2):
            links.update([a, b])
            joined = class_of[a] | class_of[b]
            class_of.update({line: joined for line in joined})
    assert {line: r.n_links for line, r in got.items() if r.n_links} == dict(links)
    assert links["Page 1 of 12"] == 2 and links["2024-01-02, Reuters"] == 1 and "abcdefg" not in links
    sha = {line: digest for digest, line in digest.items()}
    for line, r in got.items():
        first = min(class_of[line], key=lambda x: (got[x].doc_id, sha[x]))
        assert (r.class_doc_id, r.class_sha256, r.kept) == (got[first].doc_id, sha[first], first == line)
    assert line_dedup.drop_similar_lines(docs).columns == docs.columns
    assert rows(line_dedup.edit_classes(empty)) == []


def near_links(pool, limits):
    """How many lines of the pool each is linked with, by comparing all pairs."""
    links = collections.Counter()
    for a, b in itertools.combinations(pool, 2):
        shorter = min(len(a), len(b))
        allowed = max([e for least, e in limits if shorter >= least], default=0)
        if abs(len(a) - len(b)) <= allowed and edits(a, b) <= allowed:
            links.update([a, b])
    return links


@pytest.mark.parametrize("limits", [line_dedup.LIMITS, ((5, 1), (13, 3))])
def test_lines_between_classes_of_lengths(spark, limits):
    """Links across the lengths where classes and limits begin, with edits at every place, and crowds of like lines."""
    rng = np.random.default_rng(6)
    most = max(e for _, e in limits)
    pool = set()
    for size in (3, 7, 8, 9, 10, 12, 13, 16, 23, 24, 25, 28, 32, 40, 41, 48):
        line = "".join(rng.choice(list("abdefgh"), size))
        for k in range(14):
            near = line
            for _ in range(int(rng.integers(1, most + 1))):
                at, kind = int(rng.integers(0, len(near) + 1)), k % 3
                near = near[:at] + ("c" if kind else "") + near[at + (kind != 1) :]
            pool |= {line, near or line}
    pool |= {"the common start of lines, " + "".join(rng.choice(list("xyz"), 4)) + ", and their common end" for _ in range(30)}
    pool = sorted(pool)
    frame = spark.createDataFrame([(k, line) for k, line in enumerate(pool)], "doc_id long, text string")
    got = {pool[r.doc_id]: r.n_links for r in line_dedup.edit_classes(frame, limits=limits).collect() if r.n_links}
    assert got == dict(near_links(pool, limits))


def test_lines_pass_filters_once(spark, monkeypatch):
    """With a crowded key, rows looked up in a filter are lines, not their entries."""
    passed = []

    def counted(rows, *args, was=bloom.with_suspicion):
        passed.append(rows.count())
        return was(rows, *args)

    for module in (bloom, line_dedup):
        monkeypatch.setattr(module, "with_suspicion", counted, raising=False)
    lines = [f"{k:02d} all of these lines end in the same words of some length" for k in range(40)]
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = line_dedup.edit_classes(frame).collect()
    assert [r.n_links for r in got] == [39] * 40 and sum(passed) <= len(lines)


def test_lines_of_a_crowd_meet_few_times(spark, monkeypatch):
    """Pairs that share most of their lines do not meet again at every choice of what they share."""
    made = []

    def counted(*args, was=line_dedup._pairs):
        pairs = was(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(line_dedup, "_pairs", counted)
    lines = [f"all of these lines begin and {k:02d} end in the same words of some length" for k in range(30)]
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert [r.n_links for r in line_dedup.edit_classes(frame).collect()] == [29] * 30
    assert sum(made) <= 8 * 30 * 29 / 2


def test_samples(docs, empty):
    found = piece_sampling.encode_samples(docs, PIECES, samples=3)
    back = piece_sampling.decode(found.select(F.col("row.text").alias("was"), "ids"), PIECES)
    assert all((r.was or "") == r.text for r in back.select("row.was", "text").collect())
    voc = piece_sampling.Vocabulary(PIECES)
    n = 3000
    drawn = piece_sampling.sample_texts(["ofabc"] * n, np.arange(n), voc, 2)
    odds = {tuple(s[0]): math.exp(s[1]) for d in drawn for s in d}
    seen = collections.Counter(tuple(s[0]) for d in drawn for s in d)
    assert all(len({tuple(s[0]) for s in d}) == 2 and d[0][2] > d[1][2] for d in drawn)
    for way, p in sorted(odds.items(), key=lambda x: -x[1])[:3]:
        either = p + sum(q * p / (1 - q) for other, q in odds.items() if other != way)
        assert abs(seen[way] / n - either) < 0.04
    # Weighting by the inclusion score estimates a total without bias.
    assert abs(np.mean([sum(math.exp(s[1] - s[3]) for s in d) for d in drawn]) - 1) < 0.1
    assert rows(piece_sampling.encode_samples(empty, PIECES)) == []


def test_samples_read_back(spark, sf_dir):
    """Every sample that the query emits spells its document."""
    texts = dict(rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    got = QUERIES["op7_piece_samples"](spark, sf_dir).select("doc_id", "text_sha256").collect()
    assert {r.doc_id for r in got} == set(texts)
    assert all(r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in got)


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 16))
    made = [(int(k), (base[k % 6] + 0.03 * rng.standard_normal(16) * (k % 3)).tolist(), int(k % 2)) for k in range(90)]
    made += [(200, None, 1), (201, [0.0] * 16, 1), (202, [math.nan] * 16, 1), (203, made[0][1], None), (204, [1.0, None], 1), (205, [], 1), (206, [1.0], 1)]
    made += [(300 + k, made[0][1], 0) for k in range(5)]
    frame = spark.createDataFrame(made, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vector_dedup.near_vectors(frame).collect()}
    fine = [(i, vector_dedup.unit(np.array(v)), c) for i, v, c in made if not 200 <= i < 300]
    for i, v, c in fine:
        assert got[i].n_links == sum(1 for j, w, d in fine if i != j and c == d and v @ w >= 0.98)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(200, 207))
    assert rows(vector_dedup.near_vectors(frame.limit(0))) == []


def test_vectors_across_full_groups(spark):
    """Every list fills with its own group; the 225 links across must not get lost."""
    rng = np.random.default_rng(8)
    one, two, *_ = np.linalg.qr(rng.standard_normal((32, 32)))[0]
    middles = [one, 0.9855 * one + math.sqrt(1 - 0.9855**2) * two]
    made = [(k, (vector_dedup.unit(middles[k % 2]) + 0.0035 * rng.standard_normal(32)).tolist(), 3) for k in range(30)]
    units = np.stack([vector_dedup.unit(np.array(v)) for _, v, _ in made])
    sims = units @ units.T
    assert sims[0, 1::2].max() < sims[0, 2::2].min()
    want = {k: int((sims[k] >= 0.98).sum()) - 1 for k in range(30)}
    assert min(want.values()) > 20
    got = vector_dedup.near_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: r.n_links for r in got} == want
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_vectors_recall_is_enforced(spark):
    """Pairs far from all others, under too few buckets to meet in."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((300, 24))
    made = [(2 * k + j, (base[k] + 0.12 * j * rng.standard_normal(24)).tolist(), int(k < 40)) for k in range(300) for j in range(2)]
    units = np.stack([vector_dedup.unit(np.array(v)) for _, v, _ in made])
    labels = np.array([c for _, _, c in made])
    want = ((units @ units.T >= 0.98) & (labels[:, None] == labels[None, :])).sum(axis=1) - 1
    frame = spark.createDataFrame(made, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vector_dedup.near_vectors(frame, tables=1, rounds=1).collect()}
    for label in (0, 1):
        found = sum(got[i].n_links for i, _, c in made if c == label)
        assert found >= vector_dedup.RECALL * want[labels == label].sum() > 50
    assert all(got[i].n_links <= want[i] and got[i].component_id in (i, i - i % 2) for i in got)


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert dict(rows(components(spark.createDataFrame(links, "a long, b long")))) == want


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "encode":
            assert out.columns == docs.columns
        if name in ("language", "exact", "near"):
            assert out.exceptAll(docs).count() == 0
        docs = out.persist()
    assert docs.count() > 0


def test_samples_share_lattices(monkeypatch):
    """Rows of a megabyte of text share one set of lattices; smaller slices draw the same samples."""
    texts = [f"some words of text {k} and more of them, {k * 7919} in all" for k in range(300)]
    texts = [" ".join([text] * 60) for text in texts]
    batch = pa.RecordBatch.from_pydict({"row": list(range(300)), "key_": list(range(300)), "text_": texts})
    assert 800_000 < sum(map(len, texts)) < 1 << 20
    voc, built = piece_sampling.Vocabulary(PIECES), []

    class Counted(piece_sampling.Lattice):
        def __init__(self, *args):
            built.append(1)
            super().__init__(*args)

    def drawn():
        return [(r["row"], r["sample"], r["ids"]) for b in piece_sampling._sample(voc, 2, False)([batch]) for r in b.to_pylist()]

    monkeypatch.setattr(piece_sampling, "Lattice", Counted)
    found = drawn()
    assert len(built) == 1
    monkeypatch.setattr(piece_sampling, "SLICE", 1 << 17)
    assert drawn() == found and len(built) > 2
