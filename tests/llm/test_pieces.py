"""Lattices of sampled segmentations: what they hold, and texts of odd characters."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from wardline.llm import piece_sampling
from wardline.llm.queries import PIECES


@pytest.fixture(scope="module")
def voc():
    return piece_sampling.Vocabulary(PIECES)


def _texts(seed, n):
    """Texts of 250 words each, of which most occur once."""
    rng = np.random.default_rng(seed)
    parts = ["th", "he", "an", "er", "on", "re", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    words = ["".join(rng.choice(parts, int(rng.integers(1, 7)))) for _ in range(250 * n)]
    return [" ".join(words[k : k + 250]) for k in range(0, len(words), 250)]


def _peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_lattices_hold_only_pieces(voc):
    """Memory goes with the pieces in a slice's words, not with every length at every character."""
    texts = _texts(3, 400)
    assert 700_000 < sum(map(len, texts)) < piece_sampling.SLICE
    found, peak = _peak(lambda: piece_sampling.sample_texts(texts, np.arange(len(texts)), voc, 2))
    assert all(len(f) == 2 for f in found)
    assert peak < 120e6


def test_a_worker_holds_one_slice(voc):
    """What the pipeline's last stage runs in a worker: the memory of many slices is that of one."""
    texts = _texts(4, 1500)
    assert sum(map(len, texts)) > 2 * piece_sampling.SLICE
    batch = pa.RecordBatch.from_pydict({"row": list(range(len(texts))), "key_": list(range(len(texts))), "text_": texts})
    run = piece_sampling._sample(voc, 2, False)
    rows, peak = _peak(lambda: sum(b.num_rows for b in run(iter([batch]))))
    assert rows == 2 * len(texts)
    assert peak < 150e6


def test_states_are_prefixes(voc):
    """The trie reads every piece, and nothing that no piece begins with."""
    prefixes = {text[:n] for text in voc.texts.values() for n in range(1, len(text) + 1)}
    assert (voc.owner >= 0).sum() == len(prefixes)
    for k, text in voc.texts.items():
        state = 0
        for c in text:
            ahead = voc.step[state] + voc.classes[ord(c)]
            assert voc.owner[ahead] == state
            state = ahead
        assert voc.ids[state] == k and voc.weights[state] > 0


@pytest.mark.parametrize("text", ["͸" * 400, "\U000e0001" * 40, "͸" * 45 + "and words after " * 20, "͸" * 30 + "\n▁\0" * 9])
def test_long_runs_without_pieces(voc, text):
    """Runs that only byte pieces spell, whose weights are too small for a double."""
    spellings = piece_sampling.Spellings(voc)
    (found,) = piece_sampling.sample_texts([text], np.array([5]), voc, 2)
    assert found and all(np.isfinite(s[1:]).all() and s[1] <= 1e-9 for s in found)
    assert all(piece_sampling.decode_ids(s[0].tolist(), spellings) == text for s in found)


def test_words_of_one_hash(voc, monkeypatch):
    """Words are told apart even where all their hashes are the same."""
    texts = ["some words, some more words\n\n  and some of them twice", "", "more of them", "words"]

    def drawn():
        return [[(s[0].tolist(), *s[1:]) for s in f] for f in piece_sampling.sample_texts(texts, np.arange(4), voc, 3)]

    found = drawn()
    monkeypatch.setattr(piece_sampling.wh, "span_hashes", lambda values, starts, stops: np.zeros(len(starts), np.uint64))
    assert drawn() == found
