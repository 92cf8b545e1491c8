"""Sampled SentencePiece segmentations without replacement, and decoding.

A text's lattice has a node between any two characters and an edge for every
piece of the vocabulary; characters that are no piece are spelled in byte
pieces.  Pieces follow a Zipf law over their ranks, so a segmentation's
probability is the product of its pieces', normalised over the lattice.

The sample is a Gumbel top-k, found by a perturbed A* search.  The search
keeps sets of segmentations, each with the largest perturbed log-probability
in it, drawn top-down: a set's largest value is its parent's for the branch
that holds the winner, and a Gumbel variable cut off there for the rest.
Expanding the best set walks one segmentation (each piece drawn by the
probability of what can follow) and leaves, at each of its nodes, the set of
those that turn off there.  So the k best are distinct, come in decreasing
perturbed order, and the best value left over, kappa, gives each its inclusion
score 1 - exp(-exp(log p - kappa)), returned as a logarithm.

No piece goes past the start of a word (checked when the vocabulary is read),
so lattices are built for the distinct words of a slice of rows, with numpy.
All random numbers are hashes of the row key, the sample and the place.

Cases: null and empty texts have one segmentation without pieces.  A text with
fewer than k segmentations yields all of them.  Rows that repeat a key and a
text get the same samples; a null key counts as 0.  U+2581 inside a text is
spelled in bytes, so decoding gives every text back.  Very long texts and words
take memory in proportion to their length.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import wordhash as wh

SPACE = "▁"
MARK = "\udfff"  # stands for U+2581 inside a text; no valid text has it
SAMPLES = 2
ZIPF_SHIFT = 2.7
SLICE = 1 << 20  # bytes of text that share their words' lattices
SCALE = 4.0  # keeps the weights of ways through a word near one
FIRST = 128  # nodes whose sets are always drawn
RANGE = 40.0
SHORT = 48  # characters up to which they need no logarithms,
TINY = 1e-150  # unless they fall below this
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD1B54A32D192ED03)


def _uniform(x: np.ndarray) -> np.ndarray:
    out = (x >> np.uint64(11)).astype(np.float64)
    out += 0.5
    out *= 2.0**-53
    return out


class Vocabulary:
    """Pieces of a model file, in a trie that reads all substrings of a text at once.

    Code points have classes, 0 for those in no piece.  State s goes on with
    class c to state step[s] + c, if that state's owner is s; 0 is the root.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.bytes = np.full(256, -1, np.int32)
        pieces: list[tuple[str, int, float]] = []
        self.texts: dict[int, str] = {}
        for k in ids:
            text = model.id_to_piece(k)
            if model.is_byte(k):
                self.bytes[int(text[1:-1], 16)] = k
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                pieces.append((text, k, model.get_score(k)))
                self.texts[k] = text
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte pieces")
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", text) for text, _, _ in pieces):
            raise ValueError("the model has pieces that go past the start of a word")
        pieces.sort(key=lambda p: (-p[2], p[1]))
        total = math.log(sum(1.0 / (r + ZIPF_SHIFT) for r in range(len(pieces))))
        weights = [-math.log(r + ZIPF_SHIFT) - total for r in range(len(pieces))]
        self.byte_share = math.exp(weights[-1])
        states = self._trie([text for text, _, _ in pieces])
        self.weights = np.zeros(len(self.step))  # of each state's piece, 0 for none
        self.ids = np.zeros(len(self.step), np.int32)
        for (text, k, _), weight in zip(pieces, weights, strict=True):
            self.weights[states[text]] = math.exp(weight) * math.exp(SCALE * len(text))
            self.ids[states[text]] = k
        self._fill()

    def _trie(self, texts: list[str]) -> dict[str, int]:
        """Set ``chars``, ``step`` and ``owner``; the state of every prefix."""
        letters = Counter(c for text in texts for c in text)
        known = {c: k + 1 for k, (c, _) in enumerate(letters.most_common())}
        self.chars = np.array([ord(c) for c in known], np.int64)
        after: defaultdict[str, list[int]] = defaultdict(list)
        by_size: defaultdict[int, list[str]] = defaultdict(list)
        for prefix in sorted({text[:n] for text in texts for n in range(1, len(text) + 1)}):
            after[prefix[:-1]].append(known[prefix[-1]])
            by_size[len(prefix)].append(prefix)
        room = len(known) + 1
        owner = np.full(4 * (sum(map(len, by_size.values())) + room), -1, np.int64)
        step = np.zeros_like(owner)
        owner[0] = 0  # taken; class 0 is read there, which the root must not own
        states, low, tried = {"": 0}, room, Counter()  # where states with as many ways on were put
        for size in range(len(by_size) + 1):
            for prefix in by_size[size]:
                states[prefix] = int(step[states[prefix[:-1]]]) + known[prefix[-1]]
            for prefix in sorted((p for p in by_size[size] or [""] if p in after), key=lambda p: -len(after[p])):
                classes, at = np.sort(np.array(after[prefix])), 0
                if prefix:  # a place where all of them are free
                    at = max(low, tried[len(classes)])
                    while owner[at] >= 0 or (len(classes) > 1 and (owner[classes + (at - classes[0])] >= 0).any()):
                        at += 1
                    tried[len(classes)] = at
                    at -= int(classes[0])
                step[states[prefix]] = at
                owner[classes + at] = states[prefix]
                while owner[low] >= 0:
                    low += 1
        owner[0] = -1
        upto = int(np.flatnonzero(owner >= 0).max(initial=0)) + room + 1
        self.step, self.owner = step[:upto].copy(), owner[:upto].copy()
        return states

    def _fill(self) -> None:
        self.classes = np.zeros(0x110000, np.int16 if len(self.chars) < 1 << 15 else np.int32)
        self.classes[self.chars] = np.arange(1, len(self.chars) + 1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "classes"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._fill()


class Lattice:
    """The lattices of some words, each a size and a start in ``codes``.

    A word of n characters has n + 1 nodes.  Nodes are numbered by their
    distance from the word's end, then longest word first, so those that the
    pieces of some nodes lead to lie together as well, and a number below
    ``ends`` is a word's end.  The edges of a node, shorter pieces first, are
    ``start[node]`` to ``start[node + 1]``.  ``prob`` is the probability of
    going on with an edge, ``cum`` the same cumulated over the node's edges,
    ``target`` where it leads and ``ids`` its piece (or minus the code point of a
    character spelled in bytes).
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, voc: Vocabulary):
        order, longest = np.argsort(-sizes, kind="stable"), int(sizes.max(initial=0))
        # Words with a node at each distance, and where those nodes begin.
        many = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest + 1))
        self.begin = np.concatenate([[0], np.cumsum(many)])
        self.ends = len(sizes)
        self.first = np.empty(len(sizes), np.int64)
        self.first[order] = self.begin[sizes[order]] + np.arange(len(sizes))
        # The code points, with one more after every word, and each node's place there.
        stops = np.cumsum(sizes + 1) - 1
        codes = np.append(codes, np.uint32(0))[np.repeat(starts + sizes - stops, sizes + 1) + np.arange(int((sizes + 1).sum()))]
        classes = voc.classes[codes]
        classes[stops] = 0
        stops = stops[order]
        places = np.concatenate([stops[:m] - back for back, m in enumerate(many.tolist())][1:] or [stops])
        at, state, hits = np.arange(self.ends, self.ends + len(places)), np.zeros(len(places), np.int64), []
        spelled, code = at, codes[places]
        while len(at):
            ahead = voc.step[state] + classes[places]
            go = np.flatnonzero(voc.owner[ahead] == state)
            at, state, places = at[go], ahead[go], places[go] + 1
            hit = np.flatnonzero(voc.weights[state])
            if not hits:  # the first characters
                other = np.ones(len(spelled), bool)
                other[go[hit]] = False
                spelled, code = spelled[other], code[other].astype(np.int64)
            hits.append((at[hit].astype(np.int32), state[hit].astype(np.int32)))
        self._edges(hits, spelled, code, voc)
        self._transitions(longest)

    def _edges(self, hits: list, spelled: np.ndarray, code: np.ndarray, voc: Vocabulary) -> None:
        """Put the pieces, found by length, together by node; ``prob`` holds weights yet."""
        nodes = int(self.begin[-1])
        count = np.zeros(nodes, np.int32)
        count[spelled] = 1
        for at, _ in hits:
            count[at] += 1
        self.start = np.zeros(nodes + 1, np.int64)
        np.cumsum(count, out=self.start[1:])
        free, edges = self.start[:-1].copy(), int(self.start[-1])
        self.ids, self.prob, self.size = np.empty(edges, np.int32), np.empty(edges), np.empty(edges, np.int32)
        code[code == ord(MARK)] = ord(SPACE)
        length = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        at = free[spelled]
        self.ids[at] = np.where(code < 0x80, voc.bytes[np.minimum(code, 255)], -code)
        self.prob[at] = voc.byte_share**length * math.exp(SCALE)
        self.size[at] = 1
        free[spelled] += 1
        for n, (node, state) in enumerate(hits):
            at = free[node]
            free[node] += 1
            self.ids[at], self.prob[at], self.size[at] = voc.ids[state], voc.weights[state], n + 1

    def _transitions(self, longest: int) -> None:
        """Probability of every edge, given that its start is on the way.

        ``ways`` is the total weight of all ways from a node to its word's end;
        words that are long, or of characters with little weight, keep it as
        mantissa and logarithm.
        """
        nodes = int(self.begin[-1])
        ways, logs, scaled = np.ones(nodes), np.zeros(nodes), False
        self.target, self.cum = self.size, np.empty(len(self.prob), np.float32)  # a size is read before it is written over
        for back in range(1, longest + 1):
            a, b = int(self.begin[back]), int(self.begin[back + 1])
            start = self.start[a : b + 1] - self.start[a]
            here = slice(int(self.start[a]), int(self.start[b]))
            each, count = self.prob[here], np.diff(start)
            word = np.repeat(np.arange(b - a), count)
            ahead = self.begin[back - self.size[here]] + word
            self.target[here] = ahead
            each *= ways[ahead]
            log = logs[int(self.begin[back - 1]) :][: b - a]
            if scaled:  # bring the next nodes to one logarithm
                each *= np.exp(np.clip(logs[ahead] - log[word], -700.0, 700.0))
            total = np.bincount(word, each, b - a)
            each /= total[word]
            far = (total < TINY) | (total > 1 / TINY) | (back >= SHORT)
            ways[a:b], logs[a:b] = np.where(far, 1.0, total), log
            if far.any():
                scaled = True
                logs[a:b][far] += np.log(total[far])
            cum = self.cum[here]
            cum[:] = each
            at, left = start[:-1], count
            while len(at):
                go = np.flatnonzero(left > 1)
                at, left = at[go] + 1, left[go] - 1
                cum[at] += cum[at - 1]

    def walk(self, node: np.ndarray, seed: np.ndarray):
        """Draw a way from every node to its end: (edges per way, edges in order)."""
        node, live, steps = node.copy(), np.arange(len(node)), []
        counts = np.zeros(len(node), np.int64)
        while len(live):
            u = _uniform(wh.mix(seed[live] + np.uint64(len(steps) + 1) * _GOLD))
            here = node[live]
            edge = self.start[here]
            upto = (np.minimum(u, 1 - 1e-7) * self.cum[self.start[here + 1] - 1]).astype(np.float32)
            open_ = np.flatnonzero(self.cum[edge] <= upto)
            while len(open_):  # those whose piece is longer go on
                edge[open_] += 1
                open_ = open_[self.cum[edge[open_]] <= upto[open_]]
            steps.append((live, edge))
            counts[live] += 1
            here = self.target[edge]
            node[live] = here
            live = live[here >= self.ends]
        offset = np.cumsum(counts) - counts
        edges = np.empty(int(counts.sum()), np.int64)
        for k, (live, edge) in enumerate(steps):
            edges[offset[live] + k] = edge
        return counts, edges


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, start of every word, its size, number of words before each text) of all texts, one after another.

    A word is a new line, or other characters up to the next space or new
    line, with the spaces before them; no piece spans two.  Every text starts
    with a space.
    """
    texts = [f" {t}" if t else "" for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).copy()
    codes[codes == ord(SPACE)] = ord(MARK)
    space, line = codes == ord(" "), codes == ord("\n")
    codes[space] = ord(SPACE)
    first = line.copy()
    first[:1] = True
    first[1:] |= (space[1:] & ~space[:-1]) | (line[:-1] & ~space[1:])
    bounds = np.cumsum([0, *map(len, texts)])
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(first)
    return codes, starts, np.diff(starts, append=len(codes)), np.searchsorted(starts, bounds)


def distinct_words(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one word of each kind, the kind of every word).

    Words meet by their hashes and are compared; those that differ from the
    word they met are kinds of their own.
    """
    hashed = wh.span_hashes(wh.mix(codes + _GOLD), starts, starts + sizes)
    order = np.argsort(hashed)
    new = np.ones(len(order), bool)
    new[1:] = hashed[order[1:]] != hashed[order[:-1]]
    kinds = np.empty(len(order), np.int64)
    kinds[order] = np.cumsum(new) - 1
    chosen = order[new]
    met = chosen[kinds]
    same = sizes == sizes[met]
    other = np.minimum(np.arange(len(codes)) + np.repeat(starts[met] - starts, sizes), len(codes) - 1)
    unlike = np.flatnonzero(codes != codes[other])
    same[np.searchsorted(starts, unlike, "right") - 1] = False
    lone = np.flatnonzero(~same)
    kinds[lone] = len(chosen) + np.arange(len(lone))
    return np.concatenate([chosen, lone]), kinds


class _Path:
    """One segmentation; ``others`` are the sets that turn off at its nodes."""

    def __init__(self, word, edge, turn: int, barred: list[int], barred_mass: float, value: float, seed: np.uint64):
        self.word, self.edge = word, edge
        self.turn, self.barred, self.barred_mass, self.value, self.seed = turn, barred, barred_mass, value, seed


def _weigh(paths: list[_Path], probs: np.ndarray, keep: int) -> None:
    """Set ``log_prob`` and ``others`` of new paths, given the probabilities of all edges.

    A set of log mass m cannot reach m + RANGE, as the uniform numbers are
    multiples of 2**-54; so beyond the first nodes sets are only drawn if they
    may be among the ``keep`` best.
    """
    bounds = np.cumsum([0, *(len(p.edge) for p in paths)]).tolist()
    prob = probs[np.concatenate([p.edge for p in paths])]
    log = np.log(prob)
    ahead = np.empty_like(log)  # log mass of what begins like the path, up to each node
    for path, a, b in zip(paths, bounds, bounds[1:], strict=False):
        logs = log[a:b]
        np.subtract(np.cumsum(logs), logs, out=ahead[a:b])
        path.log_prob = float(logs.sum())
    spans = [(0, min(b - a, FIRST)) for a, b in zip(bounds, bounds[1:], strict=False)]
    more = []
    for k, (path, others) in enumerate(zip(paths, _drawn(paths, spans, bounds, prob, ahead), strict=True)):
        path.others = others
        if len(path.edge) > FIRST:
            least = np.partition(others, -keep)[-keep]
            upto = len(path.edge) if math.isinf(least) else int(np.searchsorted(-ahead[bounds[k] : bounds[k + 1]], RANGE - least))
            if upto > FIRST:
                more.append((k, upto))
    if more:
        late = [paths[k] for k, _ in more]
        drawn = _drawn(late, [(FIRST, upto) for _, upto in more], [bounds[k] for k, _ in more], prob, ahead)
        for path, others in zip(late, drawn, strict=True):
            path.others = np.concatenate([path.others, others])
    for path in paths:
        path.others[: path.turn] = -np.inf


def _drawn(paths: list[_Path], spans: list[tuple[int, int]], starts: list[int], prob: np.ndarray, ahead: np.ndarray) -> list[np.ndarray]:
    """The largest perturbed value of the set that turns off at each node of a span of every path."""
    first = np.array([a for a, _ in spans])
    sizes = np.array([b for _, b in spans]) - first
    ends = np.cumsum(sizes)
    nth = np.arange(int(ends[-1])) + np.repeat(first - ends + sizes, sizes)
    at = nth + np.repeat(np.array(starts[: len(spans)]), sizes)
    prob = prob[at]
    rest = np.log1p(-np.minimum(prob, 1.0))
    rest[prob > 1 - 1e-12] = -np.inf
    for path, (a, b), end in zip(paths, spans, ends.tolist(), strict=True):
        if path.barred and a <= path.turn < b:
            rest[end - b + path.turn] = math.log1p(-path.barred_mass) if path.barred_mass < 1 - 1e-12 else -np.inf
    mass = ahead[at] + rest
    seeds = np.repeat(np.array([p.seed for p in paths], np.uint64), sizes)
    draws = _uniform(wh.mix(seeds + (nth + 1).astype(np.uint64) * _ODD))
    # A Gumbel variable of this log mass, cut off at the path's own value.
    values = np.repeat(np.array([p.value for p in paths]), sizes)
    return np.split(-np.logaddexp(-values, np.log(-np.log(draws)) - mass), ends[:-1])


def sample_texts(texts: list[str], keys: np.ndarray, voc: Vocabulary, samples: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text, in decreasing perturbed order: (ids, log p, perturbed log p, log inclusion)."""
    with np.errstate(over="ignore", divide="ignore"):
        return _sample_texts(texts, keys, voc, samples)


def _sample_texts(texts: list[str], keys: np.ndarray, voc: Vocabulary, samples: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    codes, starts, sizes, bounds = split_words(texts)
    chosen, kinds = distinct_words(codes, starts, sizes)
    words = np.split(kinds, bounds[1:-1])
    lattice = Lattice(codes, starts[chosen], sizes[chosen], voc)
    seeds = wh.mix(wh.mix(keys.astype(np.int64).view(np.uint64)) + _GOLD)
    best = [-math.log(-math.log(u)) for u in _uniform(wh.mix(seeds)).tolist()]
    paths: list[list[_Path]] = [[] for _ in texts]
    # Where each text's next walk starts: (words left, node of a word begun, path so far).
    jobs = [(d, 0, None, None, [], 0.0, best[d]) for d in range(len(texts)) if len(words[d])]
    for turn in range(samples):
        if not jobs:
            break
        firsts, places = [], []
        for d, word, node, _, _, _, _ in jobs:
            first, place = lattice.first[words[d][word:]], np.arange(word, len(words[d]))
            if node is not None and node >= lattice.ends:  # go on inside a word
                first[0] = node
            elif node is not None:  # or after it
                first, place = first[1:], place[1:]
            firsts.append(first)
            places.append(place)
        own, ways, place = seeds[[job[0] for job in jobs]], [len(f) for f in firsts], np.concatenate(places)
        tags = np.repeat(wh.mix(own + np.uint64(turn + 1) * _ODD), ways) + (place + 1).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        counts, edges = lattice.walk(np.concatenate(firsts), tags)
        owners = np.repeat(place, counts)
        step = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *ways])].tolist()
        found = []
        for k, (seed, (_, _, _, before, *others)) in enumerate(zip(wh.mix(own ^ (np.uint64(turn + 1) * _GOLD)), jobs, strict=True)):
            parts, at = (owners[step[k] : step[k + 1]], edges[step[k] : step[k + 1]]), 0
            if before is not None:
                parts = [np.concatenate([x, y]) for x, y in zip(before, parts, strict=True)]
                at = len(before[0]) - 1
            found.append(_Path(*parts, at, *others, seed))
        _weigh(found, lattice.prob, samples + 1)
        for job, path in zip(jobs, found, strict=True):
            paths[job[0]].append(path)
        if turn + 1 < samples:
            picks = _uniform(wh.mix(seeds + np.uint64(turn + 1) * np.uint64(0xA24BAED4963EE407))).tolist()
            jobs = [job for d in range(len(texts)) if (job := _next(d, paths[d], lattice, picks[d], turn + 1))]
    return [_results(p, lattice, voc) for p in paths]


def _next(d: int, paths: list[_Path], lattice: Lattice, pick: float, turn: int):
    """Expand the best set left: the place where it turns off, and the piece taken there."""
    if not paths or len(paths) < turn:
        return None
    best = max(paths, key=lambda p: p.others.max())
    at = int(best.others.argmax())
    value = float(best.others[at])
    if math.isinf(value):
        return None
    best.others[at] = -np.inf
    edge = int(best.edge[at])
    barred = best.barred if at == best.turn and best.barred else [edge]
    node = int(np.searchsorted(lattice.start, edge, "right")) - 1
    first = int(lattice.start[node])
    odds = lattice.prob[first : int(lattice.start[node + 1])].copy()
    odds[np.array(barred) - first] = 0.0
    sums = np.cumsum(odds)
    edge = first + min(int((pick * sums[-1] >= sums).sum()), int(np.flatnonzero(odds > 0)[-1]))
    barred = [*barred, edge]
    before = [np.append(x[:at], y) for x, y in ((best.word, best.word[at]), (best.edge, edge))]
    return d, int(best.word[at]), int(lattice.target[edge]), before, barred, float(lattice.prob[barred].sum()), value


def _results(paths: list[_Path], lattice: Lattice, voc: Vocabulary) -> list[tuple[np.ndarray, float, float, float]]:
    if not paths:
        return [(np.empty(0, np.int32), 0.0, 0.0, 0.0)]
    kappa = max(float(p.others.max()) for p in paths)
    out = []
    for path in paths:
        gap = path.log_prob - kappa if not math.isinf(kappa) else math.inf
        share = gap if gap < -30 else math.log(-math.expm1(-math.exp(min(gap, 600.0))))
        out.append((_spell(lattice.ids[path.edge], voc), path.log_prob, path.value, share))
    return out


def _spell(ids: np.ndarray, voc: Vocabulary) -> np.ndarray:
    """Write characters without a piece in byte pieces."""
    spots = np.flatnonzero(ids < 0)
    if not len(spots):
        return ids
    parts, done = [], 0
    for k in spots:
        parts += [ids[done:k], voc.bytes[list(chr(-ids[k]).encode())]]
        done = k + 1
    return np.concatenate([*parts, ids[done:]])


class Spellings:
    """The bytes that each piece stands for."""

    def __init__(self, voc: Vocabulary):
        known = {k: text.replace(SPACE, " ").encode() for k, text in voc.texts.items()}
        known |= {int(k): bytes([b]) for b, k in enumerate(voc.bytes)}
        self.pieces = pa.array([known.get(k, b"") for k in range(max(known) + 1)], pa.large_binary())

    def texts(self, ids: pa.Array, bounds: np.ndarray) -> list[memoryview]:
        """The bytes of segmentations ids[bounds[i]:bounds[i + 1]], without the space that every text starts with."""
        spelled = self.pieces.take(ids)
        data = memoryview(spelled.buffers()[2] or b"")
        ends = np.frombuffer(spelled.buffers()[1], np.int64)[bounds].tolist()
        return [data[a + 1 : b] for a, b in zip(ends, ends[1:], strict=False)]


def decode_ids(ids: list[int], spellings: Spellings) -> str:
    """The text of a segmentation."""
    return str(spellings.texts(pa.array(ids, pa.int32()), np.array([0, len(ids)]))[0], "utf-8")


def _sample(voc: Vocabulary, samples: int, digest: bool):
    names = ["row", "sample", "ids", "log_prob", "perturbed", "log_inclusion", *(["text_sha256"] if digest else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spellings = Spellings(voc) if digest else None
        for batch in wh.small_batches(batches, "text_", SLICE):
            texts = batch.column("text_").fill_null("").to_pylist()
            keys = batch.column("key_").fill_null(0).to_numpy(zero_copy_only=False)
            found = sample_texts(texts, keys, voc, samples)
            counts = [len(f) for f in found]
            flat = [s for f in found for s in f]
            bounds = np.cumsum([0, *(len(s[0]) for s in flat)]).astype(np.int32)
            pieces = pa.array(np.concatenate([s[0] for s in flat]).astype(np.int32))
            ids = pa.ListArray.from_arrays(pa.array(bounds), pieces)
            rows = batch.column("row").take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            nth = pa.array([k for c in counts for k in range(c)], pa.int32())
            read = [pa.array([hashlib.sha256(t).hexdigest() for t in spellings.texts(pieces, bounds)], pa.string())] if digest else []
            yield pa.RecordBatch.from_arrays(
                [rows, nth, ids, *(pa.array([s[k] for s in flat], pa.float64()) for k in (1, 2, 3)), *read], names=names
            )

    return run


def encode_samples(
    df: DataFrame, model: str, key: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, keep: Column | None = None,
    digest: bool = False,
) -> DataFrame:
    """(row, sample, ids, log_prob, perturbed, log_inclusion): up to ``samples`` rows per row of ``df``.

    ``row`` is ``keep``, by default a struct of all columns.  With ``digest``
    every sample is decoded again where it was made, and ``text_sha256`` is the
    digest of what comes out.  The vocabulary
    (``model``, a file of the driver) goes along with the tasks.
    """
    rows = df.select(
        (F.struct("*") if keep is None else keep).alias("row"),
        df[key].cast("long").alias("key_"),
        df[text_col].cast("string").alias("text_"),
    )
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(
        _sample(Vocabulary(model), samples, digest),
        f"row {kind}, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double" + (", text_sha256 string" if digest else ""),
    )


def _decode(voc: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spellings = Spellings(voc)
        for batch in batches:
            texts = [decode_ids(ids.values.to_numpy(), spellings) if ids.is_valid else None for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return run


def decode(df: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """(row, text): every row of ``df`` with the text of its ids (null for null)."""
    rows = df.select(F.struct("*").alias("row"), df[ids_col].cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(Vocabulary(model)), f"row {rows.schema['row'].dataType.simpleString()}, text string")
