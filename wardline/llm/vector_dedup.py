"""Near-duplicate vectors of one label, by NN-descent.

Every vector keeps a list of its ``size`` most similar vectors.  The first
lists come from random-hyperplane buckets, as many as suit the label's size
and cut into chunks, and from random vectors of the label.
Then, round by round, each vector's neighbours (both ways, the reverse ones
sampled) are compared with each other, and lists take over what is closer,
until a round finds hardly any further link.  Pairs at the threshold or above
(cosine in double precision) are links.

A list that holds nothing but links is saturated and may miss others.  The
members of all components with a saturated vector are compared with each
other, block by block, also across the components of a label: a pair of blocks
is left out only if their middles are too far apart for any link.  Only counts
and pairs of components leave a block, so no list is ever written out whole,
and linked components become one.

An audit compares vectors of every label with all others of it, by full counts
and components.  Labels below ``recall`` go on with new hyperplanes and new
random vectors, under a larger audit each time; a label still below it after
three draws is compared block by block as a whole, which is exact.

Equal vectors of one label are one node with a count, so a vector that a third
of the rows share costs one entry.

Cases: vectors that are null, empty, zero or hold a null or non-finite
component, a null label or a null id are linked with nothing; vectors of
different lengths are not compared; rows that repeat an id count as vectors of
their own under that id.  Empty tables give empty results.  Other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import staged
from wardline.llm.components import components

THRESHOLD = 0.98
SIZE = 10  # neighbours in a list
TABLES = 6
CHUNK = 24
BLOCK = 256
TILE = 2048  # middles of blocks compared at once
ROUNDS = 6
AUDIT = 256
RECALL = 0.97
DRAWS = 3  # of hyperplanes, before a label is compared as a whole
_SLACK = 1e-4  # float32 navigation against the threshold in double


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values = values / np.abs(values).max()
    return values / np.sqrt(values @ values)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double and their float32 bytes."""
    for batch in batches:
        units = [unit(vector.values.to_numpy(zero_copy_only=False)) for vector in batch.column("vector")]
        keep = ["node", "label", "dim", "bits", "copies"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(units, pa.list_(pa.float64())), pa.array([u.astype(np.float32).tobytes() for u in units], pa.binary())],
            names=[*keep, "unit", "nav"],
        )


def _codes(tables: int, most: int, draw: int):
    """Bucket codes of the label's number of bits: ``tables`` by hyperplanes of this draw, and a random one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            codes = []
            for node, bits, vector in zip(batch.column("node").to_pylist(), batch.column("bits").to_pylist(), batch.column("unit"), strict=True):
                u = vector.values.to_numpy(zero_copy_only=False)
                if len(u) not in planes:
                    planes[len(u)] = np.random.default_rng((len(u), draw)).standard_normal((tables, most, len(u)))
                signs = planes[len(u)][:, :bits] @ u > 0
                chance = int(np.random.default_rng((node % 2**64, draw)).integers(1 << bits))
                codes.append([*(signs @ (1 << np.arange(bits, dtype=np.int64))), chance])
            keep = ["node", "label", "dim", "nav"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(codes, pa.list_(pa.int64()))], names=[*keep, "codes"])

    return run


def _groups(column: pa.ListArray) -> Iterator[tuple[pa.StructArray, int]]:
    for k in range(len(column)):
        yield column[k].values


def _matrix(entries: pa.StructArray, name: str) -> np.ndarray:
    rows = entries.field(name).to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1).astype(np.float64)


def _out(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.float64)
    columns = [np.concatenate([p[k] for p in parts]).astype(kind) if parts else np.empty(0, kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "other", "sim"])


def _first_lists(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for entries in _groups(batch.column("members")):
                ids = entries.field("node").to_numpy()
                vectors = _matrix(entries, "nav")
                sims = vectors @ vectors.T
                np.fill_diagonal(sims, -2.0)
                take = min(size, len(ids) - 1)
                best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
                rows = np.repeat(np.arange(len(ids)), take)
                parts.append((ids[rows], ids[best.ravel()], sims[rows, best.ravel()]))
            yield _out(parts)

    return run


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare a vector's neighbours with each other; give what improves a list."""
    for batch in batches:
        parts = []
        for entries in _groups(batch.column("members")):
            ids, worst = (entries.field(c).to_numpy() for c in ("other", "worst"))
            fresh = entries.field("fresh").to_numpy(zero_copy_only=False)
            vectors = _matrix(entries, "nav")
            sims = vectors @ vectors.T
            useful = (fresh[:, None] | fresh[None, :]) & (ids[:, None] != ids[None, :]) & (sims > worst[:, None])
            a, b = np.nonzero(useful)
            parts.append((ids[a], ids[b], sims[a, b]))
        yield _out(parts)


def _best(lists: DataFrame, size: int) -> DataFrame:
    """The ``size`` closest of each node; ties by the smaller id."""
    order = Window.partitionBy("node").orderBy(F.col("sim").desc(), "other")
    return lists.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size)


def _start(vectors: DataFrame, size: int, tables: int, draw: int) -> DataFrame:
    """(node, other, sim): the closest in buckets of this draw, cut into chunks."""
    most = vectors.agg(F.max("bits")).first()[0] or 0
    coded = vectors.select("node", "label", "dim", "bits", "unit", "nav").mapInArrow(_codes(tables, most, draw), "node long, label string, dim int, nav binary, codes array<long>")
    spread = staged(coded, "vector-codes").select("node", "label", "dim", "nav", F.posexplode("codes").alias("table", "code"))
    key = ["label", "dim", "table", "code"]
    chunks = spread.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / (2 * CHUNK)).cast("long").alias("chunks"))
    spread = spread.join(chunks, key).withColumn("chunk", F.pmod(F.xxhash64("node", "table", F.lit(draw)), F.col("chunks")))
    packed = spread.groupBy(*key, "chunk").agg(F.collect_list(F.struct("node", "nav")).alias("members")).where(F.size("members") > 1)
    first = packed.select("members").mapInArrow(_first_lists(size), "node long, other long, sim double")
    return first.where("node <> other").groupBy("node", "other").agg(F.max("sim").alias("sim"))


def _descend(lists: DataFrame, vectors: DataFrame, size: int, threshold: float, rounds: int) -> DataFrame:
    """Refine (node, other, sim, fresh) until hardly any link is new."""
    nav = vectors.select(F.col("node").alias("other"), "nav")
    for _ in range(rounds):
        worst = lists.groupBy("node").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("n"))
        worst = worst.select(F.col("node").alias("other"), F.when(F.col("n") >= size, F.col("low")).otherwise(-2.0).alias("worst"))
        back = lists.select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh")
        drawn = Window.partitionBy("node").orderBy(F.desc("fresh"), F.xxhash64("node", "other"))
        back = back.withColumn("nth", F.row_number().over(drawn)).where(F.col("nth") <= size).drop("nth")
        both = lists.select("node", "other", "fresh").union(back)
        both = both.groupBy("node", "other").agg(F.max("fresh").alias("fresh"))
        some = both.groupBy("node").agg(F.max("fresh").alias("any"), F.count(F.lit(1)).alias("n")).where("any and n > 1").select("node")
        both = both.join(some, "node").join(nav, "other").join(worst, "other", "left")
        packed = both.groupBy("node").agg(
            F.collect_list(F.struct("other", "fresh", F.coalesce("worst", F.lit(-2.0)).alias("worst"), "nav")).alias("members")
        )
        found = packed.select("members").mapInArrow(_local_join, "node long, other long, sim double")
        old = lists.select("node", "other", "sim", F.lit(False).alias("fresh"))
        # An entry is fresh if no list has held it before.
        merged = old.union(found.select("node", "other", "sim", F.lit(True))).groupBy("node", "other")
        merged = merged.agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        lists = staged(_best(merged, size).drop("nth"), "vector-lists")
        close = F.col("sim") >= threshold - _SLACK
        new, total = lists.agg(F.count_if(close & F.col("fresh")), F.count_if(close)).first()
        if new <= 0.001 * total:
            break
    return lists


def _cosine(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _checked_links(lists: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, with a cosine of at least the threshold in double precision."""
    pairs = lists.where(F.col("sim") >= threshold - _SLACK).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    unit_of = vectors.select("node", "unit")
    both = pairs.join(unit_of.toDF("a", "u"), "a").join(unit_of.toDF("b", "v"), "b")
    return both.where(_cosine("u", "v") >= threshold).select("a", "b")


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with a middle vector and the largest angle to it."""
    for batch in batches:
        middles, radii = [], []
        for entries in _groups(batch.column("members")):
            vectors = _units(entries)
            middle = vectors.sum(axis=0)
            length = np.sqrt(middle @ middle)
            middle = middle / length if length > 1e-6 else vectors[0]
            middles.append(middle)
            radii.append(float(np.arccos(np.clip(vectors @ middle, -1, 1)).max()))
        columns = [*batch.columns, pa.array(middles, pa.list_(pa.float64())), pa.array(radii, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "unit", "radius"])


def _near_blocks(threshold: float):
    """Pairs of blocks that may hold a link: no further apart than both radii and the link's own angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = math.acos(min(1.0, threshold)) + 1e-6
        for batch in batches:
            parts = []
            for k, entries in enumerate(_groups(batch.column("members"))):
                cells, blocks, radii, tiles = (entries.field(c).to_numpy() for c in ("cell", "block", "radius", "tile"))
                vectors = _units(entries)
                low, high = batch.column("low")[k].as_py(), batch.column("high")[k].as_py()
                rows, cols = np.flatnonzero(tiles == low), np.flatnonzero(tiles == high)
                angles = np.arccos(np.clip(vectors[rows] @ vectors[cols].T, -1, 1))
                i, j = np.nonzero(angles <= radii[rows][:, None] + radii[cols][None, :] + reach)
                i, j = rows[i], cols[j]
                if low == high:
                    i, j = i[i <= j], j[i <= j]
                parts.append((cells[i], blocks[i], cells[j], blocks[j]))
            columns = [np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "block", "cell2", "block2"])

    return run


def _units(entries: pa.StructArray) -> np.ndarray:
    return entries.field("unit").flatten().to_numpy(zero_copy_only=False).reshape(len(entries), -1)


def _block_links(threshold: float):
    """Links between two blocks: counts per member, and the pairs of different components they join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, edges = [], [], []
            for one, two, same in zip(_groups(batch.column("members")), _groups(batch.column("members2")), batch.column("same").to_pylist(), strict=True):
                (ids, copies, of), (ids2, copies2, of2) = ([e.field(c).to_numpy() for c in ("node", "copies", "component")] for e in (one, two))
                linked = _units(one) @ _units(two).T >= threshold
                if same:
                    np.fill_diagonal(linked, False)
                else:
                    xs.append(ids2)
                    ys.append(linked.T @ copies)
                    edges.append(np.zeros(len(ids2), bool))
                xs.append(ids)
                ys.append(linked @ copies2)
                edges.append(np.zeros(len(ids), bool))
                i, j = np.nonzero(linked & (of[:, None] != of2[None, :]))
                joined = np.unique(np.stack([of[i], of2[j]], axis=1), axis=0)
                xs.append(joined[:, 0])
                ys.append(joined[:, 1])
                edges.append(np.ones(len(joined), bool))
            flat = [np.concatenate(x).astype(kind) if x else np.empty(0, kind) for x, kind in ((xs, np.int64), (ys, np.int64), (edges, bool))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in flat], names=["x", "y", "edge"])

    return run


def _dealt(rows: DataFrame, key: list[str], of: list[str], name: str, room: int) -> DataFrame:
    """``rows`` with a number ``name``, so that about ``room`` rows of a key share it, and how many numbers there are."""
    sizes = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / room).cast("int").alias(f"{name}s"))
    return rows.join(sizes, key).withColumn(name, F.pmod(F.xxhash64(*of), F.col(f"{name}s")).cast("int"))


def _compared(members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, links) and (component, root) of members (cell, label, dim, node, component, copies, unit), exactly.

    Cells are cut into blocks.  All blocks of a label whose middles and radii
    do not rule out a link are compared, whatever their cells.
    """
    placed = _dealt(members, ["cell"], ["node"], "block", BLOCK)
    blocks = placed.groupBy("label", "dim", "cell", "block").agg(F.collect_list(F.struct("node", "component", "copies", "unit")).alias("members"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema) + ", unit array<double>, radius double"
    blocks = staged(blocks.mapInArrow(_block_rows, kind), "vector-blocks")
    middles = _dealt(blocks.select("label", "dim", "cell", "block", "unit", "radius"), ["label", "dim"], ["cell", "block"], "tile", TILE)
    middles = middles.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = middles.groupBy("label", "dim", F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high"))
    tiles = tiles.agg(F.collect_list(F.struct("cell", "block", "tile", "unit", "radius")).alias("members")).select("low", "high", "members")
    pairs = tiles.mapInArrow(_near_blocks(threshold), "cell long, block long, cell2 long, block2 long")
    whole = blocks.select("cell", "block", "members")
    both = pairs.join(whole, ["cell", "block"]).join(whole.toDF("cell2", "block2", "members2"), ["cell2", "block2"])
    both = both.select("members", "members2", F.expr("cell = cell2 and block = block2").alias("same"))
    found = both.mapInArrow(_block_links(threshold), "x long, y long, edge boolean")
    found = staged(found.groupBy("edge", "x", F.when(F.col("edge"), F.col("y")).alias("y")).agg(F.sum("y").alias("links")), "vector-compared")
    roots = staged(components(found.where("edge").select("x", "y")).toDF("component", "root"), "vector-roots")
    return found.where("not edge").select(F.col("x").alias("node"), "links"), roots


def _linked(lists: DataFrame, vectors: DataFrame, threshold: float, size: int, whole: DataFrame | None = None) -> DataFrame:
    """(node, component, links) of all vectors.

    Both ends of a link that a list has dropped are saturated, so the members of
    all components with a saturated vector are compared with each other, and
    the components that turn out to be linked become one.  So are all vectors
    of the labels in ``whole`` (label, dim).
    """
    links = staged(_checked_links(lists, vectors, threshold), "vector-links")
    classes = vectors.select("node").join(components(links).toDF("node", "component"), "node", "left")
    classes = staged(classes.select("node", F.coalesce("component", "node").alias("component")), "vector-classes")
    full = lists.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low"))
    full = full.where((F.col("n") >= size) & (F.col("low") >= threshold - _SLACK)).select("node")
    crowded = classes.join(full, "node").select("component")
    if whole is not None:
        every = vectors.join(whole, ["label", "dim"], "left_semi").select("node")
        crowded = crowded.union(classes.join(every, "node").select("component"))
    crowded = staged(crowded.distinct(), "vector-crowded")
    members = classes.join(crowded, "component").join(vectors.select("label", "dim", "node", "copies", "unit"), "node")
    members = members.withColumn("cell", F.col("component"))
    if whole is not None:  # one cell a label: single vectors would be a block each
        least = vectors.join(whole, ["label", "dim"], "left_semi").groupBy("label", "dim").agg(F.min("node").alias("least"))
        members = members.join(least, ["label", "dim"], "left").withColumn("cell", F.coalesce("least", "cell")).drop("least")
    dense, roots = _compared(members, threshold)
    ends = links.union(links.select("b", "a")).toDF("node", "other").join(classes.join(crowded, "component", "left_anti").select("node"), "node")
    sparse = ends.join(vectors.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(F.sum("copies").alias("links"))
    out = classes.join(roots, "component", "left").join(dense.union(sparse), "node", "left")
    return staged(out.select("node", F.coalesce("root", "component").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "vector-linked")


def _audit(dictionary: dict, threshold: float):
    """Links of the audited vectors among all rows of a batch, counted by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict = {}
            for node, label, dim, copies, component, unit in zip(*batch.columns, strict=True):
                ids, vectors = dictionary.get((label.as_py(), dim.as_py()), ((), None))
                if len(ids):
                    for k in np.flatnonzero(vectors @ unit.values.to_numpy(zero_copy_only=False) >= threshold):
                        if ids[k] != node.as_py():
                            key = (ids[k], component.as_py())
                            found[key] = found.get(key, 0) + copies.as_py()
            columns = zip(*((*key, n) for key, n in found.items()), strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "component", "n"])

    return run


def audited(linked: DataFrame, vectors: DataFrame, threshold: float, audit: int = AUDIT) -> DataFrame:
    """(label, dim, n, held): true links of audited vectors, and those counted and inside the component.

    Of each label 64 vectors of least hash, or more if ``audit`` is larger, but
    no more than 16 * AUDIT in all.
    """
    groups = vectors.select("label", "dim").distinct().count()
    order = Window.partitionBy("label", "dim").orderBy(F.xxhash64("node", F.lit(7)))
    chosen = vectors.select("node", "label", "dim", "unit").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(64, math.ceil(audit / max(1, groups))))
    by_group: dict = {}
    for row in chosen.orderBy(F.xxhash64("node", F.lit(7))).limit(16 * AUDIT).collect():
        by_group.setdefault((row["label"], row["dim"]), []).append((row["node"], np.array(row["unit"])))
    dictionary = {k: ([n for n, _ in v], np.stack([x for _, x in v])) for k, v in by_group.items()}
    rows = vectors.join(linked.select("node", "component"), "node").select("node", "label", "dim", "copies", "component", "unit")
    true = rows.mapInArrow(_audit(dictionary, threshold), "node long, component long, n long")
    true = true.withColumnRenamed("component", "of").join(linked, "node").groupBy("node")
    true = true.agg(F.sum("n").alias("n"), F.first("links").alias("got"), F.sum(F.when(F.col("of") == F.col("component"), F.col("n")).otherwise(0)).alias("near"))
    true = true.join(vectors.select("node", "label", "dim"), "node").groupBy("label", "dim")
    return staged(true.agg(F.sum("n").alias("n"), F.sum(F.least("got", "near", "n")).alias("held")), "vector-audit")


def _missed(audit: DataFrame, vectors: DataFrame, recall: float) -> DataFrame:
    """(label, dim) whose audited links are held too seldom; without links seen, a label goes by the share of all."""
    low = audit.where(F.col("held") < recall * F.col("n")).select("label", "dim")
    n, held = audit.agg(F.sum("n"), F.sum("held")).first()
    if n and held < recall * n:
        low = low.union(vectors.select("label", "dim").distinct().join(audit, ["label", "dim"], "left_anti"))
    return staged(low, "vector-missed")


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
    size: int = SIZE, tables: int = TABLES, rounds: int = ROUNDS, recall: float = RECALL,
) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id (smallest id reachable), kept (vec_id = component_id)."""
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[label_col].cast("string").alias("label"), df[vector_col].cast("array<double>").alias("vector"))
    linkable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector")))
    nodes = linkable.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # Ids may repeat, so equal vectors of a label get a number of their own.
    nodes = nodes.withColumns({"dim": F.size("vector"), "node": F.monotonically_increasing_id()})
    nodes = staged(nodes, "vector-nodes")
    counts = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    # A label that fits into one chunk has a single bucket.
    bits = F.when(F.col("n") <= 2 * CHUNK, 0).otherwise(F.ceil(F.log2(F.col("n") / CHUNK + 1))).cast("int")
    sized = nodes.join(counts.select("label", "dim", bits.alias("bits")), ["label", "dim"])
    kind = "node long, label string, dim int, bits int, copies long, unit array<double>, nav binary"
    vectors = staged(sized.select("node", "label", "dim", "bits", "copies", "vector").mapInArrow(_prepare, kind), "vectors")

    lists = staged(_best(_start(vectors, size, tables, 0), size).drop("nth").withColumn("fresh", F.lit(True)), "vector-lists")
    lists = _descend(lists, vectors, size, threshold, rounds)
    linked = _linked(lists, vectors, threshold, size)
    for draw in range(1, DRAWS + 1):
        missed = _missed(audited(linked, vectors, threshold, AUDIT * 4 ** (draw - 1)), vectors, recall)
        if missed.isEmpty():
            break
        if draw < DRAWS:
            again = staged(vectors.join(missed, ["label", "dim"], "left_semi"), "vectors-again")
            own = again.select("node")
            old = lists.join(own, "node", "left_semi").select("node", "other", "sim", F.lit(False).alias("fresh"))
            more = old.union(_start(again, size, tables, draw).withColumn("fresh", F.lit(True))).groupBy("node", "other")
            more = staged(_best(more.agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh")), size).drop("nth"), "vector-lists")
            more = _descend(more, again, size, threshold, rounds)
            lists = staged(lists.join(own, "node", "left_anti").select(*more.columns).union(more), "vector-lists")
            linked = _linked(lists, vectors, threshold, size)
        else:
            linked = _linked(lists, vectors, threshold, size, missed)

    named = staged(nodes.select("node", "label", "vector", "copies", "least").join(linked, "node"), "vector-named")
    firsts = staged(named.groupBy("component").agg(F.min("least").alias("first")), "vector-firsts")
    named = named.join(firsts, "component").select(
        "label", "vector", F.col("first").alias("component"), (F.col("links") + F.col("copies") - 1).alias("n_links")
    )
    out = rows.withColumn("ok", F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector")))
    linked = out.where("ok").join(named, ["label", "vector"]).select("vec_id", "n_links", "component")
    alone = out.where("not ok").select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    return linked.union(alone).select(
        "vec_id",
        "n_links",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"),
    )
