"""Hard negatives: scores bounded along spanning trees of the anchors.

Anchors are the stated query set; they are taken in passes of bounded size, each against all rows. In a pass they
form trees of near anchors (a minimum spanning tree for each block). For a batch of rows the root is
scored exactly. A child's score differs from its parent's by the row's product with their difference, so it lies
within edge length times the row's norm of what is known for the parent. Only rows whose bounds overlap
the window of scores that still matters are scored again; bounds never decide a result, exact scores do.

Two runs over the rows for each pass: the first finds each anchor's positives (the window starts at the
worst positive so far), the second the negatives for all its positives (the window is that of the
similarity shares, raised by the worst of the negatives found so far). Tasks keep a few rows for each anchor,
and a top-k window over anchors joins what they found. The driver holds one pass of anchors and their positives.

Components are whole numbers after scaling. Products are exact: in doubles where they stay below
2**53, else in Python's integers; a score beyond a long is an error.

Edge cases: rows with a null id, a null label, a null vector, or a null or non-finite component take no part; a
vector shorter than an anchor counts as filled up with zeros, empty ones too, and what is longer meets zeros; ties go
to the smaller id; repeated rows are candidates each; rows that share the anchor's id are never its
positives or negatives, and of repeated anchors the one with the smallest label and vector counts; anchors without
positives or with an empty window give no rows, nor does an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.operators.ranking import with_row_id
from alertloom.session import scratch_path
from llm.common import landed, ship

#: Anchors in a tree, anchors in a pass, and bytes of a pass's vectors; the driver and every task hold one pass.
TREE, PASS, PASS_BYTES = 512, 8192, 1 << 25
#: Rows whose bounds are kept together; with TREE, bounds what a task holds for them.
BLOCK_ROWS = 4096
EXACT = float(1 << 53)

FOUND = "anchor_id long, place int, positive_id long, positive_score long, id long, score long"


def spanning_tree(vectors: np.ndarray) -> list[tuple[int, int, float, bool, bool]]:
    """(anchor, parent, edge length, whether its parent's bounds are used for the last time, whether its own
    are used), parents first.

    A minimum spanning tree; the root, with parent -1, is the vector nearest to the mean.
    """
    n, unit = len(vectors), max(1.0, float(np.abs(vectors).max(initial=0)))
    vectors = vectors / unit  # so that squares stay finite
    root = int(np.argmin(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1)))
    near, parent = np.full(n, np.inf), np.full(n, -1)
    children: list[list[int]] = [[] for _ in range(n)]
    outside = np.ones(n, bool)
    new = root
    for _ in range(n - 1):
        outside[new] = False
        d = np.sqrt(((vectors - vectors[new]) ** 2).sum(axis=1))
        closer = outside & (d < near)
        near[closer], parent[closer] = d[closer], new
        new = int(np.argmin(np.where(outside, near, np.inf)))
        children[parent[new]].append(new)
    order, stack = [], [(root, False)]
    while stack:
        at, last = stack.pop()
        order.append((at, int(parent[at]), float(near[at]) * unit if at != root else 0.0, last, bool(children[at])))
        # The last child pushed comes first.
        stack += [(c, i == 0) for i, c in enumerate(children[at])]
    return order


class _Pass:
    """The anchors of a pass, ready for the tasks."""

    def __init__(self, ids, labels, vectors: np.ndarray, windows=None):
        self.ids, self.labels, self.vectors, self.windows = ids, labels, vectors, windows
        self.largest = float(np.abs(vectors).max(initial=0))
        self.trees = []
        for lo in range(0, len(ids), TREE):
            self.trees.append([(lo + a, lo + p if p >= 0 else -1, *x) for a, p, *x in spanning_tree(vectors[lo : lo + TREE])])


def _vectors(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, `width` components each."""
    offsets = column.offsets.to_numpy()
    flat = np.floor(scale * column.values.to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = np.minimum(np.diff(offsets), width)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = flat[np.repeat(offsets[:-1], sizes) + at]
    return out


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(BLOCK_ROWS)
            held, rows = [], 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(BLOCK_ROWS)


def _products(rows: np.ndarray, anchor: np.ndarray, small: bool) -> np.ndarray:
    if small:
        return rows @ anchor
    whole = [int(x) for x in anchor]
    return np.array([sum(a * int(b) for a, b in zip(whole, r, strict=True)) for r in rows.tolist()], object)


def _by_score(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), np.int64)
    return np.lexsort((ids, -scores))


class _Best:
    """The first k rows by score, then by id, of those it was given."""

    __slots__ = ("k", "scores", "ids")

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = _by_score(scores, ids)[: self.k]
        self.scores, self.ids = scores[first], ids[first]


def _walked(batches, anchors: _Pass, scale: float, wanted: Callable, take: Callable) -> None:
    """Score the rows that may matter for each anchor. `wanted(anchor, labels, ids)` gives a mask of the rows, the
    lowest and highest score of interest (None: nothing is); `take(anchor, scores, ids)` gets what was scored."""
    width = anchors.vectors.shape[1]
    for block in _blocks(batches):
        ids, labels = block.column(0).to_numpy(), block.column(1).to_numpy()
        rows = _vectors(block.column(2), width, scale)
        norms = np.sqrt((rows * rows).sum(axis=1)) * (1 + 1e-9)
        small = anchors.largest * float(np.abs(rows).max(initial=0)) * max(1, width) < EXACT
        for tree in anchors.trees:
            bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for a, parent, length, last, used in tree:
                found = wanted(a, labels, ids)
                if not small or parent < 0:
                    # Large products go without bounds.
                    below = above = None
                    at = np.arange(len(ids)) if small else np.flatnonzero(found[0]) if found else np.zeros(0, np.int64)
                else:
                    below, above = bounds.pop(parent) if last else bounds[parent]
                    reach = length * (1 + 1e-9) * norms + 1
                    below, above = below - reach, above + reach
                    at = np.flatnonzero(found[0] & (above >= found[1]) & (below <= found[2])) if found else np.zeros(0, np.int64)
                scores = _products(rows[at], anchors.vectors[a], small)
                if small and used:
                    below, above = (scores, scores) if below is None else (below, above)
                    below[at], above[at] = scores, scores
                    bounds[a] = (below, above)
                if small and parent < 0:
                    at = np.flatnonzero(found[0]) if found else np.zeros(0, np.int64)
                    scores = scores[at]
                if len(at):
                    take(a, scores, ids[at])


def _positives(batches, shared, scale: float, k: int) -> Iterator[pa.RecordBatch]:
    anchors = shared.value
    best = [_Best(k) for _ in anchors.ids]

    def wanted(a, labels, ids):
        return (labels == anchors.labels[a]) & (ids != anchors.ids[a]), best[a].least, np.inf

    _walked(batches, anchors, scale, wanted, lambda a, scores, ids: best[a].add(scores, ids))
    yield _batch((anchors.ids[a], 0, None, None, i, s) for a, b in enumerate(best) for s, i in zip(b.scores.tolist(), b.ids.tolist()))


def _negatives(batches, shared, scale: float, k: int) -> Iterator[pa.RecordBatch]:
    anchors = shared.value
    best = [[_Best(k) for _ in windows] for windows in anchors.windows]

    def wanted(a, labels, ids):
        windows = anchors.windows[a]
        if not windows:
            return None
        low = min(max(w[3], b.least) for w, b in zip(windows, best[a]))
        return (labels != anchors.labels[a]) & (ids != anchors.ids[a]), low, max(w[4] for w in windows)

    def take(a, scores, ids):
        order = _by_score(scores, ids)
        scores, ids = scores[order], ids[order]
        for (_, _, _, low, high), b in zip(anchors.windows[a], best[a]):
            inside = np.flatnonzero((scores >= max(low, b.least)) & (scores <= high))[:k]
            if len(inside):
                b.add(scores[inside], ids[inside])

    _walked(batches, anchors, scale, wanted, take)
    yield _batch(
        (anchors.ids[a], w[0], w[1], w[2], i, s)
        for a, windows in enumerate(anchors.windows)
        for w, b in zip(windows, best[a])
        for s, i in zip(b.scores.tolist(), b.ids.tolist())
    )


def _batch(rows) -> pa.RecordBatch:
    rows = [(int(a), place, p, ps, int(i), int(s)) for a, place, p, ps, i, s in rows]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) or [()] * 6
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["anchor_id", "place", "positive_id", "positive_score", "id", "score"])


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _usable(vector: Column) -> Column:
    def fine(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return vector.isNotNull() & F.forall(vector, fine)


def _scaled(vectors: list, scale: float) -> np.ndarray:
    out = np.zeros((len(vectors), max([1, *map(len, vectors)])))
    for row, v in zip(out, vectors):
        row[: len(v)] = np.floor(scale * np.array(v, np.float64))
    return out


def mine_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    scale: float = 256.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `rows` has id, label, vector; `is_anchor` says which ids are anchors. An anchor's positives are its best
    `positives` rows of the same label; a positive's negatives the best `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = rows.sparkSession
    ship(spark)
    plain = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>"))
    plain = plain.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector")))
    own = plain.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("least")).select("id", "least.*")
    numbered = landed(with_row_id(own, ["label", "id"]), "anchors")
    about = numbered.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    step = max(1, min(PASS, PASS_BYTES // (8 * max(1, about["width"] or 1))))
    path = scratch_path(spark, "negatives")
    out = "anchor_id long, place int, positive_id long, positive_score long, id long, score long, rank int"
    spark.createDataFrame([], out).write.parquet(path)
    for start in range(0, about["n"], step):
        some = numbered.where((F.col("row_id") >= start) & (F.col("row_id") < start + step)).orderBy("row_id").collect()
        ids, labels = (np.array([r[c] for r in some], np.int64) for c in ("id", "label"))
        anchored = _Pass(ids, labels, _scaled([r.vector for r in some], scale))
        shared = spark.sparkContext.broadcast(anchored)
        near = plain.mapInArrow(partial(_positives, shared=shared, scale=scale, k=positives), FOUND)
        windows: dict[int, list] = {int(i): [] for i in ids}
        for r in _first(near, ["anchor_id"], positives).collect():
            # The smallest and largest whole scores inside the shares.
            bounds = -(-low * r.score // 100), high * r.score // 100
            if bounds[0] <= bounds[1]:
                windows[r.anchor_id].append((r["rank"], r.id, r.score, *bounds))
        anchored.windows = [windows[int(i)] for i in ids]
        both = spark.sparkContext.broadcast(anchored)
        far = plain.mapInArrow(partial(_negatives, shared=both, scale=scale, k=negatives), FOUND)
        _first(far, ["anchor_id", "place"], negatives).select("anchor_id", "place", "positive_id", "positive_score", "id", "score", "rank").write.mode(
            "append"
        ).parquet(path)
        shared.destroy()
        both.destroy()
    found = spark.read.schema(out).parquet(path)
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
