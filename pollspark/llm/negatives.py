"""Hard negatives by largest inner product: a cover tree per shard over norm-augmented vectors.

A component that makes all norms of a shard equal turns the largest inner product into the least distance. A node of
the tree covers its points within a radius; its children cover them within half of it, down to buckets of few points.
For an anchor q at distance d from a node's centre, with radius r and common norm m, every inner product below the
node lies between (q.q + m.m - (d + r)^2) / 2 and (q.q + m.m - max(0, d - r)^2) / 2. The search opens the node with
the best upper bound first, skips nodes outside every window still wanted, and takes exact products in the buckets.

Distinct vectors are dealt to shards of bounded size by hash; a task holds one shard's tree and lets all anchors
stream through it, so memory is bounded, while the work is the product of anchors and shards less what the bounds
skip. Equal vectors are one point with the few smallest ids of each label, which is all that the results can need.

Results for unusual input: rows with a null id, label, vector or component, or a non-finite one, and empty vectors take
no part; a row meets only vectors of its length; equal rows count once; rows that share an anchor's id are neither its
positives nor its negatives; rows that differ under one id are anchors of their own; fewer rows than asked for come back
as they are; a negative or missing positive score has no negatives; an empty table gives an empty result; other columns
are ignored. Scores have to fit 53 bits, that is, scaled vectors of norm up to about 9e7.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pollspark.llm.common import stored

SHARD = 4096
BUCKET = 32
BATCH_ROWS = 1024


class CoverTree:
    """Points in tree order as one matrix; nodes as flat arrays over spans of it.

    A node's own points stand first in its span, up to ``bucket``; its children, numbered ``first_child`` to
    ``last_child``, share the rest.
    """

    ARRAYS = ("points", "order", "centre", "radius", "low", "bucket", "first_child", "last_child")

    def __init__(self, points: np.ndarray, order: np.ndarray, centre: np.ndarray, radius: np.ndarray, low: np.ndarray, bucket: np.ndarray,
                 first_child: np.ndarray, last_child: np.ndarray):
        self.points, self.order, self.centre, self.radius, self.low = points, order, centre, radius, low
        self.bucket, self.first_child, self.last_child = bucket, first_child, last_child
        self.norm2 = float(np.einsum("ij,ij->i", points, points).max(initial=0.0))

    @classmethod
    def build(cls, vectors: np.ndarray) -> CoverTree:
        x = vectors.astype(np.float64)
        norms = np.einsum("ij,ij->i", x, x)
        high = np.append(x, np.sqrt(norms.max(initial=0.0) - norms)[:, None], 1)
        order: list[np.ndarray] = []
        nodes: list[list[float]] = [[0, 0.0, 0, 0, 0, 0]]  # centre, radius, low, bucket, first_child, last_child
        waiting = [(0, np.arange(len(x)), 0)]  # node, its points, where its span begins
        while waiting:
            node, own, low = waiting.pop()
            middle = own[0]
            far = np.sqrt(((high[own] - high[middle]) ** 2).sum(1))
            radius = float(far.max(initial=0.0))
            alone, groups = (own, []) if len(own) <= BUCKET else cls._halve(high, own, radius / 2)
            nodes[node] = [middle, radius, low, low + len(alone), len(nodes), len(nodes) + len(groups)]
            order.append((low, alone))
            low += len(alone)
            for group in groups:
                waiting.append((len(nodes), group, low))
                nodes.append([0, 0.0, 0, 0, 0, 0])
                low += len(group)
        place = np.concatenate([part for _, part in sorted(order, key=lambda o: o[0])]) if len(x) else np.zeros(0, np.int64)
        table = np.array(nodes)
        whole = table[:, [0, 2, 3, 4, 5]].astype(np.int64)
        return cls(x[place], place, x[whole[:, 0]] if len(x) else x, table[:, 1], *whole[:, 1:].T)

    @staticmethod
    def _halve(high: np.ndarray, own: np.ndarray, radius: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Points cut into groups within ``radius`` of a member; points without company are returned apart."""
        x = high[own].astype(np.float32)
        square = np.einsum("ij,ij->i", x, x)
        left, alone, groups = np.ones(len(own), bool), [], []
        for first in range(0, len(own), 1024):  # distances of a block of possible centres to all
            apart = square[first:first + 1024, None] + square - 2 * (x[first:first + 1024] @ x.T)
            for i, row in enumerate(apart, first):
                if left[i]:
                    near = left & (row <= radius * radius)
                    near[i] = True
                    left &= ~near
                    (alone if near.sum() == 1 else groups).append(own[np.flatnonzero(near)])
        # Rounding may leave one group of all: a radius that is measured anew for each child has to shrink.
        if len(groups) == 1 and not alone:
            half = len(own) // 2
            groups = [own[:half], own[half:]]
        return np.concatenate(alone) if alone else own[:0], groups

    def descend(self, q: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray], verify: Callable[[int, np.ndarray], None]) -> int:
        """Open nodes by their upper bounds, best first; the number of points whose product was taken.

        ``wanted(lowest, highest)`` says which spans of scores can still matter; ``verify(at, scores)`` takes the exact
        products of the points from ``at`` on.
        """
        if not len(self.points):
            return 0
        own, taken = float(q @ q), 0
        slack = 0.5 + 1e-9 * (own + self.norm2)

        def bounds(nodes: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            apart = np.sqrt(np.maximum(own + self.norm2 - 2 * (self.centre[nodes] @ q), 0))
            r = self.radius[nodes]
            total = own + self.norm2
            return (total - (apart + r) ** 2) / 2 - slack, (total - np.maximum(apart - r, 0) ** 2) / 2 + slack

        low, high = bounds(slice(0, 1))
        heap = [(-high[0], low[0], 0)]
        while heap:
            high0, low0, node = heapq.heappop(heap)
            if not wanted(np.array([low0]), np.array([-high0]))[0]:
                continue
            start, end = self.low[node], self.bucket[node]
            if end > start:
                verify(start, self.points[start:end] @ q)
                taken += end - start
            first, last = self.first_child[node], self.last_child[node]
            if last > first:
                low, high = bounds(slice(first, last))
                for i in np.flatnonzero(wanted(low, high)):
                    heapq.heappush(heap, (-high[i], low[i], first + int(i)))
        return taken


def scaled_rows(rows: DataFrame, scale: int, relabel: Column | None, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector as whole numbers) of the rows that take part."""
    whole = F.transform(vector_col, lambda v: F.floor(v.cast("double") * scale))
    fits = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) \
        & F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    label = F.col(label_col) if relabel is None else relabel
    return rows.where(F.coalesce(fits, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("vector"))


def build_trees(rows: DataFrame, ids_kept: int, shard: int = SHARD) -> DataFrame:
    """(dim, shard, and a tree's arrays, labels and ids as binaries) of ``scaled_rows``, one row per shard, stored."""
    named = rows.select("*", F.size("vector").alias("dim"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    # The first ids of each vector and label are found on the map side too, so copies of one vector stay few.
    rank = F.row_number().over(W.partitionBy("h1", "h2", "label").orderBy("id"))
    few = named.distinct().withColumn("rank", rank).where(F.col("rank") <= ids_kept)
    points = stored(few.groupBy("dim", "h1", "h2").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list(F.struct("label", "id"))).alias("held")),
                    "scaled-vectors")
    shards = points.groupBy("dim").agg(F.ceil(F.count("*") / shard).alias("shards"))  # one row per length of vectors
    dealt = points.join(shards, "dim").withColumn("shard", F.pmod("h1", "shards").cast("int"))
    total = shards.agg(F.sum("shards")).first()[0] or 1
    dealt = dealt.repartition(min(int(total), 100_000), "dim", "shard")

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("h1", "ascending"), ("h2", "ascending")])  # the same tree on every run
        dim = group["dim"][0].as_py()
        tree = CoverTree.build(group["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dim))
        held = group["held"].combine_chunks().take(pa.array(tree.order))
        flat = held.flatten()
        data = {"dim": dim, "shard": group["shard"][0].as_py(), "n_held": np.diff(held.offsets.to_numpy()).astype("<i4").tobytes(),
                "labels": flat.field("label").to_numpy().astype("<i8").tobytes(), "ids": flat.field("id").to_numpy().astype("<i8").tobytes(),
                "points": tree.points.astype("<f8").tobytes(), "centre": tree.centre.astype("<f8").tobytes(), "radius": tree.radius.astype("<f8").tobytes(),
                "spans": np.stack([tree.low, tree.bucket, tree.first_child, tree.last_child]).astype("<i8").tobytes()}
        return pa.Table.from_pylist([data], pa.schema([("dim", pa.int32()), ("shard", pa.int32())] + [(c, pa.binary()) for c in list(data)[2:]]))

    schema = "dim int, shard int, n_held binary, labels binary, ids binary, points binary, centre binary, radius binary, spans binary"
    return stored(dealt.groupBy("dim", "shard").applyInArrow(build, schema), "cover-trees")


class Shard:
    """A tree with the labels and ids of its points."""

    def __init__(self, row: dict):
        number = lambda c, kind: np.frombuffer(row[c], kind)
        points = number("points", "<f8").reshape(-1, row["dim"])
        low, bucket, first, last = number("spans", "<i8").reshape(4, -1)
        self.tree = CoverTree(points, np.arange(len(points)), number("centre", "<f8").reshape(-1, row["dim"]), number("radius", "<f8"), low, bucket, first, last)
        self.tree.norm2 = float(np.einsum("ij,ij->i", points, points).max(initial=0.0))
        self.count = number("n_held", "<i4").astype(np.int64)
        self.start = np.append(0, np.cumsum(self.count))
        self.labels, self.ids = number("labels", "<i8"), number("ids", "<i8")

    def _entries(self, at: int, scores: np.ndarray) -> tuple[np.ndarray, slice]:
        end = at + len(scores)
        return np.repeat(scores, self.count[at:end]), slice(self.start[at], self.start[end])

    def best(self, q: np.ndarray, own: int, windows: list[tuple[float, float]], keep: int, takes: Callable[[np.ndarray], np.ndarray]) -> list[list[tuple[int, int]]]:
        """For each window of scores the first (score, id) in it, highest first, ties to the smaller id.

        ``takes`` chooses by label; ``own`` is left out.
        """
        top: list[list[tuple[float, int]]] = [[] for _ in windows]
        floor = np.array([w[0] for w in windows], float)
        ceiling = np.array([w[1] for w in windows], float)

        def wanted(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return ((high[:, None] >= floor) & (low[:, None] <= ceiling)).any(1)

        def verify(at: int, scores: np.ndarray) -> None:
            score, span = self._entries(at, scores)
            good = np.flatnonzero((score >= floor.min()) & (score <= ceiling.max()) & takes(self.labels[span]) & (self.ids[span] != own))
            if not len(good):
                return
            score, ids = score[good], self.ids[span][good]
            for w, found in enumerate(top):
                inside = np.flatnonzero((score >= floor[w]) & (score <= ceiling[w]))
                if len(inside):
                    first = inside[np.lexsort((ids[inside], -score[inside]))[:keep]]
                    found[:] = sorted(found + list(zip((-score[first]).tolist(), ids[first].tolist())))[:keep]
                    if len(found) == keep:
                        floor[w] = max(floor[w], -found[-1][0])

        self.tree.descend(q, wanted, verify)
        return [[(int(-s), i) for s, i in found] for found in top]


def _through_shards(trees: DataFrame, anchors: DataFrame, meet: Callable[[Shard, dict], Iterator[dict]], sql: str, arrow: pa.Schema) -> DataFrame:
    """``meet(shard, anchor)`` for every anchor and shard of its length.

    A partition is read in order: a shard's tree, then its anchors, so one tree and one batch of anchors are held.
    """
    shape = trees.groupBy("dim").agg(F.max("shard").alias("last"))
    asked = anchors.join(shape, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), "last"))).drop("last").withColumn("asks", F.lit(True))
    both = trees.withColumn("asks", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    parts = trees.count()  # one row per shard
    dealt = both.repartition(max(1, min(parts, 100_000)), "dim", "shard").sortWithinPartitions("dim", "shard", "asks", "id")
    names = anchors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out = None, []
        for batch in batches:
            asks = batch.column("asks").to_pylist()
            wide = batch.select(names)
            for i, ask in enumerate(asks):
                if not ask:
                    shard = Shard(batch.slice(i, 1).to_pylist()[0])
                elif shard is not None:
                    out += meet(shard, wide.slice(i, 1).to_pylist()[0])
            if len(out) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return dealt.mapInArrow(run, sql)


def mine(rows: DataFrame, *, anchor: Column, scale: int = 256, relabel: Column | None = None, positives: int = 5, negatives: int = 5,
         least: tuple[int, int] = (4, 5), shard: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` chooses anchors by the column ``id``; ``relabel`` is an expression over the original columns. Negatives
    score at most as high as the positive and at least ``least`` (numerator, denominator) of it.
    """
    own = scaled_rows(rows, scale, relabel, id_col, vector_col, label_col)
    trees = build_trees(own, max(positives, negatives) + 1, shard)
    anchors = stored(own.where(anchor).distinct().select(F.size("vector").alias("dim"), F.xxhash64("id", "label", "vector").alias("key"), "id", "label", "vector"),
                     "anchors")

    def near(s: Shard, a: dict) -> Iterator[dict]:
        q, label = np.array(a["vector"], float), a["label"]
        for score, i in s.best(q, a["id"], [(-np.inf, np.inf)], positives, lambda labels: labels == label)[0]:
            yield {"key": a["key"], "id": a["id"], "positive_id": i, "positive_score": score}

    long = pa.int64()
    found = _through_shards(trees, anchors, near, "key long, id long, positive_id long, positive_score long",
                            pa.schema([("key", long), ("id", long), ("positive_id", long), ("positive_score", long)]))
    order = W.partitionBy("key", "id").orderBy(F.desc("positive_score"), "positive_id")
    best = stored(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")
    windows = best.groupBy("key", "id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    up, down = least

    def hard(s: Shard, a: dict) -> Iterator[dict]:
        q, label = np.array(a["vector"], float), a["label"]
        kept = [p for p in a["positives"] if p["positive_score"] >= 0]
        spans = [(-(-up * p["positive_score"] // down), p["positive_score"]) for p in kept]
        if spans:
            for p, scores in zip(kept, s.best(q, a["id"], spans, negatives, lambda labels: labels != label)):
                for score, i in scores:
                    yield {"key": a["key"], "anchor_id": a["id"], **p, "negative_id": i, "negative_score": score}

    names = ["key", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
    mined = _through_shards(trees, anchors.join(windows, ["key", "id"]), hard, ", ".join(f"{c} {'int' if c == 'place' else 'long'}" for c in names),
                            pa.schema([(c, pa.int32() if c == "place" else long) for c in names]))
    order = W.partitionBy("key", "anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    return mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives) \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
