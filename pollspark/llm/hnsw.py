"""Approximate nearest neighbours by largest inner product: one navigable small-world graph per shard.

Distinct vectors are dealt to shards of a bounded size by hash. A shard's graph has levels: a random 16th of
each level's nodes is also on the next. On each level a node keeps neighbours chosen for closeness and spread
from its nearest candidates, plus the links that others chose to it. Vectors are extended by one component
that makes all norms of a shard equal, so that the largest inner product is also the least distance. The
graphs are stored as flat arrays in the shared folder. Every query searches every shard, in blocks of
(shard, block of queries); shard results are merged per query after an exact rescoring in double precision.
A batch of queries walks a shard's graph together, each along its own path.

Equal vectors are one node with its k + 1 smallest ids, which is all that k results can need.

Results for unusual input: vectors that are null, empty, zero, or hold null or non-finite components take no
part, neither as queries nor as candidates; a query meets only vectors of its length; rows that share a
query's id are its own; with fewer candidates than k all that are found come back; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pollspark.llm.common import stored

SHARD = 8192
LINKS = 16
CANDIDATES = 64
WIDTH = 128
STEP = 4  # nodes of a path that are opened at once
BATCH = 256  # queries that walk together
QUERY_BLOCK = 2048


class Graph:
    """Levels of neighbours as flat arrays: for each level its nodes and a matrix of node numbers, -1 where none."""

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.levels = vectors, levels
        norms = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
        self.extended = np.append(vectors, np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0))[:, None], 1).astype(np.float32)
        self.place = []
        for nodes, _ in levels:
            place = np.full(len(vectors), -1, np.int32)
            place[nodes] = np.arange(len(nodes))
            self.place.append(place)

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 1) -> Graph:
        extended = cls(vectors, []).extended
        rng, nodes, levels = np.random.default_rng(seed), np.arange(len(vectors), dtype=np.int32), []
        while len(nodes):
            links = neighbours(extended[nodes])
            levels.append((nodes, np.where(links < 0, -1, nodes[links]).astype(np.int32)))
            nodes = np.sort(rng.permutation(nodes)[:len(nodes) // 16])
        return cls(vectors, levels)

    def search(self, queries: np.ndarray, width: int) -> list[np.ndarray]:
        """For each query the nodes nearest to it among those that a search of this width meets."""
        if not len(self.vectors):
            return [np.zeros(0, np.int32)] * len(queries)
        q = np.append(queries, np.zeros((len(queries), 1)), 1).astype(np.float32)
        nodes = np.full((len(q), 1), self.levels[-1][0][0], np.int32)
        for (_, links), place in zip(reversed(self.levels[1:]), reversed(self.place[1:])):
            nodes = self._layer(q, nodes, 16, links, place)
        return [found[found >= 0] for found in self._layer(q, nodes, width, self.levels[0][1], self.place[0])]

    def _layer(self, q: np.ndarray, entries: np.ndarray, width: int, links: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A row of up to ``width`` nodes per query, -1 where none: walks from ``entries`` until no better node is unopened."""
        seen = np.zeros((len(q), len(self.vectors) + 1), bool)  # the last place stands for "no neighbour"
        seen[:, -1] = True
        nodes = np.full((len(q), width), -1, np.int32)
        near = np.full((len(q), width), -np.inf, np.float32)
        new, walking = np.sort(entries, 1), np.arange(len(q))
        unopened = np.zeros((len(q), width), bool)
        while True:
            at = walking[:, None]
            fresh = ~seen[at, new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            seen[at, new] = True
            row, col = np.nonzero(fresh)
            scores = np.full(new.shape, -np.inf, np.float32)
            scores[row, col] = np.einsum("nd,nd->n", self.extended[new[row, col]], q[walking[row]])
            new = np.where(fresh, new, -1)
            all_near = np.concatenate([near[walking], scores], 1)
            best = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
            near[walking] = np.take_along_axis(all_near, best, 1)
            nodes[walking] = np.take_along_axis(np.concatenate([nodes[walking], new], 1), best, 1)
            unopened[walking] = np.take_along_axis(np.concatenate([unopened[walking], fresh], 1), best, 1)

            walking = np.flatnonzero(unopened.any(1))
            if not len(walking):
                return nodes
            at = walking[:, None]
            open_near = np.where(unopened[walking], near[walking], -np.inf)
            step = min(STEP, width)
            picked = np.argpartition(-open_near, step - 1, axis=1)[:, :step]
            opened = np.where(unopened[at, picked], nodes[at, picked], -1)
            unopened[at, picked] = False
            beyond = np.where(opened[:, :, None] >= 0, links[place[opened]], -1)
            new = np.sort(beyond.reshape(len(walking), -1), 1)


def neighbours(x: np.ndarray, links: int = LINKS, candidates: int = CANDIDATES, block: int = 1024) -> np.ndarray:
    """Row numbers of each row's neighbours, -1 where none: chosen ones and, up to as many again, those that chose it."""
    n = len(x)
    k = min(candidates, n - 1)
    out = np.full((n, 2 * links), -1, np.int32)
    if k < 1:
        return out
    count = np.zeros(n, np.int32)
    for first in range(0, n, block):
        own = np.arange(first, min(n, first + block))
        near = x[own] @ x.T
        near[np.arange(len(own)), own] = -np.inf
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1), 1)
        to_own = np.take_along_axis(near, top, 1)
        # A candidate is chosen if it is nearer to the row than to every candidate chosen before it.
        chosen = np.zeros((len(own), k), bool)
        closest = np.full((len(own), k), -np.inf, np.float32)
        for c in range(k):
            chosen[:, c] = (to_own[:, c] > closest[:, c]) & (chosen.sum(1) < links)
            rows = np.flatnonzero(chosen[:, c])
            between = np.einsum("rkd,rd->rk", x[top[rows]], x[top[rows, c]])
            closest[rows] = np.maximum(closest[rows], between)
        # The rest is filled with the nearest ones.
        order = np.argsort(~chosen, axis=1, kind="stable")[:, :links]
        width = order.shape[1]
        out[own, :width] = np.take_along_axis(top, order, 1)
        count[own] = width
    picked = out[:, :links].copy()
    for i in np.random.default_rng(0).permutation(n):  # links back, while there is room
        for j in picked[i]:
            if j >= 0 and count[j] < 2 * links and i not in out[j, :count[j]]:
                out[j, count[j]] = i
                count[j] += 1
    return out


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def build_index(rows: DataFrame, k: int, *, shard: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(dim, shard, vectors, ids, n_ids, nodes, links, sizes): one row of flat arrays per shard, stored."""
    own = rows.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")) \
        .withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    # The rank limit is applied in each task before rows are shuffled, so equal vectors stay few.
    rank = F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))
    few = own.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    distinct = stored(few.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids"))
                      .withColumn("dim", F.size("vector")), "vectors")
    sizes = distinct.groupBy("dim").agg(F.ceil(F.count("*") / shard).alias("shards"))  # one row per length of vectors
    dealt = distinct.join(sizes, "dim").withColumn("shard", F.pmod("h1", "shards").cast("int"))
    # As many partitions as shards: small inputs of long work, which adaptive execution would put into one task.
    dealt = dealt.repartition(max(1, sizes.agg(F.sum("shards")).first()[0] or 1), "dim", "shard")

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("h1", "ascending"), ("h2", "ascending")])  # the same graph on every run
        dim, n = group["dim"][0].as_py(), group.num_rows
        vectors = group["vector"].combine_chunks().flatten().to_numpy().reshape(n, dim)
        graph = Graph.build(np.ascontiguousarray(vectors, np.float32))
        ids = group["ids"].combine_chunks()
        data = {"dim": [dim], "shard": [group["shard"][0].as_py()], "vectors": [graph.vectors.tobytes()],
                "ids": [ids.flatten().to_numpy().astype("<i8").tobytes()], "n_ids": [np.diff(ids.offsets.to_numpy()).astype("<i4").tobytes()],
                "nodes": [b"".join(x.tobytes() for x, _ in graph.levels)], "links": [b"".join(x.tobytes() for _, x in graph.levels)],
                "sizes": [np.array([len(x) for x, _ in graph.levels], "<i4").tobytes()]}
        return pa.table(data, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32())] + [(c, pa.binary()) for c in list(data)[2:]]))

    schema = "dim int, shard int, vectors binary, ids binary, n_ids binary, nodes binary, links binary, sizes binary"
    return stored(dealt.groupBy("dim", "shard").applyInArrow(build, schema), "hnsw-index")


def _load(index: pa.Table) -> tuple[Graph, np.ndarray, np.ndarray]:
    row = {c: index[c][0].as_py() for c in index.schema.names}
    sizes = np.frombuffer(row["sizes"], "<i4")
    nodes = np.split(np.frombuffer(row["nodes"], np.int32), np.cumsum(sizes)[:-1])
    links = np.split(np.frombuffer(row["links"], np.int32).reshape(-1, 2 * LINKS), np.cumsum(sizes)[:-1])
    n_ids = np.frombuffer(row["n_ids"], "<i4")
    return Graph(np.frombuffer(row["vectors"], np.float32).reshape(-1, row["dim"]), list(zip(nodes, links))), np.frombuffer(row["ids"], "<i8"), np.append(0, np.cumsum(n_ids))


def search(index: DataFrame, queries: DataFrame, k: int, *, width: int = WIDTH, block: int = QUERY_BLOCK,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, ties to the smaller id."""
    asked = queries.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<float>").alias("vector")) \
        .withColumn("dim", F.size("vector"))
    blocks = asked.groupBy("dim").agg(F.ceil(F.count("*") / block).alias("blocks"))
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    asked = asked.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).join(shards, "dim") \
        .select("dim", F.explode(F.sequence(F.lit(0), "last")).alias("shard"), "block", "query_id", "vector")
    copies = index.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).drop("blocks")

    def meet(shard: pa.Table, asking: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if shard.num_rows and asking.num_rows:
            graph, ids, ends = _load(shard)
            owners = asking["query_id"].to_pylist()
            vectors = asking["vector"].combine_chunks().flatten().to_numpy().reshape(len(owners), -1)
            for first in range(0, len(owners), BATCH):
                batch = vectors[first:first + BATCH]
                for own, q, near in zip(owners[first:], batch.astype(np.float64), graph.search(batch, max(width, 2 * k))):
                    scores = graph.vectors[near].astype(np.float64) @ q
                    # The query itself is at most one of the k + 1 best nodes.
                    good = np.flatnonzero(scores >= np.partition(scores, -k - 1)[-k - 1]) if len(near) > k + 1 else range(len(near))
                    hits = [(-scores[n], i) for n in good for i in ids[ends[near[n]]:ends[near[n] + 1]].tolist() if i != own]
                    found += [(own, i, -s) for s, i in heapq.nsmallest(k, hits)]
        query_id, vec_id, score = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(query_id, pa.int64()), "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array(score, pa.float64())})

    keys = ["dim", "shard", "block"]
    merged = copies.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
