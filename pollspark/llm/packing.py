"""Packing documents into sequences of one length: cutting-stock column generation over a histogram of lengths.

A document's ids are cut at whole sequences; what is left is a piece of its own. Lengths are counted in units of a few
ids, so the histogram has at most ``limit / UNIT`` entries whatever the size of the corpus. A linear program over
patterns (how many pieces of each length share a sequence) starts from one length per pattern; a knapsack over the
dual prices finds the pattern worth most, which enters the basis, until none is worth more than a sequence. A second
kind of column cuts one piece of some length into two, at a small price, where lengths do not fill sequences by
themselves. The solution is rounded: whole multiples of patterns first, then patterns that still fit the counts, then
the rest by decreasing length with cuts. Every piece has a rank among the pieces of its length, and ranges of ranks
say which pieces are cut and which place of which sequence a piece takes.

The ids themselves are not kept: each piece carries checksums of its cells of ``CELL`` ids, and the checksum of a cut
piece follows from those.

Results for unusual input: a null or empty text has the end id alone; repeated and null ids are documents of their own;
an empty table has no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from tokenizers import Tokenizer

from pollspark.llm.common import slices, stored

LIMIT = 2048
UNIT = 8
CELL = 32
CUT_COST = 0.01  # of a sequence
GAP = 0.002  # over the sequences that the ids need at least, at which the program is solved well enough
ROUNDS = 3000
SMOOTHING = (0.9, 0.6, 0.0)


def _spelled() -> dict[str, int]:
    """The character by which byte-level files write each byte: visible ones as they are, the others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


class ByteLevelIds:
    """Ids of a byte-level tokenizers file, merged by ranks read from that file.

    Merging whatever pair spells a token gives the ids of the file's list of merges if every token of the file is what
    its own bytes are merged to; a test holds that for the file in use. Texts that contain an added token, or are
    longer than a megabyte of characters, go to the tokenizers library itself.
    """

    def __init__(self, spec: str, pattern: str):
        self.library, parts = Tokenizer.from_str(spec), json.loads(spec)
        spelled, self.added = _spelled(), [t["content"] for t in parts.get("added_tokens") or []]
        ranks = {bytes(spelled[c] for c in token): i for token, i in parts["model"]["vocab"].items() if token not in self.added}
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if len(text) > 1 << 20 or any(a in text for a in self.added):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_ENCODERS: dict[tuple[str, str], ByteLevelIds] = {}


def encoder(spec: str, pattern: str) -> ByteLevelIds:
    """Kept in this Python worker for the tasks that follow."""
    if (spec, pattern) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS.clear()
        _ENCODERS[spec, pattern] = ByteLevelIds(spec, pattern)
    return _ENCODERS[spec, pattern]


def joined_crc(cells: list[int], lengths: list[int]) -> int:
    """Checksum of byte strings one after the other, from the checksum and length of each."""
    total = 0
    for crc, n in zip(cells, lengths):
        nothing = bytes(n)
        total = zlib.crc32(nothing, total) ^ zlib.crc32(nothing) ^ crc
    return total


@dataclass
class Plan:
    """``cuts``: (length, cut after, pieces); ``patterns``: (pieces of each length, sequences). Lengths in units."""

    cuts: list[tuple[int, int, int]] = field(default_factory=list)
    patterns: list[tuple[dict[int, int], int]] = field(default_factory=list)


def knapsack(price: np.ndarray) -> tuple[float, dict[int, int]]:
    """The pattern of the highest price that fits: ``price[w]`` for a piece of length w, index 0 unused."""
    cap = len(price) - 1
    best, taken = np.zeros(cap + 1), np.zeros(cap + 1, np.int64)
    for c in range(1, cap + 1):
        worth = price[1:c + 1] + best[c - 1::-1] if c > 1 else price[1:2] + best[:1]
        w = int(worth.argmax())
        best[c], taken[c] = (worth[w], w + 1) if worth[w] > best[c - 1] else (best[c - 1], 0)
    pattern, c = {}, cap
    while c > 0:
        w = int(taken[c])
        if w:
            pattern[w] = pattern.get(w, 0) + 1
        c -= w or 1
    return float(best[cap]), pattern


def relaxed(demand: np.ndarray, cell: int) -> list[tuple[float, dict[int, int], tuple[int, int] | None]]:
    """Columns of the linear program's solution: (amount, pattern, None) or (amount, {}, (length, cut after)).

    There is a row for the documents of each length, which stay whole or are cut once, and a row for the pieces of each
    length, which patterns take up. Prices are drawn towards a length's share of a sequence, the prices of a perfect
    packing, as long as a column that is worth its cost turns up: that keeps the patterns full and the steps few.
    """
    cap = len(demand) - 1
    size = np.arange(cap + 1) / cap
    least = float(demand @ size)
    copies = cap // np.arange(1, cap + 1)
    eye, per = np.eye(cap), np.diag(1.0 / copies)
    # Rows: pieces, then documents. The basis begins with one pattern per length and all documents whole.
    inverse = np.block([[per, per], [np.zeros((cap, cap)), eye]])
    amount, cost = np.append(demand[1:] / copies, demand[1:]), np.append(np.ones(cap), np.zeros(cap))
    columns: list[tuple[dict[int, int], tuple[int, int] | None]] = [({w: int(copies[w - 1])}, None) for w in range(1, cap + 1)] + [({}, None)] * cap
    gives = np.zeros((2 * cap, 2), np.int64)  # the lengths that a column cuts a document into
    whole = np.append(np.zeros(cap, np.int64), np.arange(1, cap + 1))
    for _ in range(ROUNDS if least else 0):
        if cost @ amount <= least * (1 + GAP):
            break
        prices = cost @ inverse
        price, own = np.append(0.0, prices[:cap]), np.append(0.0, prices[cap:])
        used = amount > 1e-9
        held = np.zeros(cap + 1, bool)
        held[whole[used]] = held[gives[used].ravel()] = True
        held[0] = False
        gain, pattern, cut = 1e-7, {}, None
        stay = np.where(demand > 0, own - price, 0)
        if stay.max() > gain:
            gain, cut = float(stay.max()), (int(stay.argmax()), 0)
        for after in range(cell, cap, cell):  # cut documents longer than ``after``
            gains = np.where(demand[after + 1:] > 0, own[after + 1:] - price[after] - price[1:cap + 1 - after] - CUT_COST, 0)
            w = int(gains.argmax())
            if gains[w] > gain:
                gain, cut = float(gains[w]), (w + after + 1, after)
        for drawn in SMOOTHING:
            _, found = knapsack(np.where(held, drawn * size + (1 - drawn) * price, 0))
            worth = sum(price[w] * k for w, k in found.items()) - 1
            if worth > gain:
                gain, pattern, cut = worth, found, None
                break
        if not pattern and not cut:
            break
        column = np.zeros(2 * cap)
        if cut:
            column[cap + cut[0] - 1] = 1
            for half in (cut[1], cut[0] - cut[1]):
                column[half - 1] -= half > 0
        else:
            column[np.array(list(pattern)) - 1] = list(pattern.values())
        move = inverse @ column
        ratio = np.where(move > 1e-9, amount / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        amount = np.maximum(amount - ratio[out] * move, 0)
        amount[out] = ratio[out]
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        split = cut if cut and cut[1] else None
        columns[out], cost[out] = (pattern, split), 1.0 if pattern else CUT_COST if split else 0.0
        gives[out], whole[out] = (split[1], split[0] - split[1]) if split else (0, 0), cut[0] if cut and not split else 0
    return [(float(a), *c) for a, c in zip(amount, columns) if a > 1e-9 and (c[0] or c[1])]


def plan(demand: np.ndarray, cell: int = CELL // UNIT) -> Plan:
    """Whole numbers of cuts and patterns that use up ``demand`` (pieces of each length in units, index 0 unused)."""
    cap, out = len(demand) - 1, Plan()
    left, uncut = demand.astype(np.int64).copy(), demand.astype(np.int64).copy()
    cuts: dict[tuple[int, int], int] = {}
    patterns: dict[tuple[tuple[int, int], ...], int] = {}

    def cut(w: int, after: int, n: int) -> None:
        cuts[w, after] = cuts.get((w, after), 0) + n
        uncut[w] -= n
        left[w] -= n
        left[after] += n
        left[w - after] += n

    def use(pattern: dict[int, int], n: int) -> None:
        key = tuple(sorted(pattern.items(), reverse=True))
        patterns[key] = patterns.get(key, 0) + n
        for w, k in pattern.items():
            left[w] -= k * n

    solved = relaxed(demand.astype(float), cell)
    for amount, _, at in solved:
        if at and (n := min(int(amount + 1e-6), int(uncut[at[0]]), int(left[at[0]]))) > 0:
            cut(*at, n)
    kept = [(amount, p) for amount, p, at in solved if not at]
    for amount, p in kept:
        if (n := min([int(amount + 1e-6), *(int(left[w]) // k for w, k in p.items())])) > 0:
            use(p, n)
    units = np.arange(cap + 1)
    for amount, p in sorted(kept, key=lambda x: -(x[0] % 1)):  # one more where the counts allow it and the pattern is full
        if sum(w * k for w, k in p.items()) == cap and all(left[w] >= k for w, k in p.items()):
            use(p, 1)
    while left.any():  # no more sequences than there are patterns, give or take: bounded by the histogram
        pattern, room = {}, cap
        while room:
            fits = np.flatnonzero(left[:room + 1])
            if len(fits):
                w = int(fits[-1])
            else:
                longer = np.flatnonzero((left > 0) & (uncut > 0) & (units > room))
                if room < cell or not len(longer):
                    break
                cut(int(longer[0]), w := room // cell * cell, 1)
            k = min(int(left[w]), room // w)
            pattern[w] = pattern.get(w, 0) + k
            left[w] -= k
            room -= k * w
        for w, k in pattern.items():
            left[w] += k
        times = min(int(left[w]) // k for w, k in pattern.items())
        use(pattern, max(1, times))
    out.cuts = [(w, after, n) for (w, after), n in cuts.items()]
    out.patterns = [(dict(key), n) for key, n in patterns.items()]
    return out


def _pieces(docs: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], end_id: int, limit: int, id_col: str, text_col: str) -> DataFrame:
    """(id, start, length, crc, tokens, part, units, at, cells): ``at`` counts the pieces of one length in a task; stored."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts, encode = TaskContext.get().partitionId(), {}, encoder()
        for batch in slices(batches):
            out: dict[str, list] = {c: [] for c in ("row", "start", "length", "crc", "tokens", "units", "at", "cells")}
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text)
                ids.append(end_id)
                n, data = len(ids), np.array(ids, "<u4").tobytes()
                for start in range(0, n, limit):
                    piece = data[4 * start:4 * (start + limit)]
                    length = len(piece) // 4
                    units = -(-length // UNIT)
                    at = counts[units] = counts.get(units, -1) + 1
                    cells = b"" if length == limit else np.array([zlib.crc32(piece[i:i + 4 * CELL]) for i in range(0, len(piece), 4 * CELL)], "<u4").tobytes()
                    for c, v in zip(out, (row, start, length, zlib.crc32(piece), n, units, at, cells)):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id").take(pa.array(out["row"], pa.int32())), **{c: pa.array(out[c], pa.int64()) for c in ("start", "length", "crc", "tokens")},
                "part": pa.array([part] * len(out["at"]), pa.int32()), "units": pa.array(out["units"], pa.int32()), "at": pa.array(out["at"], pa.int64()),
                "cells": pa.array(out["cells"], pa.binary())})

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return stored(texts.mapInArrow(cut, f"id {kind}, start long, length long, crc long, tokens long, part int, units int, at long, cells binary"), "pieces")


def _halves(cut: DataFrame, kind: str) -> DataFrame:
    """Two pieces for each cut one, with ranks among those of their lengths and checksums from the cells."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", "length", "crc", "tokens", "units", "rank"]
        for batch in batches:
            rows = {c: batch.column(c).to_pylist() for c in ("start", "length", "tokens", "after", "cells", "head_rank", "tail_rank")}
            out: dict[str, list] = {c: [] for c in names[1:]}
            for start, length, tokens, after, cells, head_rank, tail_rank in zip(*rows.values()):
                crcs = np.frombuffer(cells, "<u4").tolist()
                sizes = [4 * min(CELL, length - i) for i in range(0, length, CELL)]
                head, k = after * UNIT, after * UNIT // CELL
                halves = [(start, head, joined_crc(crcs[:k], sizes[:k]), tokens, after, head_rank),
                          (start + head, length - head, joined_crc(crcs[k:], sizes[k:]), tokens, -(-(length - head) // UNIT), tail_rank)]
                for half in halves:
                    for c, v in zip(out, half):
                        out[c].append(v)
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(batch.num_rows), 2)))
            yield pa.RecordBatch.from_arrays([ids] + [pa.array(out[c], pa.int32() if c == "units" else pa.int64()) for c in names[1:]], names)

    return cut.mapInArrow(split, f"id {kind}, start long, length long, crc long, tokens long, units int, rank long")


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], end_id: int, *, limit: int = LIMIT, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(id, start, length, crc, tokens, sequence_id, offset) of every piece; ``encoder()`` gives a task its function."""
    if limit % CELL:
        raise ValueError(f"limit has to be a multiple of {CELL}")
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    pieces = _pieces(docs, encoder, end_id, limit, id_col, text_col)
    counts = pieces.groupBy("units", "part").agg(F.count("*").alias("n"))
    demand = np.zeros(limit // UNIT + 1)
    for units, n in counts.groupBy("units").agg(F.sum("n")).collect():  # at most limit / UNIT rows
        demand[units] = n
    made = plan(demand)

    # Ranks: of a piece among those of its length, over all tasks; one row per task and length is numbered.
    before = W.partitionBy("units").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("units", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["units", "part"]).withColumn("rank", F.col("base") + F.col("at")).drop("base", "at", "part")

    # The first ranks of a length are cut; what stays whole comes next, then the halves of others, cut by cut.
    cut_rows, cut_of, halves = [], {}, {}
    for w, after, n in made.cuts:
        cut_of[w] = cut_of.get(w, 0) + n
    for w, after, n in made.cuts:
        low = sum(m for v, _, m in made.cuts[:made.cuts.index((w, after, n))] if v == w)
        bases_of = []
        for half in (after, w - after):
            bases_of.append(int(demand[half]) - cut_of.get(half, 0) + halves.get(half, 0))
            halves[half] = halves.get(half, 0) + n
        cut_rows.append((w, low, low + n, after, *bases_of))
    slot_rows, first = [], 0
    used: dict[int, int] = {}
    for pattern, n in made.patterns:
        place = 0
        for w, k in pattern.items():
            slot_rows.append((w, used.get(w, 0), used.get(w, 0) + n * k, k, first, place))
            used[w] = used.get(w, 0) + n * k
            place += k
        first += n

    # Both tables are bounded by the number of lengths, whatever the number of documents.
    cuts = F.broadcast(spark.createDataFrame(cut_rows, "units int, low long, high long, after int, head_base long, tail_base long"))
    whole_from = F.broadcast(spark.createDataFrame(list(cut_of.items()), "units int, cut_pieces long"))
    slots = F.broadcast(spark.createDataFrame(slot_rows, "units int, low long, high long, each long, first long, place long"))
    kept = ["id", "start", "length", "crc", "tokens", "units"]
    inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    cut = ranked.join(cuts, "units").where(inside).withColumn("head_rank", F.col("head_base") + F.col("rank") - F.col("low")) \
        .withColumn("tail_rank", F.col("tail_base") + F.col("rank") - F.col("low"))
    whole = ranked.join(whole_from, "units", "left").withColumn("rank", F.col("rank") - F.coalesce("cut_pieces", F.lit(0))).where("rank >= 0").select(*kept, "rank")
    final = whole.unionByName(_halves(cut.select(*kept, "after", "cells", "head_rank", "tail_rank"), kind)) if cut_rows else whole
    dealt = final.join(slots, "units").where(inside).withColumn("nth", F.col("rank") - F.col("low")) \
        .withColumn("sequence_id", F.expr("first + nth div each")).withColumn("place", F.expr("place + nth % each"))
    ahead = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)  # as many rows as a sequence has pieces
    return dealt.select(F.col("id").alias(id_col), "start", "length", "crc", "tokens", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))
