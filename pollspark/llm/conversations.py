"""Repair of conversation structure: the cheapest edits, by an auction shortest-path algorithm.

A conversation may open with a system row and then alternates user and assistant. Rows are kept (K), given another
role (R), deleted (D), or empty rows are inserted (I). The lattice has one layer per row and four states in it:
nothing said, system said, user said, assistant said. Each edit is an arc of integer cost. Layers settle from the
last one back: every node of a layer in turn is the origin of an auction, whose path grows along the cheapest arc
and shrinks with a raise of the price where no arc is as cheap as the price says, until it reaches the settled
layer. The prices are then the exact costs to the end, an arc is tight if its cost is the difference of its prices,
and the first tight arc in ASCII order at each node traces the least of the cheapest edit strings.

Equal rows of a turn are one row with a count. Rows are range-partitioned by conversation and turn, so a conversation
of any length is cut into blocks of a bounded number of rows. For conversations of several blocks, a block's auctions
for each state at its end give a matrix of costs and the order of its traces; a scan from the last block back gives
the prices at each block's end, one forward the states at its begin. Only rows of one block are ever held.

Results for unusual input: a null role or text is one space; null turns come first; a null conversation is one of its
own; rows of the same turn are ordered by role, then by the digest of role and text; role initials are case
sensitive and other initials than s, u, a are never kept; an empty table has no pieces; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from pollspark.llm.common import stored

BLOCK_ROWS = 4096
BLOCK_BYTES = 8 << 20
BLANKS = " \t\n\x0b\x0c\r"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE, INSERT, REROLE, OPEN_END = 3, 2, 2, 1

# States: 0 nothing said, 1 system, 2 user, 3 assistant; where each initial leads from a state.
LEADS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
SPOKEN = {2: "user", 3: "assistant"}
END = (0, 4, 2, 0)  # costs to finish after the last row
FAR = 16  # more than the cost to finish can differ between two states
LEGAL = {"su", "ua", "au"}
Kind = tuple[str, int] | None  # initial and cost of staying; None: the row has to go


@lru_cache(None)
def arcs(kind: Kind, state: int) -> list[tuple[str, int, int, bool]]:
    """(edit, cost, next state, leads to the next layer) of a node, edits in ASCII order."""
    spoken = [LEADS[c][state] for c in "ua" if state in LEADS[c]]
    found = [("D", DELETE, state, True)] + [("I", INSERT, to, False) for to in spoken]
    if kind:
        initial, stay = kind
        found += [("K", stay, LEADS[initial][state], True)] if state in LEADS.get(initial, ()) else []
        found += [("R", REROLE + stay, to, True) for to in spoken]
    return found


@lru_cache(1 << 16)
def auction(kind: Kind, after: tuple[int, ...]) -> tuple[int, ...]:
    """Prices of a layer's four nodes, the exact costs to go, from the settled prices of the next layer."""
    price = [min(after)] * 4  # no arc is cheaper than these prices say
    for origin in range(4):
        path = [origin]
        while True:
            node = path[-1]
            best, ahead, to = min((cost + (after[to] if ahead else price[to]), not ahead, to) for _, cost, to, ahead in arcs(kind, node))
            if price[node] < best:  # contract
                price[node] = best
                if len(path) > 1:
                    path.pop()
            elif not ahead:  # an arc into the settled layer: the path is complete
                break
            else:  # extend
                path.append(to)
    return tuple(price)


@lru_cache(1 << 16)
def step(kind: Kind, after: tuple[int, ...], state: int) -> tuple[str, int, int]:
    """(edits, state in the next layer, their cost) of the least tight path through one layer."""
    price, edits, total = auction(kind, after), "", 0
    while True:
        for edit, cost, to, ahead in arcs(kind, state):
            if price[state] == cost + (after[to] if ahead else price[to]):
                break
        edits, state, total = edits + edit, to, total + cost
        if ahead:
            return edits, state, total


def settle(kinds: list[Kind], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """For each row the prices after it, less their minimum; the list is one longer, its first entry stands before all rows."""
    prices = [end]
    for kind in reversed(kinds):
        now = auction(kind, prices[-1])
        low = min(now)
        prices.append(tuple(p - low for p in now))
    return prices[::-1]


def trace(kinds: list[Kind], prices: list[tuple[int, ...]], state: int) -> tuple[list[str], int, int]:
    """(edits of each row, state at the end, cost) from ``state`` before the first row."""
    out, total = [], 0
    for kind, after in zip(kinds, prices[1:]):
        edits, state, cost = step(kind, after, state)
        out.append(edits)
        total += cost
    return out, state, total


def closing(state: int) -> str:
    return "I" * {0: 0, 1: 2, 2: 1, 3: 0}[state]


def layers(initials: list[str], faults: list[int], counts: list[int]) -> tuple[list[Kind], list[int]]:
    """Kinds of a block's rows, and the places of the repeats.

    A row that stands n times is followed by one more layer for its repeats, which all go: the last of them has the
    layer, the n - 2 before it are D at any cheapest path, as deletion is the first letter and tight at settled prices.
    """
    kinds: list[Kind] = []
    own = []
    for initial, fault, n in zip(initials, faults, counts):
        own.append(len(kinds))
        kinds.append(None if fault in (BLANK, DUPLICATE) else (initial if initial in LEADS else "", OPEN_END * (fault == TRUNCATED)))
        kinds += [None] * (n > 1)
    return kinds, own


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, chosen by the checksum of conversation and turn."""
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                             F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.withColumn("fault", fault).where("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("one")).drop("one")


def _named(rows: DataFrame, id_col: str) -> list[Column]:
    """A conversation's key as two columns without null."""
    return [F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_conv"), F.col(id_col).isNull().alias("_none")]


KEY = ["_conv", "_none"]
PLACE = [*KEY, "_part", "_seq"]


def _blocks(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, block: int) -> DataFrame:
    """Rows in order, cut into blocks: parallel lists of turn, count, role, text and first fault; stored."""
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    own = rows.select(*_named(rows, id_col), F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("_turn"), F.col(turn_col).isNull().alias("_unset"),
                      digest.alias("_same"), role.alias("role"), text.alias("text"))
    # Copies meet on the map side, so a row that is repeated without end is one row per task.
    at = [*KEY, "_turn", "_unset", "_same"]
    once = own.groupBy(*at).agg(F.count("*").alias("count"), F.first("role").alias("role"), F.first("text").alias("text"))
    # The first place of each text of a conversation; both sides of the join have one row per key.
    seen = own.groupBy(*KEY, "_same").agg(F.max("_unset").alias("_unset"), F.min(F.when(~F.col("_unset"), F.col("_turn"))).alias("_least")) \
        .select(*KEY, "_same", "_unset", F.when(F.col("_unset"), 0).otherwise(F.col("_least")).alias("_turn"), F.lit(True).alias("_first"))
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(stripped == "", BLANK).when(F.col("_first").isNull(), DUPLICATE) \
        .when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    order = [F.col("_conv"), F.col("_none"), F.col("_unset").desc(), F.col("_turn"), F.col("role"), F.col("_same")]
    dealt = once.join(seen, at, "left").withColumn("fault", fault).repartitionByRange(*order).sortWithinPartitions(*order) \
        .select(*KEY, F.when(~F.col("_unset"), F.col("_turn")).alias("turn"), "count", "role", "text", "fault")
    lists = ["turn", "count", "role", "text", "fault"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, key, size = TaskContext.get().partitionId(), 0, [], None, 0

        def close() -> pa.RecordBatch:
            columns = [pa.concat_arrays([b.column(c) for b in held]) for c in lists]
            n = len(columns[0])
            arrays = [pa.array([key[0]]), pa.array([key[1]]), pa.array([part], pa.int32()), pa.array([seq], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays + [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c) for c in columns], [*PLACE, *lists])

        for batch in batches:
            keys = list(zip(batch.column("_conv").to_pylist(), batch.column("_none").to_pylist()))
            sizes = pa.compute.binary_length(batch.column("text")).to_pylist()
            first = rows_held = 0
            rows_held = sum(b.num_rows for b in held)
            for i, (k, s) in enumerate(zip(keys, sizes)):
                if key is not None and (k != key or rows_held >= block or size + s > BLOCK_BYTES):
                    held += [batch.slice(first, i - first)] if i > first else []
                    yield close()
                    held, first, rows_held, size, seq = [], i, 0, 0, seq + 1
                key, size, rows_held = k, size + s, rows_held + 1
            held.append(batch.slice(first))
        if key is not None:
            yield close()

    kinds = "turn array<bigint>, count array<bigint>, role array<string>, text array<string>, fault array<int>"
    return stored(dealt.mapInArrow(cut, f"_conv string, _none boolean, _part int, _seq bigint, {kinds}"), "conversation-blocks")


def _each(fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str, arrow: pa.Schema) -> Callable[[DataFrame], DataFrame]:
    """A transformation whose rows are made from rows in the order they come, a batch at a time."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1).to_pylist()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in fn(rows(batches)):
            out.append(row)
            size += sum(len(v) for v in row.values() if isinstance(v, (str, list)))
            if len(out) >= 1024 or size > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return lambda df: df.mapInArrow(run, schema)


_PLACE = [("_conv", pa.string()), ("_none", pa.bool_()), ("_part", pa.int32()), ("_seq", pa.int64())]
_PLACE_SQL = "_conv string, _none boolean, _part int, _seq bigint"


def _place(row: dict) -> dict:
    return {c: row[c] for c in PLACE}


def _meetings(blocks: Iterator[dict]) -> Iterator[dict]:
    """A block as costs and order of its traces: entry q, exit t at 4 q + t; a trace that another exit beats is -1."""
    for row in blocks:
        kinds, _ = layers([r[:1] for r in row["role"]], row["fault"], row["count"])
        cost, edits = [-1] * 16, {}
        for t in range(4):
            prices = settle(kinds, tuple(0 if s == t else FAR for s in range(4)))
            for q in range(4):
                found, to, total = trace(kinds, prices, q)
                if to == t:
                    cost[4 * q + t], edits[4 * q + t] = total, "".join(found)
        order = sorted(edits, key=edits.get)
        yield _place(row) | {"cost": cost, "rank": [order.index(k) if k in edits else -1 for k in range(16)]}


def _backward(blocks: Iterator[dict]) -> Iterator[dict]:
    """From a conversation's last block on: the prices at a block's end and where its traces lead."""
    key, price = None, END
    for row in blocks:
        if key != (own := (row["_conv"], row["_none"])):
            key, price = own, END
        best = [min((row["cost"][4 * q + t] + price[t], row["rank"][4 * q + t], t) for t in range(4) if row["cost"][4 * q + t] >= 0) for q in range(4)]
        yield _place(row) | {"exit": list(price), "leads": [t for _, _, t in best]}
        low = min(b[0] for b in best)
        price = tuple(b[0] - low for b in best)


def _forward(blocks: Iterator[dict]) -> Iterator[dict]:
    """From the first block on: the state at its begin; the last block is marked."""
    held = state = None
    for row in blocks:
        same = held is not None and (held["_conv"], held["_none"]) == (row["_conv"], row["_none"])
        if held is not None:
            yield held | {"last": not same}
        held = _place(row) | {"exit": row["exit"], "entry": state if same else 0}
        state = row["leads"][held["entry"]]
    if held is not None:
        yield held | {"last": True}


def _repaired(blocks: Iterator[dict]) -> Iterator[dict]:
    for row in blocks:
        kinds, own = layers([r[:1] for r in row["role"]], row["fault"], row["count"])
        state = row["entry"]
        found, end, cost = trace(kinds, settle(kinds, tuple(row["exit"])), state)
        roles, texts, parts = [], [], []
        ends = [*own[1:], len(found)]
        for at, to, role, text, n in zip(own, ends, row["role"], row["text"], row["count"]):
            edits = found[at] + "D" * (n - 2) + (found[at + 1] if to > at + 1 else "")
            for e in found[at] + (found[at + 1] if to > at + 1 else ""):
                if e == "D":
                    continue
                state = LEADS[role[:1]][state] if e == "K" else 3 if state == 2 else 2
                roles.append(role if e == "K" else SPOKEN[state])
                texts.append("" if e == "I" else text)
            cost += DELETE * max(0, n - 2)
            parts.append(edits)
        if row["last"]:
            for _ in closing(end):
                state = 3 if state == 2 else 2
                roles.append(SPOKEN[state])
                texts.append("")
            parts.append(closing(end))
            cost += INSERT * len(closing(end))
        initials = [r[:1] for r in row["role"]]
        turns = [t for t in row["turn"] if t is not None]
        faults = {c: 0 for c in range(4)}
        for f, n in zip(row["fault"], row["count"]):  # a row's repeats are duplicates of it, or blank like it
            faults[f] += n if f in (BLANK, DUPLICATE) else 1
            faults[DUPLICATE] += 0 if f in (BLANK, DUPLICATE) else n - 1
        yield _place(row) | {
            "edits": "".join(parts), "cost": cost, "roles": roles, "texts": texts, "blank": faults[BLANK], "duplicate": faults[DUPLICATE],
            "truncated": faults[TRUNCATED], "illegal": sum(n - 1 for n in row["count"]) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "first": initials[0], "final": initials[-1], "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
            "turns": len(set(turns))}


_PIECE = [("edits", pa.string()), ("cost", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("blank", pa.int64()),
          ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("final", pa.string()),
          ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64())]
_PIECE_SQL = ("edits string, cost bigint, roles array<string>, texts array<string>, blank bigint, duplicate bigint, truncated bigint, "
              "illegal bigint, first string, final string, first_turn bigint, last_turn bigint, turns bigint")


def repair(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           block: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of repaired rows (roles, texts) in order of (_part, _seq) of each conversation (_conv, _none), with the
    edits that led there, their cost and what was wrong. ``whole`` marks conversations of one block."""
    blocks = _blocks(rows, id_col, turn_col, role_col, text_col, block)
    long = stored(blocks.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY), "long-conversations")
    meet = _each(_meetings, f"{_PLACE_SQL}, cost array<bigint>, rank array<int>",
                 pa.schema([*_PLACE, ("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int32()))]))
    back = _each(_backward, f"{_PLACE_SQL}, exit array<bigint>, leads array<int>",
                 pa.schema([*_PLACE, ("exit", pa.list_(pa.int64())), ("leads", pa.list_(pa.int32()))]))
    forth = _each(_forward, f"{_PLACE_SQL}, exit array<bigint>, entry int, last boolean",
                  pa.schema([*_PLACE, ("exit", pa.list_(pa.int64())), ("entry", pa.int32()), ("last", pa.bool_())]))
    mend = _each(_repaired, f"{_PLACE_SQL}, {_PIECE_SQL}", pa.schema([*_PLACE, *_PIECE]))

    # One row a block passes through each scan, in sorted order; nothing but the last prices is held.
    met = meet(blocks.join(long, KEY, "leftsemi").select(*PLACE, "role", "fault", "count"))
    ended = back(met.repartition(*KEY).sortWithinPartitions(*KEY, F.desc("_part"), F.desc("_seq")))
    begun = stored(forth(ended.repartition(*KEY).sortWithinPartitions(*PLACE)), "conversation-states")
    alone = blocks.join(long, KEY, "leftanti").withColumns({"exit": F.array(*[F.lit(c).cast("long") for c in END]), "entry": F.lit(0), "last": F.lit(True)})
    return mend(alone).withColumn("whole", F.lit(True)).unionByName(mend(blocks.join(begun, PLACE)).withColumn("whole", F.lit(False)))


def _summed(pieces: Iterator[dict]) -> Iterator[dict]:
    key = out = digest = edits = final = last_turn = None

    def close() -> dict:
        gaps = 0 if last_turn is None else last_turn - out["first_turn"] + 1 - out["turns"]
        return {**{c: out[c] for c in ("_conv", "_none", "blank", "duplicate", "truncated", "illegal", "cost")}, "gaps": gaps,
                "audit": "".join(edits), "repaired_sha256": digest.hexdigest()}

    for row in pieces:
        if key != (own := (row["_conv"], row["_none"])):
            if key is not None:
                yield close()
            key, out, digest, edits, final, last_turn, begun = own, dict(row), hashlib.sha256(), [], None, None, False
        else:
            for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                out[c] += row[c]
            out["illegal"] += final + row["first"] not in LEGAL
            out["turns"] += row["turns"] - (row["first_turn"] is not None and row["first_turn"] == last_turn)
            out["first_turn"] = row["first_turn"] if out["first_turn"] is None else out["first_turn"]
        final, last_turn = row["final"], last_turn if row["last_turn"] is None else row["last_turn"]
        edits.append(row["edits"])
        if row["roles"]:
            lines = "\n".join(f"{r}:{t}" for r, t in zip(row["roles"], row["texts"]))
            digest.update((("\n" if begun else "") + lines).encode())
            begun = True
    if key is not None:
        yield close()


def summaries(pieces: DataFrame) -> DataFrame:
    """One row per conversation (_conv, _none): faults, cost, audit and the digest of its repaired rows.

    A digest needs a conversation's rows in order, so the blocks of a long one pass through one task, one at a time.
    """
    names = ["blank", "duplicate", "truncated", "illegal", "cost", "gaps"]
    fold = _each(_summed, "_conv string, _none boolean, " + ", ".join(f"{c} bigint" for c in names) + ", audit string, repaired_sha256 string",
                 pa.schema([*_PLACE[:2], *[(c, pa.int64()) for c in names], ("audit", pa.string()), ("repaired_sha256", pa.string())]))
    parts = pieces.where(~F.col("whole")).repartition(*KEY).sortWithinPartitions(*PLACE)
    return fold(pieces.where("whole").drop("whole")).unionByName(fold(parts.drop("whole")))


def repaired_summaries(original: DataFrame, rows: DataFrame, *, id_col: str = "conv_id", block: int = BLOCK_ROWS) -> DataFrame:
    """``summaries`` of the repair of ``rows`` for every conversation of ``original``, also those without rows."""
    found = summaries(repair(rows, id_col=id_col, block=block))
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    ids = original.select(F.col(id_col), *_named(original, id_col)).distinct()
    return ids.join(found, KEY, "left").withColumns(counts).withColumn("audit", F.coalesce("audit", F.lit(""))) \
        .withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))) \
        .select(id_col, *counts, "audit", "repaired_sha256")
