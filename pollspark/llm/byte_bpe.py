"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each Spark partition.

Encoding: each distinct word of a batch becomes rows (word, position, token), one per byte. One step of a
recursive query joins neighbouring tokens with the merge table and contracts, in every word, the leftmost
pair of minimum rank; words without a pair are finished. A step also takes the following occurrences of
the same rank while doing so cannot matter: it goes left to right and stops at the first occurrence whose
new neighbours could merge at a lower rank, because that merge would come first. So a word needs about as
many steps as it uses different ranks, not as many as it has tokens.

Decoding: the bytes of all ids of a batch are gathered from the vocabulary in the order of the ids, as one Arrow
array; a document's bytes are a stretch of it.

Results for unusual input: a null text counts as empty; an empty text has no ids and the digest of no bytes;
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pollspark.llm.common import slices, small_batches
from pollspark.llm.pretokens import ByWords, ChunkEncoder

WORDS_PER_QUERY = 20_000
BYTES_PER_QUERY = 400_000
BYTES_PER_SLICE = 2 << 20  # of texts encoded together: a query's recursion costs the same for few new words as for many

SHORT = 64  # bytes; longer words take the query with several contractions a step

ONE_PAIR = """
WITH RECURSIVE step(word, id, tok, nxt, nxt_tok, more) AS (
    SELECT word, id, tok, nxt, nxt_tok, true FROM bytes_of
  UNION ALL
    SELECT word, id, tok, nxt, nxt_tok, more FROM (
        WITH pairs AS (
            SELECT s.*, (m.merged::BIGINT << 32) | s.id AS rank
            FROM step s LEFT JOIN merges m ON s.tok = m.a AND s.nxt_tok = m.b WHERE s.more
        ), best AS (   -- the leftmost pair of least rank in each word
            SELECT word, min(rank) AS rank, arg_min(nxt, rank) AS right_id FROM pairs WHERE rank IS NOT NULL GROUP BY word
        )
        -- The merged token takes the right row, the left row goes, the row before points past it.
        SELECT p.word, p.id,
               CASE WHEN p.id = b.right_id THEN (b.rank >> 32)::INT ELSE p.tok END AS tok,
               CASE WHEN p.nxt = b.rank & 4294967295 THEN b.right_id ELSE p.nxt END AS nxt,
               CASE WHEN p.nxt = b.rank & 4294967295 THEN (b.rank >> 32)::INT ELSE p.nxt_tok END AS nxt_tok,
               b.rank IS NOT NULL AS more
        FROM pairs p LEFT JOIN best b ON p.word = b.word
        WHERE b.rank IS NULL OR p.id <> b.rank & 4294967295
    )
)
SELECT word, tok FROM step WHERE NOT more ORDER BY id
"""

SEVERAL_PAIRS = """
WITH RECURSIVE step(word, pos, tok, more) AS (
    SELECT word, pos, tok, true FROM bytes_of
  UNION ALL
    SELECT word, pos, tok, more FROM (
        WITH pairs AS (
            SELECT s.word, s.pos, s.tok, lead(s.tok) OVER w AS nxt, lead(s.pos) OVER w AS nxt_pos,
                   lead(s.tok, 2) OVER w AS nxt2, lag(s.tok) OVER w AS prev
            FROM step s WHERE s.more WINDOW w AS (PARTITION BY s.word ORDER BY s.pos)
        ), ranked AS (
            SELECT p.*, m.merged, min(m.merged) OVER (PARTITION BY p.word) AS least,
                   row_number() OVER (PARTITION BY p.word ORDER BY p.pos) AS n
            FROM pairs p LEFT JOIN merges m ON p.tok = m.a AND p.nxt = m.b
        ), hits AS (   -- occurrences of the least rank; of overlapping ones every second, from the left
            SELECT word, n, pos, nxt_pos, merged, nxt2, prev,
                   n - row_number() OVER (PARTITION BY word ORDER BY n) AS run
            FROM ranked WHERE merged = least
        ), spaced AS (
            SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY n) % 2 AS odd FROM hits
        ), chosen AS (
            SELECT *, CASE WHEN lag(n) OVER (PARTITION BY word ORDER BY n) = n - 2 THEN merged ELSE prev END AS lft
            FROM spaced WHERE odd = 1
        ), judged AS (
            SELECT c.word, c.n, c.pos, c.nxt_pos, c.merged,
                   coalesce(l.merged < c.merged, false) OR coalesce(r.merged < c.merged, false) AS stop
            FROM chosen c LEFT JOIN merges l ON c.lft = l.a AND c.merged = l.b
                          LEFT JOIN merges r ON c.merged = r.a AND c.nxt2 = r.b
        ), taken AS (
            SELECT word, pos, nxt_pos, merged FROM (
                SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY word ORDER BY n
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM judged)
            WHERE stops = 0
        )
        SELECT r.word, r.pos, coalesce(t.merged, r.tok) AS tok, r.least IS NOT NULL AS more
        FROM ranked r LEFT JOIN taken t ON r.word = t.word AND r.pos = t.pos
        WHERE NOT EXISTS (SELECT 1 FROM taken g WHERE g.word = r.word AND g.nxt_pos = r.pos)
    )
)
SELECT word, tok FROM step WHERE NOT more ORDER BY word, pos
"""

def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Merger:
    """DuckDB tables of one vocabulary and the two queries on them."""

    def __init__(self, ranks: dict[bytes, int], memory: str = "256MB"):
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "max_temp_directory_size": "0B"})
        a, b, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    a.append(left), b.append(right), merged.append(rank)
        int32 = lambda x: pa.array(x, pa.int32())
        self._table("merges", a=int32(a), b=int32(b), merged=int32(merged))
        self.vocabulary = pa.array(list(ranks), pa.binary())
        self.entry = np.full(max(ranks.values()) + 1, -1, np.int32)  # of an id in the vocabulary
        self.entry[list(ranks.values())] = np.arange(len(ranks))
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.con.register("incoming", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        raws = [w.encode() for w in words]
        out: list[bytes] = [b""] * len(raws)
        for long in (False, True):
            own = [i for i, raw in enumerate(raws) if (len(raw) > SHORT) == long]
            for i, ids in zip(own, self._merge_batches([raws[i] for i in own])):
                out[i] = ids
        return out

    def _merge_batches(self, raws: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        batch: list[bytes] = []
        size = 0
        for raw in raws:
            if batch and (len(batch) >= WORDS_PER_QUERY or size + len(raw) > BYTES_PER_QUERY):
                out += self._merge(batch)
                batch, size = [], 0
            batch.append(raw)
            size += len(raw)
        return out + (self._merge(batch) if batch else [])

    def _merge(self, words: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(lengths.sum()) - np.repeat(starts, lengths)).astype(np.int32)
        tok = self.single[np.frombuffer(b"".join(words), np.uint8)]
        if lengths.max() <= SHORT:
            ids = np.arange(len(tok), dtype=np.int32)
            last = pos + 1 == np.repeat(lengths, lengths)
            nxt = pa.array(ids + 1, mask=last), pa.array(np.append(tok[1:], 0).astype(np.int32), mask=last)
            self.con.register("bytes_of", pa.table({"word": word, "id": ids, "tok": tok, "nxt": nxt[0], "nxt_tok": nxt[1]}))
            done = self.con.sql(ONE_PAIR).to_arrow_table()
        else:
            self.con.register("bytes_of", pa.table({"word": word, "pos": pos, "tok": tok}))
            done = self.con.sql(SEVERAL_PAIRS).to_arrow_table()
        self.con.unregister("bytes_of")
        ids = done["tok"].to_numpy().astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(done["word"].to_numpy(), minlength=len(words))) * 4
        return [ids[s:e] for s, e in zip([0, *ends[:-1]], ends)]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence."""
        found = self.vocabulary.take(pa.array(self.entry[np.frombuffer(b"".join(ids), "<u4")]))
        whole = b"" if found.buffers()[2] is None else found.buffers()[2].to_pybytes()
        starts = np.frombuffer(found.buffers()[1], np.int32)
        ends = starts[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        return [whole[s:e] for s, e in zip(ends, ends[1:])]


_ENCODERS: dict[tuple[str, str], tuple[Merger, ChunkEncoder]] = {}


def _encoder(ranks: dict[bytes, int], pattern: str) -> tuple[Merger, ChunkEncoder]:
    """Tables and memory of this Python worker; tasks that follow in it use them again."""
    key = hashlib.sha256(b"".join(b"%d %d " % (len(t), r) + t for t, r in ranks.items())).hexdigest(), pattern
    if key not in _ENCODERS:
        _ENCODERS.clear()
        merger = Merger(ranks)
        _ENCODERS[key] = merger, ChunkEncoder(ByWords(pattern, merger.encode_words))
    return _ENCODERS[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids as little-endian unsigned 32-bit integers, decoded bytes) of every row of ``docs``.

    The vocabulary is read on the driver and sent to the executors; its size is that of the rank file.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, encoder = _encoder(ranks.value, pattern)
        for batch in slices(batches, limit=BYTES_PER_SLICE):
            ids = encoder.encode(batch.column("text").to_pylist())
            columns = [batch.column("id"), pa.array(ids, pa.binary()), pa.array(merger.decode(ids), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return small_batches(texts).mapInArrow(rows, f"id {kind}, ids binary, decoded binary").withColumnRenamed("id", id_col)
