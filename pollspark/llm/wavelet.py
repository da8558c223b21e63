"""Token ids as wavelet matrices: one compressed shard file, readable by position, token or range.

Documents are range-partitioned and sorted by id, encoded with the tokenizers library, closed with an end
id and cut into shards of a bounded number of tokens. A shard holds, for each bit of the ids from the
highest, one bit-plane; before the next plane the ids are stably parted into those with a 0 and those
with a 1. Counts of ones per block of 512 bits make rank cheap, select searches them. Shards are rows of
a Parquet table in the shared folder, so any store and a lost executor are Spark's business.

File format (little-endian): magic ``WVM1``; uint32 bits, uint32 documents, uint64 tokens; uint32 length
of each document; then per plane: uint64 zeros, bits padded to whole blocks, uint32 ones before each block.

Results for unusual input: a null or empty text has the end id alone; repeated ids follow each other in
the order of their texts' hashes; null ids come first; an empty table has no shard and an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from tokenizers import Tokenizer

from pollspark.llm.common import slices, stored
from pollspark.llm.pretokens import CHUNK

MAGIC = b"WVM1"
BLOCK = 512
SHARD_TOKENS = 2_000_000

# Fixed values of byte-level tokenizer files: the pattern of words, and the character that stands for each byte.
BYTE_LEVEL_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLED = {b: chr(b) for b in PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)).difference(PRINTED)))}


class WaveletMatrix:
    """Bit-planes of a sequence of ids with rank and select."""

    def __init__(self, bits: int, lengths: np.ndarray, n: int, zeros: list[int], planes: list[np.ndarray], ones: list[np.ndarray]):
        self.bits, self.lengths, self.n, self.zeros, self.planes, self.ones = bits, lengths, n, zeros, planes, ones

    @classmethod
    def build(cls, ids: np.ndarray, lengths: np.ndarray, bits: int) -> WaveletMatrix:
        ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ones = [], [], []
        for b in range(bits - 1, -1, -1):
            bit = ids & ids.dtype.type(1 << b) != 0
            packed = np.packbits(bit, bitorder="little")
            packed = np.append(packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8))
            count = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
            planes.append(packed)
            ones.append((np.cumsum(count, dtype=np.uint32) - count).astype(np.uint32))
            low = np.flatnonzero(~bit)  # positions are faster than two selections by mask
            zeros.append(len(low))
            ids = np.concatenate([ids.take(low), ids.take(np.flatnonzero(bit))])
        return cls(bits, lengths.astype(np.uint32), len(ids), zeros, planes, ones)

    def to_bytes(self) -> bytes:
        parts = [MAGIC, struct.pack("<IIQ", self.bits, len(self.lengths), self.n), self.lengths.astype("<u4").tobytes()]
        for zeros, plane, ones in zip(self.zeros, self.planes, self.ones):
            parts += [struct.pack("<Q", zeros), plane.tobytes(), ones.astype("<u4").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        bits, docs, n = struct.unpack_from("<IIQ", data, 4)
        at = 20 + 4 * docs
        lengths = np.frombuffer(data, "<u4", docs, 20)
        blocks = -(-n // BLOCK)
        zeros, planes, ones = [], [], []
        for _ in range(bits):
            zeros.append(struct.unpack_from("<Q", data, at)[0])
            planes.append(np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at + 8))
            ones.append(np.frombuffer(data, "<u4", blocks, at + 8 + blocks * BLOCK // 8))
            at += 8 + blocks * (BLOCK // 8 + 4)
        return cls(bits, lengths, n, zeros, planes, ones)

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position ``i``."""
        block, rest = divmod(i, BLOCK)
        if block == len(self.ones[level]):
            return self.n - self.zeros[level]
        inside = self.planes[level][block * BLOCK // 8:(block * BLOCK + rest + 7) // 8]
        tail = int(inside[-1]) >> rest % 8 << rest % 8 if rest % 8 else 0
        return int(self.ones[level][block]) + int(np.bitwise_count(inside).sum()) - tail.bit_count()

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) place that holds ``bit``."""
        ones = self.ones[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        window = np.unpackbits(self.planes[level][block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(window == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit = int(self.planes[level][i >> 3]) >> (i & 7) & 1
            one = self._rank1(level, i)
            i = self.zeros[level] + one if bit else i - one
            value = value << 1 | bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``token`` in positions ``lo`` to ``hi`` (exclusive)."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def find(self, token: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def all(self) -> np.ndarray:
        """The whole sequence, plane by plane from the lowest."""
        ids = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            whole = np.empty_like(ids)
            whole[np.flatnonzero(~bit)] = ids[:self.zeros[level]]
            whole[np.flatnonzero(bit)] = ids[self.zeros[level]:] | ids.dtype.type(1 << (self.bits - 1 - level))
            ids = whole
        return ids


class ByteLevelChunks(dict):
    """Chunk of text -> its ids, little-endian; a chunk that is not known yet is cut into words and encoded.

    The merges are the library's, word by word. Words of ASCII letters behind a blank are cut as they stand, other
    chunks of Latin text by ``BYTE_LEVEL_WORDS``, all others by the library, whose Unicode tables decide.
    """

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenize, self.split = tokenizer.model.tokenize, tokenizer.pre_tokenizer.pre_tokenize_str
        self.words: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if chunk[0] == " " and chunk.isascii() and chunk[1:].isalpha():
            out = self._word(chunk)
        elif max(chunk) < "\u0250":
            out = b"".join([self.words.get(w) or self._word(w) for w in BYTE_LEVEL_WORDS.findall(chunk)])
        else:
            out = b"".join([self._spelled(w) for w, _ in self.split(chunk)])
        self[chunk] = out
        return out

    def _word(self, word: str) -> bytes:
        out = self.words[word] = self._spelled(word.encode().decode("latin1").translate(SPELLED))
        return out

    def _spelled(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(word)]).tobytes()


class Encoder:
    """Texts to ids with the tokenizers library; what the library would give for the whole text, without special tokens.

    Files of the byte-level form without normaliser or prefix space encode white-space-led chunks independently, and a
    chunk that recurs is looked up. ``limit`` bounds the memory of chunks; at the limit it starts anew.
    """

    def __init__(self, spec: str, limit: int = 1_000_000):
        self.tokenizer, parts, self.limit = Tokenizer.from_str(spec), json.loads(spec), limit
        self.bits = max(1, max(self.tokenizer.get_vocab().values()).bit_length())
        self.special = [t["content"] for t in parts.get("added_tokens") or []]
        pre = parts.get("pre_tokenizer") or {}
        self.whole = bool(parts.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True))
        self.known = ByteLevelChunks(self.tokenizer) if not self.whole else None

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.known is not None and len(self.known) + len(self.known.words) > self.limit:
            self.known = ByteLevelChunks(self.tokenizer)
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                if self.whole or any(s in t for s in self.special) else b"".join(map(self.known.__getitem__, CHUNK.findall(t))) for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """Kept in this Python worker for the tasks that follow."""
    if spec not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS.clear()
        _ENCODERS[spec] = Encoder(spec)
    return _ENCODERS[spec]


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text",
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shards (part, shard, n_tokens, doc_ids, file) of all documents in ascending order of their ids, stored."""
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        bits = max(encoder.bits, int(end_id).bit_length())
        part, shard = TaskContext.get().partitionId(), 0
        ids, doc_ids, held = [], [], 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in ids], np.uint32)
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(ids), "<u4"), lengths, bits)
            rows = {"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_tokens": pa.array([matrix.n], pa.int64()),
                    "doc_ids": pa.array([pa.concat_arrays(doc_ids).to_pylist()], pa.list_(doc_ids[0].type)), "file": pa.array([matrix.to_bytes()], pa.binary())}
            return pa.RecordBatch.from_pydict(rows)

        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, limit=min(1 << 20, shard_tokens)):
            ids += [x + end for x in encoder.encode(batch.column("text").to_pylist())]
            doc_ids.append(batch.column("id"))
            held += sum(len(x) // 4 for x in ids[-batch.num_rows:])
            if held >= shard_tokens:
                yield close()
                shard, ids, doc_ids, held = shard + 1, [], [], 0
        if ids:
            yield close()

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id"), F.xxhash64("text")]
    dealt = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(build, f"part int, shard int, n_tokens long, doc_ids array<{kind}>, file binary"), "token-shards")


def read_shards(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids) of every document, read back from the shard files.

    ``ids`` are little-endian unsigned 32-bit integers; a caller that does not select them does not move them.
    """
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                part, shard, doc_ids, file = (batch.column(c)[at] for c in ("part", "shard", "doc_ids", "file"))
                matrix = WaveletMatrix.from_bytes(file.as_py())
                ids, lengths = matrix.all().astype("<u4"), matrix.lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                cut = [ids[e - k:e].tobytes() for e, k in zip(ends, lengths)]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part.as_py()] * len(cut), pa.int32()), "shard": pa.array([shard.as_py()] * len(cut), pa.int32()),
                    "id": doc_ids.values, "inside": pa.array(ends - lengths), "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()), "ids": pa.array(cut, pa.binary())})

    found = shards.select("part", "shard", "doc_ids", "file").mapInArrow(
        rows, f"part int, shard int, id {kind}, inside long, n_tokens long, ids_crc32 long, ids binary")
    # One row per shard, so this window is as small as the list of files.
    before = W.orderBy("part", "shard").rowsBetween(W.unboundedPreceding, -1)
    bases = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return found.join(bases, ["part", "shard"]).select(
        F.col("id").alias(id_col), (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "ids")
