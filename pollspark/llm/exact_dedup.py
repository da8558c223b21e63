"""Exact duplicates by counting quotient filters and byte verification.

Each partition enters the 64-bit fingerprints of its normalised texts into counting quotient filters, one
per range of fingerprints. Filters of a range are merged without loss by merging their sorted remainders and
adding counts, so a group of any number of copies travels as one counted entry per partition. Only texts
whose fingerprint has a count above one are compared byte by byte, as keys of an aggregate that combines
copies before the shuffle.

Results for unusual input: a null text counts as empty, so null and blank texts form one group; of repeated
rows (same id, same text) exactly one can stay; a null id ranks after all others; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pollspark.llm.common import rows_with, stored

BLANKS = r"[\x20\x09-\x0D]+"


class CountingQuotientFilter:
    """A multiset of 64-bit fingerprints: quotients as a bit vector with run ends, sorted remainders, counts above one apart."""

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray):
        """``fingerprints`` are sorted and distinct."""
        self.fingerprints, self.counts = fingerprints, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        return cls(*np.unique(fingerprints, return_counts=True))

    def merge(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        every = [self, *others]
        keys = np.concatenate([f.fingerprints for f in every])
        order = np.argsort(keys, kind="stable")  # merges the sorted runs
        keys, counts = keys[order], np.concatenate([f.counts for f in every])[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return CountingQuotientFilter(keys[first], np.add.reduceat(counts, first) if len(first) else counts)

    def to_bytes(self) -> bytes:
        n = len(self.fingerprints)
        base = self.fingerprints[0] if n else np.uint64(0)
        span = int(self.fingerprints[-1] - base) if n else 0
        r = max(0, span.bit_length() - max(1, n).bit_length())  # about one quotient per entry
        width = next(w for w in (1, 2, 4, 8) if r <= 8 * w)
        above = self.fingerprints - base
        quotients = (above >> np.uint64(r)).astype(np.int64)
        remainders = (above & np.uint64((1 << r) - 1)).astype(f"<u{width}")
        occupied = np.zeros(int(quotients[-1]) + 1 if n else 0, bool)
        occupied[quotients] = True
        run_ends = np.append(quotients[1:] != quotients[:-1], True) if n else np.zeros(0, bool)
        many = self.counts > 1
        head = struct.pack("<QQQBB", n, int(base), len(occupied), r, width)
        return b"".join([head, np.packbits(occupied).tobytes(), np.packbits(run_ends).tobytes(), remainders.tobytes(),
                         np.packbits(many).tobytes(), self.counts[many].astype("<u8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        n, base, slots, r, width = struct.unpack_from("<QQQBB", data)
        at = 26

        def bits(k: int) -> np.ndarray:
            nonlocal at
            found = np.unpackbits(np.frombuffer(data, np.uint8, -(-k // 8), at), count=k).view(bool)
            at += -(-k // 8)
            return found

        occupied, run_ends = np.flatnonzero(bits(slots)), bits(n)
        remainders = np.frombuffer(data, f"<u{width}", n, at).astype(np.uint64)
        at += n * width
        many = bits(n)
        run = np.cumsum(run_ends) - run_ends
        counts = np.ones(n, np.int64)
        counts[many] = np.frombuffer(data, "<u8", int(many.sum()), at)
        quotients = occupied[run].astype(np.uint64) if n else np.zeros(0, np.uint64)
        return cls((quotients << np.uint64(r)) + remainders + np.uint64(base), counts)


def repeated_fingerprints(fingerprints: DataFrame, ranges: int) -> DataFrame:
    """(fp, n): the fingerprints that occur more than once in the one-column frame, with their counts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy().view(np.uint64) for b in batches]
        if not parts:
            return
        whole = CountingQuotientFilter.of(np.concatenate(parts))
        cuts = np.searchsorted(whole.fingerprints, np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64))
        own, found = [], []
        for k, (keys, counts) in enumerate(zip(np.split(whole.fingerprints, cuts), np.split(whole.counts, cuts))):
            if len(keys):
                own.append(k), found.append(CountingQuotientFilter(keys, counts).to_bytes())
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(found, pa.binary())], ["range", "filter"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def repeated(f: CountingQuotientFilter) -> pa.RecordBatch:
            many = f.counts > 1
            return pa.RecordBatch.from_arrays([pa.array(f.fingerprints[many].view(np.int64)), pa.array(f.counts[many], pa.int64())], ["fp", "n"])

        current, held = None, None
        for batch in batches:  # sorted by range
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = CountingQuotientFilter.from_bytes(data.as_py())
                if k != current:
                    if held is not None:
                        yield repeated(held)
                    current, held = k, found
                else:
                    held = held.merge(found)
        if held is not None:
            yield repeated(held)

    filters = fingerprints.mapInArrow(build, "range int, filter binary")
    return filters.repartition("range").sortWithinPartitions("range").mapInArrow(merge, "fp long, n long")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, n_chars) per row; of a group the longest original, then the smallest id stays."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = docs.select(F.col(id_col).alias("id"), F.length(text).alias("n_chars"), F.regexp_replace(text, BLANKS, "").alias("norm"))
    facts = stored(norm.select("id", "n_chars", F.xxhash64("norm").alias("fp"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha")), "exact-facts")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    repeated = stored(repeated_fingerprints(facts.select("fp"), ranges), "exact-repeated")

    # Byte verification: the text itself is part of the key. Spark broadcasts the fingerprints when their file is small.
    suspects = norm.withColumn("fp", F.xxhash64("norm")).join(repeated.select("fp"), "fp")
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id")))
    groups = suspects.groupBy("fp", "norm").agg(F.count("*").alias("group_size"), best.alias("best")) \
        .select(F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars"))

    # Repeated rows are counted and written out again, so that only the first of them can stay.
    rows = facts.groupBy("id", "n_chars", "sha").agg(F.count("*").alias("times")).join(groups, "sha", "left")
    copy = F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")
    single = F.col("group_size").isNull()
    return rows.select("*", copy).select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (single | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")) & (F.col("copy") == 1))).alias("kept"),
        F.col("sha").alias("text_sha256"), "n_chars")


def kept_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    found = exact_groups(docs, id_col=id_col, text_col=text_col).where("kept")
    stay = found.select(F.col(id_col).alias("id"), F.concat("text_sha256", F.lit(" "), "n_chars").alias("key"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat(F.sha2(F.regexp_replace(text, BLANKS, "").cast("binary"), 256), F.lit(" "), F.length(text))
    return rows_with(docs, stay, key, id_col).select("doc.*")
