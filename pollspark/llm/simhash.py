"""Near-duplicates by SimHash fingerprints and an inverted index of their bytes with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of their 8 positional bytes, so at
least 3 of the 4 bytes of one half. The index lists, for each half and each choice of 3 of its 4 bytes, the
distinct fingerprints that hold these positional bytes; lists of single bytes, with a 256th of all
fingerprints each, are never paired. Within a list the shared positional bytes of each pair are tallied,
pairs with 5 or more are kept and their bits compared. Equal fingerprints are one entry. Long lists are
cut into blocks that meet pairwise, each meeting in bounded memory, and a meeting reports one link per
newly connected fingerprint instead of all its pairs. Components are then found on the links.

``one_of_each`` is the form for cleaning a corpus: the components of fingerprints are its first groups, each text
checked exactly against the one that names its component (a Jaccard similarity of 0.8 or more of the sets of
five-word shingles). The exact join in ``near_join`` follows on what these groups leave apart.

Results for unusual input: a text without words, empty or null has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle; repeated rows share a component; null ids never
name a component that has another id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pollspark.llm.common import rows_with, slices, small_batches, stored
from pollspark.llm.components import components
from pollspark.llm.near_join import KEY, keyed, near_groups

BLOCK = 2048
LOW = np.uint64(0x0101010101010101)


def hashes(text: str, shingle: int, seed: int) -> np.ndarray:
    """XXH64 values of the word shingles, A-Z in lower case; fewer words are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    digest = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)] if words else []
    return np.array([digest(g, seed) for g in grams], "<u8")


def majority(values: np.ndarray) -> int:
    """The bits set in over half of the values; zero without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(values), 1 << 14):
        ones += np.unpackbits(values[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the XXH64 values of the word shingles, A-Z in lower case."""
    return majority(hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, *, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row, fp as a signed 64-bit integer."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t or "", shingle, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(rows, f"id {kind}, fp long")


def linked(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Matrix of pairs: at least 8 - ``bits`` shared positional bytes, and at most ``bits`` different bits."""
    x = a[:, None] ^ b[None, :]
    y = x | x >> np.uint64(4)
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    shared = 8 - np.bitwise_count(y & LOW)
    return (shared >= 8 - bits) & (np.bitwise_count(x) <= bits)


def spanning_links(left: np.ndarray, right: np.ndarray | None, bits: int) -> list[tuple[int, int]]:
    """Links (member, root) that connect what the pairs within ``left``, or between ``left`` and ``right``, connect."""
    if right is None:
        right = left
    near = linked(left, right, bits)
    free = np.ones(len(right), bool)
    done = np.zeros(len(left), bool)
    out = []
    for i in np.flatnonzero(near.any(1)):
        if done[i]:
            continue
        rows, cols = np.array([i]), np.zeros(0, np.int64)
        done[i] = True
        while len(rows):
            new = np.flatnonzero(near[rows].any(0) & free)
            free[new] = False
            cols = np.append(cols, new)
            rows = np.flatnonzero(near[:, new].any(1) & ~done) if len(new) else rows[:0]
            done[rows] = True
            out += [(int(left[r]), int(left[i])) for r in rows]
        out += [(int(right[c]), int(left[i])) for c in cols if right[c] != left[i]]
    return out


def byte_choices(bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which any two fingerprints within ``bits`` share at least one set whole."""
    if bits <= 3:  # 5 shared bytes put 3 into one half
        return [tuple(4 * half + i for i in range(4) if i != omitted) for half in range(2) for omitted in range(4)]
    return list(itertools.combinations(range(8), min(3, 8 - bits)))


def near_links(distinct: DataFrame, bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of a one-column frame (fp) within ``bits`` (at most 7).

    They connect all that such pairs connect.
    """
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(255) for i in range(8)]
    keys = []
    for k, choice in enumerate(byte_choices(bits)):
        key = F.lit(k)
        for i in choice:
            key = key * 256 + byte[i]
        keys.append(key.cast("long"))
    postings = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    cut = postings.join(lists, "key").withColumn("blocks", F.ceil(F.col("n") / block)) \
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    meet = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(meeting: tuple, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
            own, fp = (np.concatenate(x) for x in zip(*parts))
            if meeting[1] == meeting[2]:
                return spanning_links(fp, None, bits) if len(fp) > 1 else []
            first = own == meeting[1]
            return spanning_links(fp[first], fp[~first], bits)

        current, parts = None, []
        for batch in batches:  # sorted by meeting
            key, i, j, own = (batch.column(c).to_numpy() for c in ("key", "i", "j", "own"))
            fp = batch.column("fp").to_numpy().view(np.uint64)
            edge = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            links = []
            for s, e in zip([0, *edge], [*edge, len(key)]):
                if s == e:
                    continue
                meeting = int(key[s]), int(i[s]), int(j[s])
                if meeting != current:
                    if parts:
                        links += solve(current, parts)
                    current, parts = meeting, []
                parts.append((own[s:e], fp[s:e]))
            yield pairs(links)
        if parts:
            yield pairs(solve(current, parts))

    def pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return meet.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(rows, "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle: int = 3, bits: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row; a component is named by its least id."""
    prints = stored(fingerprints(docs, shingle=shingle, seed=seed, id_col=id_col, text_col=text_col), "simhash")
    least = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = components(near_links(least.select("fp"), bits))
    named = least.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.select("fp", "root").join(names, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each group of verified near-duplicates, with its columns; of equal texts the least id."""
    named = keyed(docs, text_col)
    texts = named.select(F.col(KEY).alias("key"), F.col(text_col).alias("text"))
    found = near_duplicates(texts, id_col="key").where("key <> component_id")
    nominated = stored(found.select(F.col("key").alias("x"), F.col("component_id").alias("y")).distinct(), "simhash-pairs")
    gone = near_groups(named, text_col=text_col, nominated=nominated, **options).select("key")
    ids = named.select(F.col(KEY).alias("key"), F.col(id_col).alias("id"))
    stay = ids.groupBy("key").agg(F.min("id").alias("id")).join(gone, "key", "left_anti")
    return rows_with(named, stay, F.col(KEY), id_col).select("doc.*").drop(KEY)
