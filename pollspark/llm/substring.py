"""Substring dedup by level-wise doubling of repeated windows.

Lengths double up to the window. A window can only be repeated if the windows inside it are, so at each
length only what was repeated at the length before is looked at. At the lengths below the window, every
window stands on its least gram of that length (by hash): equal windows have equal least grams, so a
window whose least gram occurs nowhere else is dropped, and only one row per run of windows with the same
least gram is shuffled. At the last length the surviving windows are compared by 128-bit hashes of words.

Each partition first settles what repeats inside it and sends one row per hash, so a passage in a third of
all documents meets in one place with one row per partition. Texts with exact copies are settled by a
count: all their windows are repeated. Of them one text stays as partner for others.

Results for unusual input: a null text has no words; texts shorter than the window lose nothing; repeated
rows are copies of each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from pollspark.llm.common import slices, stored

ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes per word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def gram_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of ``length`` consecutive words (one 64-bit column of word hashes), by doubling."""
    out, size, power = None, 0, words
    step, bit = 1, length
    factor = ODD
    while bit:
        if bit & 1:
            if out is None:
                out, size = power, step
            else:
                n = len(words) - size - step + 1
                out = out[:n] * factor + power[size:size + n]
                size += step
        bit >>= 1
        if bit:
            n = len(power) - step
            power = power[:n] * factor + power[step:step + n]
            factor = np.uint64(int(factor) ** 2 % (1 << 64))
            step *= 2
    return _mixed(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while size < width:
        step = min(size, width - size)
        out = np.minimum(out[:-step], out[step:])
        size += step
    return out


def lengths_to(window: int, shortest: int) -> list[int]:
    out = [window]
    while out[0] > shortest:
        out.insert(0, -(-out[0] // 2))
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


ROW = "h1 long, h2 long, sure boolean, n int, k1 long, k2 long, a int, b int"
NAMES = [part.split()[0] for part in ROW.split(", ")]


def _settled(h: np.ndarray, n: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of one partition: entries that repeat inside it as sure, one marker per such hash, and the single ones."""
    order = np.lexsort((h[:, 1], h[:, 0]))
    h, n, key, a, b = h[order], n[order], key[order], a[order], b[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]).any(1)))
    total = np.add.reduceat(n, first)
    many = np.repeat(total > 1, np.diff(np.append(first, len(h))))
    marks = h[first[total > 1]]
    # Sure entries of neighbouring windows are joined to longer ones.
    s_key, s_a, s_b = key[many], a[many], b[many]
    order = np.lexsort((s_a, s_key[:, 1], s_key[:, 0]))
    s_key, s_a, s_b = s_key[order], s_a[order], s_b[order]
    if len(s_a):
        new = np.append(True, (s_key[1:] != s_key[:-1]).any(1) | (s_a[1:] > s_b[:-1] + 1))
        at = np.flatnonzero(new)
        s_b = np.maximum.reduceat(s_b, at)
        s_key, s_a = s_key[at], s_a[at]
    one = ~many
    size = len(marks), int(one.sum()), len(s_a)
    none = np.zeros(size[0], np.int32)
    gone = np.repeat([True, False, False], size)
    col = lambda x, kind, mask=None: pa.array(np.concatenate(x).astype(kind), mask=mask)
    long = [marks, h[one], _mixed(s_key + s_a.astype(np.uint64)[:, None])]
    rows = pa.RecordBatch.from_arrays([
        col([x[:, 0].view(np.int64) for x in long], np.int64), col([x[:, 1].view(np.int64) for x in long], np.int64),
        pa.array(np.repeat([False, False, True], size)), pa.array(np.repeat([2, 1, 2], size).astype(np.int32)),
        col([none, key[one, 0].view(np.int64), s_key[:, 0].view(np.int64)], np.int64, gone),
        col([none, key[one, 1].view(np.int64), s_key[:, 1].view(np.int64)], np.int64, gone),
        col([none, a[one], s_a], np.int32, gone), col([none, b[one], s_b], np.int32, gone)], NAMES)
    for i in range(0, rows.num_rows, 200_000):
        yield rows.slice(i, 200_000)


def repeated(texts: DataFrame, length: int, window: int) -> DataFrame:
    """(k1, k2, a, b): ranges of window starts whose gram (or, at the last length, whose self) occurs at another place.

    ``texts`` holds (k1, k2, text) and, after the first length, ``ranges`` that survived.
    """
    narrowed = "ranges" in texts.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        parts: list[tuple] = []
        for batch in slices(batches):
            ranges = batch.column("ranges").to_pylist() if narrowed else [None] * batch.num_rows
            for k1, k2, text, own in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text")), ranges):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                words = words_of(text)
                n = len(words) - window + 1
                if n <= 0:
                    continue
                both = word_hashes(words)
                live = np.ones(n, bool)
                if own is not None:
                    live[:] = False
                    for r in own:
                        live[r["a"]:r["b"] + 1] = True
                if length < window:
                    grams = gram_hashes(both[:, 0], length)
                    width = window - length + 1
                    least = sliding_least(grams, width)
                    cut = np.append(True, least[1:] != least[:-1])
                    cut[1:] |= live[1:] != live[:-1]
                    a = np.flatnonzero(cut)
                    b = np.append(a[1:] - 1, n - 1)
                    # Places of the least gram among those that the windows of the run cover.
                    places = np.zeros(len(a), np.int64)
                    run = np.repeat(np.arange(len(a)), b - a + 1)
                    hit = grams[:n] == least
                    np.add.at(places, run[hit], 1)
                    for extra in range(1, width):
                        at = b + extra
                        places += grams[at] == least[b]
                    a, b, places = (x[live[a]] for x in (a, b, places))
                    h = np.stack([least[a], least[a]], 1)
                    parts.append((h, np.minimum(np.maximum(places, 1), 2), a, b, k1, k2))
                else:
                    a = np.flatnonzero(live)
                    h = np.stack([gram_hashes(both[:, 0], length)[a], gram_hashes(both[:, 1], length)[a]], 1)
                    parts.append((h, np.ones(len(a), np.int64), a, a, k1, k2))
        if parts:
            key = np.repeat(np.array([p[4:] for p in parts], np.int64).view(np.uint64), [len(p[2]) for p in parts], axis=0)
            h, n, a, b = (np.concatenate([p[i] for p in parts]) for i in range(4))
            if len(h):
                yield from _settled(h, n, key, a, b)

    every = W.partitionBy("sure", "h1", "h2")
    # Rows of one text alone, met in several partitions as copies, are one occurrence.
    more = (F.max("n").over(every) > 1) | (F.min("k1").over(every) != F.max("k1").over(every)) | (F.min("k2").over(every) != F.max("k2").over(every))
    return texts.mapInArrow(rows, ROW).withColumn("more", more).where(F.col("more") & F.col("k1").isNotNull()).select("k1", "k2", "a", "b")


def remove_repeats(docs: DataFrame, window: int = 35, *, shortest: int = 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k1"), batch.column("k2"), pa.array([len(w) for w in words], pa.int64()), pa.array(sha)],
                                             ["id", "k1", "k2", "n_words", "sha"])

    kind = docs.schema[id_col].dataType.simpleString()
    facts = stored(keyed.mapInArrow(count, f"id {kind}, k1 long, k2 long, n_words long, sha string"), "substring-facts")
    one_of = facts.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("id").alias("id"))

    texts, spans = keyed.select("k1", "k2", "text"), None
    for level, length in enumerate(lengths_to(window, shortest)):
        spans = stored(repeated(texts, length, window), "substring-spans")
        merged = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))  # of one text
        if level == 0:  # one row of each text with survivors goes on
            chosen = merged.join(one_of, ["k1", "k2"])
            read = keyed.withColumn("same", F.coalesce(F.col("id").cast("string"), F.lit(""))) \
                .join(chosen.select("k1", "k2", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("same"), "ranges"), ["k1", "k2", "same"])
            texts = stored(read.select("k1", "k2", "text", "ranges"), "substring-texts")
        else:
            texts = texts.drop("ranges").join(merged, ["k1", "k2"])
            if length < window:
                texts = stored(texts, "substring-texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for k1, k2, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "ranges"))):
                words = words_of(text)
                gone = np.zeros(len(words), bool)
                for r in ranges:
                    gone[r["a"]:r["b"] + window] = True
                kept = b" ".join([words[i] for i in np.flatnonzero(~gone)])
                out.append((k1, k2, int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            k1, k2, n, sha = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64()), pa.array(sha)], ["k1", "k2", "n", "cut_sha"])

    removed = texts.mapInArrow(cut, "k1 long, k2 long, n long, cut_sha string").dropDuplicates(["k1", "k2"])
    info = one_of.drop("id").join(removed, ["k1", "k2"], "left").where("copies > 1 OR n IS NOT NULL")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= window)
    return facts.join(info, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"))
