"""Language ID by interpolated Kneser-Ney character models.

Training counts character n-grams of a bounded sample of labelled documents per language (``train_docs``
whole documents, those of least id hash), in Spark. From the counts come the interpolated Kneser-Ney
probabilities of every n-gram that any language has seen, kept per order in arrays sorted by 64-bit hash
with one column per language, next to the back-off weights of the contexts. A text takes the language of
least cross-entropy per character. A fifth of the sample is left out of the counts for calibration: the
limit of a language lies halfway between the largest cross-entropy of those of its documents and the cost
of a letter it has never seen. A text beyond the limit is rejected; short or noisy texts stay far below it.

Texts are lower-cased; every run of characters that are not letters is one boundary character.

Results for unusual input: a null text, or one without a letter, gives ``und`` with score 0 and is rejected;
null labels and null ids are not learned from; without any labelled document everything is ``und``; ties go
to the first language in order; repeated rows give repeated results; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from pollspark.llm.common import slices, small_batches

ORDER = 4
TRAIN_DOCS = 400  # per language
UNKNOWN = "und"
STEP = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def characters(text: str) -> np.ndarray:
    """Code points of the letters in lower case, with one space for each run of others and at both ends; empty without letters."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    if not letter.any():
        return points[:0]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, points, 32)[keep]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each position, for n from 1 to ``order``; the first n-1 of each are of no use."""
    single = _mixed((points.astype(np.uint64) + np.uint64(1)) * STEP)
    out = [single]
    for _ in range(order - 1):
        longer = out[-1].copy()
        longer[1:] = out[-1][:-1] * STEP + single[1:]
        out.append(longer)
    return out


@dataclass
class Model:
    languages: list[str]
    hashes: list[np.ndarray]   # per order, sorted
    scores: list[np.ndarray]   # per order, log probability of the last character; a column per language
    backoff: list[np.ndarray]  # per order, log weight of the n-gram as a context
    unseen: np.ndarray         # log probability of a character no language has
    limits: np.ndarray         # largest accepted cross-entropy per language

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Cross-entropy per character of each (non-empty) text under each language."""
        lengths = np.array([len(t) - 1 for t in texts])
        points = np.concatenate(texts)
        order = len(self.hashes)
        grams = gram_hashes(points, order)
        inside = np.concatenate([np.arange(len(t)) for t in texts])
        rest = np.flatnonzero(inside > 0)  # the boundary at the start is context only
        total = np.zeros((len(points), len(self.languages)), np.float32)
        for n in range(order, 0, -1):
            own = rest if n == 1 else rest[inside[rest] >= n - 1]
            short = rest[:0] if n == 1 else rest[inside[rest] < n - 1]
            at, found = self._find(n, grams[n - 1][own])
            total[own[found]] += self.scores[n - 1][at[found]]
            missed = own[~found]
            if n > 1 and len(missed):
                ctx, known = self._find(n - 1, grams[n - 2][missed - 1])
                total[missed[known]] += self.backoff[n - 2][ctx[known]]
            elif n == 1:
                total[missed] += self.unseen
            rest = np.sort(np.concatenate([missed, short])) if len(short) else missed
        starts = np.cumsum([0, *(lengths[:-1] + 1)])
        return -np.add.reduceat(total, starts, axis=0, dtype=np.float64) / lengths[:, None]

    def _find(self, n: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.hashes[n - 1]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted


def build_model(counts: pd.DataFrame, languages: list[str], order: int) -> Model:
    """Interpolated Kneser-Ney model from (lang, gram, n) counts of the highest order."""
    points = np.stack([np.frombuffer(g.encode("utf-32-le", "surrogatepass"), np.uint32) for g in counts["gram"]])
    lang = np.array([languages.index(x) for x in counts["lang"]])
    weight, n_langs = counts["n"].to_numpy(np.float64), len(languages)
    seen: list[tuple] = []  # from the highest order: hashes of n-gram, context and suffix; language; count
    for n in range(order, 0, -1):
        grams = gram_hashes(points.reshape(-1), n)
        last = np.arange(len(points)) * n + n - 1
        key = grams[n - 1][last]
        ctx, suffix = (grams[n - 2][last - 1], grams[n - 2][last]) if n > 1 else (np.zeros_like(key), np.zeros_like(key))
        seen.insert(0, (key, ctx, suffix, lang, weight))
        if n > 1:  # below the highest order an n-gram counts the different characters before it
            found = pd.DataFrame({"key": suffix, "lang": lang, "row": np.arange(len(last))}).groupby(["key", "lang"])["row"].agg(["first", "size"]).reset_index()
            points, lang, weight = points[found["first"].to_numpy(), 1:], found["lang"].to_numpy(), found["size"].to_numpy(np.float64)
    alphabet = len(np.unique(seen[0][0])) + 1
    hashes, scores, backoff, unseen = [], [], [], None
    for key, ctx, suffix, lang, count in seen:
        # Discount of each language from its n-grams seen once and twice.
        ones, twos = (np.bincount(lang[count == k], minlength=n_langs) for k in (1, 2))
        discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)
        keys, first, row = np.unique(key, return_index=True, return_inverse=True)
        contexts, ctx_row = np.unique(ctx, return_inverse=True)
        sums, kinds, cell = np.zeros((len(contexts), n_langs)), np.zeros((len(contexts), n_langs)), np.zeros((len(keys), n_langs))
        np.add.at(sums, (ctx_row, lang), count)
        np.add.at(kinds, (ctx_row, lang), 1)
        np.add.at(cell, (row, lang), (count - discount[lang]) / sums[ctx_row, lang])
        rest = np.where(sums > 0, discount * kinds / np.maximum(sums, 1), 1.0)
        if unseen is None:
            below, unseen = 1.0 / alphabet, np.log(rest[0] / alphabet)
        else:
            below = np.exp(scores[-1][np.searchsorted(hashes[-1], suffix[first])])
            weights = np.zeros((len(hashes[-1]), n_langs), np.float32)
            at = np.minimum(np.searchsorted(hashes[-1], contexts), len(hashes[-1]) - 1)
            known = hashes[-1][at] == contexts
            weights[at[known]] = np.log(rest[known])
            backoff.append(weights)
        hashes.append(keys)
        scores.append(np.log(cell + rest[ctx_row[first]] * below))
    return Model(languages, hashes, [x.astype(np.float32) for x in scores], backoff, unseen.astype(np.float32), np.full(n_langs, np.inf))


def count_grams(sample: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) over (lang, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                points = np.concatenate([np.full(order - 1, 32, np.uint32), characters(text)])
                if len(points) > order:
                    grams = gram_hashes(points, order)[-1][order - 1:]
                    _, first, n = np.unique(grams, return_index=True, return_counts=True)
                    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(points, order)[first])
                    text_of = [w.tobytes().decode("utf-32-le", "surrogatepass") for w in windows]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(text_of), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return small_batches(sample.select("lang", "text")).mapInArrow(rows, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, learned: str = "true", *, order: int = ORDER, train_docs: int = TRAIN_DOCS,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Model of the languages that label documents where the SQL condition ``learned`` holds; None without any."""
    labelled = docs.where(F.expr(learned)).where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & F.col(id_col).isNotNull()) \
        .select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    # The least hashes of each language: Spark keeps the first train_docs of each task before it shuffles ids.
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = labelled.select("id", "lang").withColumn("rank", rank).where(F.col("rank") <= train_docs)
    sample = labelled.join(F.broadcast(chosen.groupBy("id", "lang").agg(F.min("rank").alias("rank"))), ["id", "lang"]).persist()
    try:
        counts = count_grams(sample.where((F.col("rank") % 5 != 0) | (F.col("rank") < 5)), order).toPandas()
        if counts.empty:
            return None
        model = build_model(counts.sort_values(["lang", "gram"]), sorted(counts["lang"].unique()), order)
        own = score(sample.where(F.col("rank") % 5 == 0).withColumnRenamed("id", id_col), model, text_col="text", id_col=id_col, keep=["lang"])
        worst = {r["lang"]: r["worst"] for r in own.where("lang_pred = lang").groupBy("lang").agg(F.max("entropy").alias("worst")).collect()}
        most = -model.unseen.astype(np.float64)
        model.limits = (np.array([worst.get(x, m) for x, m in zip(model.languages, most)]) + most) / 2
        return model
    finally:
        sample.unpersist()


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(id, kept columns, lang_pred, score, entropy, rejected) of every row.

    The score is the share of the chosen language in the likelihoods per character, sharpened to twenty
    characters at most, so it is comparable between texts of any length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(dict.fromkeys([id_col, *keep]))
    inner = [f"c{i}" for i in range(len(columns))]  # own names, so that no column of the table can clash
    text = inner[columns.index(text_col)] if text_col in columns else "text"  # a text that is kept is sent once
    names = ["lang_pred", "score", "entropy", "rejected"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, text, 1 << 18):
            texts = [characters(t or "") for t in batch.column(text).to_pylist()]
            some = [i for i, t in enumerate(texts) if len(t)] if known else []
            pred, sure, entropy, bad = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
            if some:
                bits = known.entropies([texts[i] for i in some])
                best = bits.argmin(1)
                least = bits[np.arange(len(some)), best]
                power = np.minimum(20, [len(texts[i]) - 1 for i in some])
                entropy[some], bad[some] = least, least > known.limits[best]
                sure[some] = 1 / np.exp(-(bits - least[:, None]) * power[:, None]).sum(1)
                for i, b in zip(some, best):
                    pred[i] = known.languages[b]
            found = [pa.array(pred), pa.array(sure), pa.array(entropy, from_pandas=True), pa.array(bad)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in inner] + found, inner + names)

    fields = [f"{i} {docs.schema[c].dataType.simpleString()}" for i, c in zip(inner, columns)]
    sent = dict(zip(inner, columns)) | {text: text_col}
    chosen = docs.select(*[F.col(c).alias(i) for i, c in sent.items()])
    found = small_batches(chosen).mapInArrow(rows, ", ".join([*fields, "lang_pred string, score double, entropy double, rejected boolean"]))
    return found.toDF(*columns, *names)


def accepted(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns."""
    found = score(docs, model, id_col=id_col, text_col=text_col, keep=docs.columns)
    first = list(dict.fromkeys([id_col, *docs.columns]))
    inner = found.toDF(*[f"c{i}" for i in range(len(first))], "lang_pred", "score", "entropy", "rejected")
    return inner.where("NOT rejected").select(*[F.col(f"c{first.index(c)}").alias(c) for c in docs.columns])
