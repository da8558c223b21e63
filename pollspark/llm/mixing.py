"""Sources mixed to target weights by Pareto order sampling.

A source whose target is f times its size takes floor(f) certain whole copies of each document. The rest
of its target is a sample of fixed size in words: every document gets the inclusion odds of the remaining
fraction (times its own ``tilt``, if given), documents are ranked by random odds divided by inclusion odds,
and are taken in that order while they fit. One closing document per source, the untaken one whose size is
nearest to the words still missing, is added if that brings the source nearer to its target.

The cut in a source's order is found by refining a histogram of the ranks: three aggregates of at most 4096
cells per source, combined before their shuffle, and a running sum over the few rows of the last cell. No
source is sorted or gathered, whatever share of the rows it holds. Random numbers are hashes of ids, so
reruns agree.

Results for unusual input: a null or empty text has size 0 and is never taken; a null source is a source of
its own, the last; repeated rows are mixed as separate rows; if all sizes are 0, all targets are 0; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pollspark.llm.common import rows_with, stored

WORD = r"[^\x20\x09-\x0D]+"
CELL_BITS = 12
LEVELS = 3


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source_key, source_size, target) from (source_key, source, size): weighted shares of ``share`` times all sizes.

    A target stops at ``most`` times the source's size and the excess is shared again by weight. The windows
    are over one row per source.
    """
    per = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    every = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    total = W.partitionBy(F.lit(0))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before, on = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    left = share * F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(on))
    # Sources below the water level are full; the level is that of the first source that is not.
    level = F.max(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))).over(total)
    return per.select("source_key", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).cast("double").alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, *, seed: int = 7,
        tilt: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, text_hash, size, source_size, target, copies, taken) for every row of ``docs``."""
    source = F.col(source_col).cast("string")
    read = docs.select(F.col(id_col).alias("id"), source.alias("source"),
                       F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)).alias("source_key"),
                       n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash"),
                       (F.lit(1.0) if tilt is None else tilt.cast("double")).alias("tilt"), F.monotonically_increasing_id().alias("row"))
    rows = stored(read, "mix-sizes")
    plan = targets(rows, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("certain", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size")) \
        .withColumn("part", ratio - F.col("certain"))
    plan = stored(plan, "mix-targets")  # one row per source

    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id").cast("string")), 11) + F.lit(0.5)) / float(1 << 53)
    order = F.try_divide(F.try_divide(u, 1 - u), F.col("part") / (1 - F.col("part")) * F.col("tilt"))
    bits = CELL_BITS * LEVELS
    cell = F.when(order.isNull() | (F.col("part") <= 0), F.lit((1 << bits) - 1)).otherwise(
        F.least(F.floor(order / (1 + order) * float(1 << bits)), F.lit((1 << bits) - 1)))
    ranked = rows.join(plan, "source_key").withColumn("cell", cell.cast("long"))

    # Refine the cell in which each source's running size passes the words it still needs. A source that needs
    # certain copies only has no cut, so its rows are neither counted by cell nor ordered.
    cut = plan.where("part > 0").select("source_key", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(1, LEVELS + 1):
        shift = CELL_BITS * (LEVELS - level)
        inside = ranked.select("source_key", "size", "cell").join(cut, "source_key") \
            .where(F.shiftright("cell", shift + CELL_BITS) == F.col("prefix"))
        cells = inside.groupBy("source_key", "rest", "below", F.shiftright("cell", shift).alias("at")).agg(F.sum("size").alias("words"))
        upto = F.col("below") + F.sum("words").over(W.partitionBy("source_key").orderBy("at"))
        crossing = cells.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
        first = F.min(F.struct("at", (F.col("upto") - F.col("words")).alias("before"))).alias("first")
        found = crossing.groupBy("source_key", "rest").agg(first)
        cut = stored(found.select("source_key", "rest", F.col("first.at").alias("prefix"), F.col("first.before").alias("below")), "mix-cut")
    # A source without a crossing takes every document once more.
    judged = ranked.join(cut.select("source_key", "prefix", "below"), "source_key", "left")
    keys = ["cell", "id", "size", "row"]
    in_cell = judged.where(F.col("cell") == F.col("prefix"))
    running = F.col("below") + F.sum("size").over(W.partitionBy("source_key").orderBy(*keys))
    fits = in_cell.withColumn("upto", running).where(F.col("upto") <= F.col("rest"))
    last = stored(fits.groupBy("source_key").agg(F.max("upto").alias("used"), F.max(F.struct(*keys)).alias("last")), "mix-last")
    judged = judged.join(last, "source_key", "left")
    taken = F.col("prefix").isNull() | (F.col("cell") < F.col("prefix")) | \
        ((F.col("cell") == F.col("prefix")) & F.coalesce(F.struct(*keys) <= F.col("last"), F.lit(False)))
    judged = judged.withColumn("sampled", (F.col("part") > 0) & (F.col("size") > 0) & taken)

    gap = F.when(F.col("prefix").isNull(), 0.0).otherwise(F.col("rest") - F.coalesce("used", "below"))
    spare = judged.where(~F.col("sampled") & (F.col("size") > 0) & (F.col("part") > 0) & (F.abs(gap - F.col("size")) < gap))
    nearest = F.min(F.struct(F.abs(gap - F.col("size")).alias("off"), "cell", "id", "size", "row")).alias("nearest")
    closing = spare.groupBy("source_key").agg(nearest).select("source_key", F.col("nearest.row").alias("closing"))
    done = judged.join(closing, "source_key", "left")
    extra = (F.col("sampled") | F.coalesce(F.col("row") == F.col("closing"), F.lit(False))).cast("long")
    copies = F.when(F.col("size") > 0, F.col("certain") + extra).otherwise(0).cast("long")
    return done.select(F.col("id").alias(id_col), "text_hash", "size", "source_size", "target", copies.alias("copies"),
                       (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, with its columns."""
    found = mix(docs, id_col=id_col, text_col=text_col, **options)
    times = found.groupBy(F.col(id_col).alias("id"), F.col("text_hash").alias("key")).agg(F.sum("copies").cast("int").alias("times")).where("times > 0")
    met = rows_with(docs, times, F.xxhash64(text_col), id_col)
    return met.select("doc", F.explode(F.sequence(F.lit(1), "times"))).select("doc.*")
