"""Exact quantiles per group, linear between neighbours, for groups of any size.

Spark's ``percentile`` is exact but keeps the distinct values of a group in one task. It is used
while the largest group is small enough for that. Beyond, values are cut into bins at literal points
and counted per (group, bin); only rows of bins that hold a wanted rank are counted per value and
ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollspark.operators.joins import salted_lookup, same_keys
from pollspark.operators.ordered import ROWS_PER_BIN, bin_of, cut_points
from pollspark.session import checkpointed

ONE_TASK_ROWS = 1_000_000
# Narrow bins: the fewer rows a bin holds, the fewer are ranked.
ROWS_PER_VALUE_BIN = 500_000
# Rows of a lookup that may be broadcast, counted first; about 20 MB.
BROADCAST_ROWS = 200_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                    names: list[str], n_rows: int, one_task_rows: int = ONE_TASK_ROWS,
                    rows_per_bin: int = ROWS_PER_VALUE_BIN,
                    extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per group with ``n`` and the named quantiles; nulls are ignored.

    ``n_rows`` is an upper bound of the rows of ``df`` (the count of its table). Only where it
    exceeds one task is the largest group estimated. ``extra`` holds further aggregates by name,
    taken in the same pass where possible.
    """
    extra = extra or {}
    more = [c.alias(n) for n, c in extra.items()]
    small = n_rows <= one_task_rows or (
        one_task_rows > 0 and _largest_group(df, keys, value, one_task_rows) <= one_task_rows)
    if small:
        levels = F.array(*[F.lit(float(p)) for p in probs])
        out = df.groupBy(*keys).agg(
            F.count(value).alias("n"), F.percentile(value, levels).alias("__q"), *more)
        return out.select(*keys, "n", *[
            F.get("__q", F.lit(i)).alias(name) for i, name in enumerate(names)], *extra)
    ranked = _by_rank(df, keys, value, probs, names, n_rows, rows_per_bin)
    # Groups without a known value have no rank; the groups themselves come from all rows.
    aliases = [F.col(k).alias(f"__k_{k}") for k in keys]
    side = df.groupBy(*aliases).agg(*more) if extra else df.select(*aliases).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return side.join(ranked, same, "left").select(
        *[F.col(f"__k_{k}").alias(k) for k in keys], F.coalesce("n", F.lit(0)).alias("n"), *names, *extra)


def _largest_group(df: DataFrame, keys: list[str], value: str, one_task_rows: int) -> int:
    """Estimated size of the largest group, from the rows of every m-th value hash.

    What a task must hold are distinct values, so values are chosen, not rows; the filter on the
    value moves below joins to the scan. The estimate only picks between two exact ways.
    """
    every = max(1, one_task_rows // 1000)
    chosen = df if every == 1 else df.where(F.pmod(F.xxhash64(value), F.lit(every)) == 0)
    counts = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return (counts.agg(F.max("c")).first()[0] or 0) * every


def _by_rank(df: DataFrame, keys: list[str], value: str, probs: list[float], names: list[str],
             n_rows: int, rows_per_bin: int) -> DataFrame:
    cuts = cut_points(df, [value], n_rows, rows_per_bin)
    binned = df.where(F.col(value).isNotNull()).select(*keys, value).withColumn(
        "__bin", bin_of(df, [value], cuts))
    # Rows before each bin of a group: at most MAX_BINS rows per group.
    by_bin = Window.partitionBy(*keys).orderBy("__bin")
    bins = (
        binned.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__in"))
        .withColumn("__n", F.sum("__in").over(Window.partitionBy(*keys)))
        .withColumn("__before", F.sum("__in").over(by_bin) - F.col("__in"))
    )
    ranks = []
    for p in probs:
        at = (F.col("__n") - 1) * F.lit(float(p))
        ranks += [F.floor(at), F.ceil(at)]
    inside = lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__in"))
    # At most two rows per level and group, written once: both steps below read it.
    wanted = checkpointed(
        bins.withColumn("__ranks", F.filter(F.array_distinct(F.array(*ranks)), inside))
        .where(F.size("__ranks") > 0)
        .select(*[F.col(k).alias(f"__k_{k}") for k in keys],
                F.col("__bin").alias("__kbin"), "__n", "__before", "__ranks")
    )
    same = F.col("__bin") == F.col("__kbin")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    if wanted.count() <= BROADCAST_ROWS:
        # Only rows of wanted bins are shuffled; equal values combine on the map side.
        wanted = F.broadcast(wanted)
        binned = binned.join(wanted, same, "left_semi")
    counts = binned.groupBy(*keys, "__bin", value).agg(F.count(F.lit(1)).alias("__c"))
    in_bin = Window.partitionBy(*keys, "__bin").orderBy(value)
    upto = F.col("__before") + F.sum("__c").over(in_bin)
    hits = (
        counts.join(wanted, same)
        .withColumn("__upto", upto)
        .withColumn("__hit", F.filter("__ranks", lambda r: (
            r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__c"))))
        .where(F.size("__hit") > 0)
        .select(*keys, "__n", F.explode("__hit").alias("__r"), F.col(value).alias("__v"))
    )
    # At most two rows per level and group reach this aggregate.
    found = hits.groupBy(*keys).agg(
        F.first("__n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("__r", "__v"))).alias("__m"))

    def level(p: float):
        at = (F.col("n") - 1) * F.lit(float(p))
        low = F.element_at("__m", F.floor(at)).cast("double")
        high = F.element_at("__m", F.ceil(at)).cast("double")
        return low + (at - F.floor(at)) * (high - low)

    return found.select(*keys, "n", *[level(p).alias(n) for p, n in zip(probs, names)])


def median_and_mad(df: DataFrame, keys: list[str], value: str, salt_by: list[str], n_rows: int,
                   extra: dict[str, Column] | None = None, **limits: int) -> DataFrame:
    """Median and scaled median absolute deviation (1.4826 times the median distance).

    ``salt_by`` names columns that tell the rows of a group apart, to spread a large group.
    """
    med = exact_quantiles(df, keys, value, [0.5], ["median"], n_rows, extra=extra, **limits)
    if n_rows > limits.get("one_task_rows", ONE_TASK_ROWS):
        med = checkpointed(med)  # one row per group, read three times
    dist = salted_lookup(
        df, med.select(*keys, "median"), keys, salt_by, n_rows,
        limits.get("rows_per_bin", ROWS_PER_BIN), nulls_meet=True,
    ).withColumn("__d", F.abs(F.col(value) - F.col("median")))
    mad = exact_quantiles(dist, keys, "__d", [0.5], ["__mad"], n_rows, **limits)
    return same_keys(med, mad.select(*keys, "__mad"), keys).select(
        *keys, "n", "median", (F.col("__mad") * 1.4826).alias("mad"), *(extra or {}))
