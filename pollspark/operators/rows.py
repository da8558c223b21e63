"""Row selection: first of equals, validation, viability, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pollspark import dims


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by ``order`` with missing values last, then by all columns.

    A minimum over structs combines on the map side, so a group of copies of any size sends one
    row per task; a row_number window would move them all to one.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    maps = [c for c in rest if isinstance(df.schema[c].dataType, T.MapType)]
    ranked = [f for c in order for f in (F.isnull(c).alias(f"__n_{c}"), F.col(c).alias(c))]
    rank = F.struct(*ranked, *[F.col(c) for c in rest if c not in maps])
    # Maps have no order; with maps around, the whole row is carried beside its rank.
    first = (F.min_by(F.struct(*order, *rest), rank) if maps else F.min(rank)).alias("__first")
    return df.groupBy(*keys).agg(first).select(
        *[F.col(c) if c in keys else F.col(f"__first.{c}").alias(c) for c in df.columns])


def latest_per_group(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """One row per group: the latest, of equals the one with the smallest ``tie``."""
    cols = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(
        F.max_by(F.struct(*cols), F.struct(F.col(time), -F.col(tie))).alias("__top"))
    return top.select(*keys, *[F.col(f"__top.{c}").alias(c) for c in cols])


def rejection_reason(share_sum: Column, n: Column, published: Column, start: Column,
                     end: Column, source: Column, as_of: Column,
                     sum_bounds: tuple[int, int] = dims.SHARE_SUM_BOUNDS,
                     n_bounds: tuple[int, int] = dims.SAMPLE_SIZE_BOUNDS) -> Column:
    """All failed checks of a poll, joined by ``"; "``; empty for a valid poll.

    A comparison with a missing value is no failure, except where a check asks for presence: a
    missing publication date fails both the date check and the null check.
    """
    lo, hi = sum_bounds
    n_lo, n_hi = n_bounds
    late = F.date_add(published, dims.MAX_DAYS_FIELD_END_AFTER_PUBLICATION)
    bad_dates = (
        published.isNull()
        | F.coalesce(published > as_of, F.lit(False))
        | F.coalesce(start > end, F.lit(False))
        | F.coalesce(end > late, F.lit(False))
    )
    return F.concat_ws(
        "; ",
        F.when((share_sum < lo) | (share_sum > hi),
               F.format_string(f"V1: vote_share_sum=%.1f outside [{lo},{hi}]", share_sum)),
        F.when((n < n_lo) | (n > n_hi),
               F.concat(F.lit("V2: n="), n.cast("string"), F.lit(f" outside [{n_lo},{n_hi}]"))),
        F.when(bad_dates, F.lit("V3: date validity check failed")),
        F.when(source.isNull() | published.isNull(),
               F.lit("V5: null in required field (pollster/date_published)")),
    )


def reason_counts(rejected: DataFrame, reason: str = "rejection_reason") -> DataFrame:
    """How often every check fired."""
    return (
        rejected.select(F.explode(F.split(reason, "; ")).alias("r"))
        .groupBy(F.substring("r", 1, 2).alias("check"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def not_in(label: Column, deny: list[str]) -> Column:
    """Deny-list that keeps rows with a missing label."""
    return F.coalesce(~label.isin(deny), F.lit(True))


def viable_ids(df: DataFrame, poll: str, party: str, share: str,
               required: list[str]) -> DataFrame:
    """Polls that report a positive share for every required party.

    Map-side flags per required party; rows need not be unique per party.
    """
    positive = F.coalesce(F.col(share) > 0, F.lit(False))
    seen = df.groupBy(poll).agg(*[
        F.max(F.coalesce((F.col(party) == p) & positive, F.lit(False))).alias(f"__{i}")
        for i, p in enumerate(required)])
    all_seen = F.lit(True)
    for i in range(len(required)):
        all_seen = all_seen & F.col(f"__{i}")
    return seen.where(all_seen).select(poll)


def pick(df: DataFrame, ids: list[str], n: int, seed: int) -> DataFrame:
    """A reproducible random choice of ``n`` rows: the smallest salted hashes (top-n, no sort)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))
    return df.withColumn("__h", h).orderBy("__h", *ids).limit(n).drop("__h")


def impute_mean(df: DataFrame, n: str) -> DataFrame:
    """Zero sample sizes become missing, missing ones the mean over all rows.

    The mean is a one-row aggregate joined back; a window over the whole table would use one task.
    """
    known = df.withColumn(n, F.nullif(F.col(n).cast("double"), F.lit(0.0)))
    mean = known.agg(F.avg(n).alias("__mean"))
    return known.crossJoin(mean).withColumn(n, F.coalesce(n, "__mean")).drop("__mean")


def share_of_total(df: DataFrame, values: list[str]) -> DataFrame:
    """Add ``pct_{value}``, the percent of the grand total, through a one-row aggregate."""
    totals = df.agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    return df.crossJoin(totals).withColumns({
        f"pct_{v}": F.col(v) / F.col(f"__t_{v}") * 100 for v in values
    }).drop(*[f"__t_{v}" for v in values])


def rounding_interval(df: DataFrame, source: str, value: str) -> DataFrame:
    """Rounding step per source: the smallest gap between its distinct decimal parts.

    Null where not every decimal part is a multiple of it; 1 where all values are whole; the
    decimal part itself where there is only one. Exact decimals of 6 places avoid float noise.
    """
    from pyspark.sql import Window

    x = F.col(value).cast("decimal(20,6)")
    # Distinct decimal parts: at most 1,000,000 per source, whatever the table holds.
    parts = df.where(F.col(value).isNotNull()).select(
        source, (x - F.floor(x)).cast("decimal(10,6)").alias("d")).distinct()
    w = Window.partitionBy(source).orderBy("d")
    gaps = parts.withColumn("gap", F.when(F.lag("d").over(w) > 0, F.col("d") - F.lag("d").over(w)))
    # Counts distinct parts at once with the gap; no second pass over the facts.
    step = gaps.groupBy(source).agg(
        F.count_if(F.col("d") > 0).alias("k"),
        F.max("d").alias("only"), F.min("gap").alias("gap"))
    step = step.select(source, F.when(F.col("k") == 0, F.lit(1).cast("decimal(10,6)"))
                       .when(F.col("k") == 1, F.col("only")).otherwise(F.col("gap")).alias("step"),
                       "k")
    ratio = F.col("d").cast("double") / F.col("step").cast("double")
    fits = F.bround(F.bround(ratio, 0) - ratio, 3) == 0
    return parts.join(step, source).groupBy(source).agg(
        F.when((F.first("k") <= 1) | F.every(fits), F.first("step").cast("double"))
        .alias("rounding"))
