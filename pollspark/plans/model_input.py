"""Canonical polls to model input: viable polls, counts, calendar, patterns, elections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pollspark import dims
from pollspark.functions.dates import day_series, grid_index, month_floor
from pollspark.functions.numeric import row_sum
from pollspark.operators import joins, ordered, reshape, rows
from pollspark.schemas import PARTY_COLS

_LABEL = {col: label for col, label, _, _ in dims.PARTIES}


def usable_polls(long: DataFrame, start: str, end: str,
                 majors: list[str] | None = None) -> DataFrame:
    """Polls of the window (both ends included) that report every major party; minor ones as 0."""
    inside = long.where(F.col("publishing_date").between(start, end))
    ids = rows.viable_ids(inside, "uuid", "party", "vote_share", majors or dims.MAJOR_PARTIES)
    return inside.join(ids, "uuid", "left_semi").fillna(0.0, ["vote_share"])


def poll_counts(usable: DataFrame, parties: list[str], origin: str = dims.GRID_ORIGIN,
                days: int = dims.GRID_DAYS) -> DataFrame:
    """One row per poll with its period and integer counts; incomplete and empty polls go."""
    wide = reshape.to_wide(usable, ["uuid", "publishing_date", "survey_count"], "party",
                           "vote_share", parties)
    known = wide.where(F.col("survey_count") > 0)
    counts = known.select(
        "uuid", grid_index(F.col("publishing_date"), origin, days).alias("t"),
        *[F.floor(F.col(f"`{p}`") / 100 * F.col("survey_count")).cast("bigint").alias(p)
          for p in parties])
    quoted = [f"`{p}`" for p in parties]
    return counts.dropna(subset=parties).where(row_sum(quoted) > 0)


def period_counts(counts: DataFrame, parties: list[str]) -> DataFrame:
    """Counts summed per period, wide."""
    return counts.groupBy("t").agg(*[F.sum(f"`{p}`").alias(p) for p in parties])


def election_shares(results: DataFrame, start: str, end: str, parties: list[str],
                    last_t: Column | int, origin: str = dims.GRID_ORIGIN,
                    days: int = dims.GRID_DAYS, epsilon: float = 0.001) -> DataFrame:
    """Election shares per period and party, zeros lifted, rows scaled to 1, inside the grid."""
    named = results.where(F.col("election_date").between(start, end)).withColumnsRenamed(
        {c: _LABEL[c] for c in PARTY_COLS})
    lifted = named.select("election_year", "election_date", *[
        F.when(F.coalesce(F.col(f"`{p}`"), F.lit(0.0)) == 0, epsilon).otherwise(F.col(f"`{p}`"))
        .alias(p) for p in parties])
    total = row_sum([f"`{p}`" for p in parties])
    scaled = lifted.select(
        "election_year", "election_date",
        grid_index(F.col("election_date"), origin, days).alias("t"),
        *[(F.col(f"`{p}`") / total).alias(p) for p in parties])
    last = F.lit(last_t) if isinstance(last_t, int) else last_t
    return scaled.where((F.col("t") >= 1) & (F.col("t") <= last))


def knots(elections: DataFrame, last_t: int) -> list[int]:
    """Inner knots: distinct election periods strictly inside the grid (a few dozen values)."""
    inside = elections.where((F.col("t") > 1) & (F.col("t") < last_t)).select("t").distinct()
    return sorted(r.t for r in inside.collect())


def observed_periods(counts: DataFrame, elections: DataFrame) -> DataFrame:
    """Positions of poll and election periods in one sorted list."""
    both = counts.select("t").union(elections.select("t"))
    return joins.sorted_positions(both, "t", "obs_idx")


def calendar(spark: SparkSession, start: str, end: str, layer1: int = 14,
             layer2: int = 28) -> DataFrame:
    """Days with both month-restarting layers and their running indexes (calendar-sized)."""
    days = day_series(spark, start, end).select(
        "date", month_floor(F.col("date"), layer1).alias("layer1_aggregate"),
        month_floor(F.col("date"), layer2).alias("layer2_aggregate"))
    w = Window.orderBy("layer2_aggregate")
    periods = days.select("layer1_aggregate", "layer2_aggregate").distinct()
    periods = periods.withColumn("layer2_aggregate_idx", F.dense_rank().over(w)).withColumn(
        "layer1_aggregate_idx",
        F.row_number().over(Window.orderBy("layer1_aggregate", "layer2_aggregate")))
    return days.join(periods, ["layer1_aggregate", "layer2_aggregate"])


def source_index(df: DataFrame) -> DataFrame:
    return joins.sorted_positions(df.where(F.col("pollster").isNotNull()), "pollster",
                                  "pollster_idx")


def party_index(spark: SparkSession, parties: list[str]) -> DataFrame:
    return spark.createDataFrame(
        [(p, i + 1) for i, p in enumerate(parties)], "party string, party_idx int")


def transform_polls(long: DataFrame, start: str, end: str, parties: list[str],
                    layer1: int = 14) -> DataFrame:
    """Older input path: mean sample size over all rows first, then the open date window."""
    filled = rows.impute_mean(long, "survey_count")
    date = F.col("publishing_date")
    return filled.where(
        (date > start) & (date < end) & F.col("vote_share").isNotNull()
        & F.col("party").isin(parties)
    ).select("uuid", date.alias("date"), month_floor(date, layer1).alias("layer1_aggregate"),
             "survey_count", "party", "pollster", "vote_share")


def with_pattern(df: DataFrame, parties: list[str], must_report: str,
                 exclude: str | None = None) -> DataFrame:
    """Add every poll's reporting pattern and its index.

    Polls without ``must_report`` go, and so do those whose pattern equals ``exclude``.
    """
    order = {p: i + 1 for i, p in enumerate(parties)}
    pat = reshape.reporting_pattern(df.where("vote_share > 0"), "uuid", "party", order).where(
        F.col("pattern").contains(must_report)).select("uuid", "pattern")
    if exclude is not None:
        pat = pat.where(F.col("pattern") != exclude)
    idx = joins.sorted_positions(pat, "pattern", "pattern_idx")  # at most one row per subset
    return df.join(pat.join(idx, "pattern"), "uuid")


def survey_counts(df: DataFrame, parties: list[str], cal: DataFrame, rounding: DataFrame,
                  n_rows: int, days_cutoff: int = 120) -> DataFrame:
    """One numbered row per survey: counts per party (null where not reported), period, rounding.

    Surveys are numbered by (pattern, id) over the whole table, as a binned scan.
    """
    kept = joins.before_cutoff(df, "date", days_cutoff)
    y = F.floor(F.col("vote_share") / 100 * F.col("survey_count"))
    wide = reshape.to_wide(
        kept.withColumn("y", y.cast("bigint")),
        ["uuid", "date", "survey_count", "pollster", "pattern", "pattern_idx"], "party", "y", parties)
    numbered = ordered.number_rows(wide, [], ["pattern_idx", "uuid"], "survey_idx", n_rows)
    return numbered.join(cal, "date", "left").join(rounding, "pollster", "left")


def pattern_ranges(surveys: DataFrame) -> DataFrame:
    """First and last survey number per pattern."""
    return surveys.groupBy("pattern_idx").agg(
        F.min("survey_idx").alias("first"), F.max("survey_idx").alias("last"))


def presence(surveys: DataFrame, parties: list[str]) -> DataFrame:
    """Survey numbers per party as long rows; counts follow by ``groupBy("party")``."""
    long = surveys.unpivot(["survey_idx"], [F.col(f"`{p}`") for p in parties], "party", "y")
    return long.where("y > 0").select("party", "survey_idx")
