"""Operators over short ordered series: one row per period and key, so windows are calendar-sized."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollspark.functions import numeric as N


def _by(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def differences(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Add first and second differences (``d1``, ``d2``) and the step of the order (``gap``)."""
    w, x = _by(keys, order), F.col(value)
    return df.withColumns({
        "d1": x - F.lag(value).over(w),
        "d2": x - 2 * F.lag(value).over(w) + F.lag(value, 2).over(w),
        "gap": F.col(order) - F.lag(order).over(w)})


def roughness(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Mean and largest second difference, number of rises and of missing steps per series."""
    return differences(df, keys, order, value).groupBy(*keys).agg(
        F.avg(F.abs("d2")).alias("roughness"), F.max("d2").alias("max_d2"),
        F.count_if(F.col("d1") > 0).alias("rises"), F.count_if(F.col("gap") > 1).alias("gaps"))


def path(df: DataFrame, keys: list[str], order: str, innovation: str, name: str) -> DataFrame:
    """Running sum of innovations along a series."""
    return df.withColumn(name, F.sum(innovation).over(
        _by(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def weighted_trailing(df: DataFrame, keys: list[str], order: str, value: str,
                      weights: list[float], name: str) -> DataFrame:
    """Weighted sum of the values before each row, the nearest one first; fewer at the start.

    Weights belong to positions: a missing value adds nothing and moves no other weight.
    """
    w = _by(keys, order)
    terms = [F.coalesce(F.lag(value, i + 1).over(w) * F.lit(weight), F.lit(0.0)) for i, weight in enumerate(weights)]
    return df.withColumn(name, reduce(lambda a, b: a + b, terms))


def trailing_fit(df: DataFrame, keys: list[str], order: str, value: str, n: int) -> DataFrame:
    """Add the mean of the ``n`` values before (``fit``) and the step to the value before (``d``)."""
    w = _by(keys, order)
    return df.withColumns({
        "fit": F.avg(value).over(w.rowsBetween(-n, -1)),
        "d": F.col(value) - F.lag(value).over(w)})


def fit_quality(df: DataFrame, keys: list[str], truth: str, fit: str,
                extra: dict[str, Column] | None = None) -> DataFrame:
    """R², largest error and correlation of a fit against the truth, per series.

    ``extra`` holds further aggregates by name over the same rows.
    """
    both = df.where(F.col(truth).isNotNull() & F.col(fit).isNotNull()).withColumn(
        "__mean", F.avg(truth).over(Window.partitionBy(*keys)))
    err, dev = F.col(truth) - F.col(fit), F.col(truth) - F.col("__mean")
    return both.groupBy(*keys).agg(
        (1 - F.sum(err * err) / F.sum(dev * dev)).alias("r2"),
        F.max(F.abs(err)).alias("max_abs_error"), F.corr(truth, fit).alias("r"),
        *[c.alias(n) for n, c in (extra or {}).items()])


def softmax_rows(df: DataFrame, keys: list[str], value: str, name: str = "share") -> DataFrame:
    """Softmax over the rows of a key; a key holds one row per party."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return df.withColumn("__e", e).withColumn(
        name, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def long_short_shares(long_term: Column, total: Column) -> tuple[Column, Column]:
    """Array shares of the long-term part, and what the short term adds to reach the total."""
    lng, tot = N.softmax_array(long_term), N.softmax_array(total)
    return lng, F.zip_with(tot, lng, lambda a, b: a - b)


def share_error(trend: Column, error: Column) -> Column:
    """A polling error on the share scale: softmax(trend + error) - softmax(trend), as arrays."""
    moved = N.softmax_array(F.zip_with(trend, error, lambda x, e: x + e))
    return F.zip_with(moved, N.softmax_array(trend), lambda a, b: a - b)
