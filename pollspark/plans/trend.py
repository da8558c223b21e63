"""Draws to trends: quantiles per period and party, daily rows, spline paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollspark import dims
from pollspark.functions.dates import grid_start
from pollspark.functions.text import indexed_name
from pollspark.operators import quantiles
from pollspark.operators.series import softmax_rows
from pollspark.plans.model_input import party_index


def parse_names(draws: DataFrame) -> DataFrame:
    """Draws named ``pi[12,3]`` to (variable, i, j)."""
    base, i, j = indexed_name(F.col("variable"))
    return draws.withColumns({"i": i, "j": j, "variable": base})


def trend_table(draws: DataFrame, parties: list[str], n_rows: int,
                origin: str = dims.GRID_ORIGIN, days: int = dims.GRID_DAYS,
                levels: list[float] | None = None, names: list[str] | None = None) -> DataFrame:
    """Exact quantiles of the share draws per (t, party) with the date of the period."""
    q = quantiles.exact_quantiles(
        draws, ["i", "j"], "value", levels or dims.QUANTILE_LEVELS, names or dims.QUANTILE_KEYS,
        n_rows)
    idx = party_index(draws.sparkSession, parties)
    return q.join(idx, F.col("j") == F.col("party_idx")).select(
        F.col("i").alias("t"), "party", grid_start(F.col("i"), origin, days).alias("date"),
        *(names or dims.QUANTILE_KEYS))


def daily_shares(trend: DataFrame, cal: DataFrame, idx: str = "layer1_aggregate_idx") -> DataFrame:
    """Every calendar day with its period's summary; days without one keep nulls."""
    return trend.drop("date").join(cal.select("date", F.col(idx).alias("t")), "t", "right")


def spline_path(basis: DataFrame, beta: DataFrame) -> DataFrame:
    """alpha(draw, t, party) = sum over k of basis(t, k) * beta(draw, k, party).

    ``basis`` should hold only the periods that are needed, without zeros.
    """
    return basis.join(beta, "k").groupBy("draw", "t", "party").agg(
        F.sum(F.col("b") * F.col("beta")).alias("alpha"))


def path_shares(basis: DataFrame, beta: DataFrame) -> DataFrame:
    """Shares per draw, period and party from spline coefficients."""
    return softmax_rows(spline_path(basis, beta), ["draw", "t"], "alpha")
