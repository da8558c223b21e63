"""Retrodictive checks, diagnostics by horizon, profiles and model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pollspark.functions.numeric import horizon_bin
from pollspark.operators import quantiles, reshape, rows

_LEVELS, _NAMES = [0.05, 0.25, 0.5, 0.75, 0.95], ["q05", "q25", "median", "q75", "q95"]


def election_recovery(draws: DataFrame, elections: DataFrame, n_rows: int) -> DataFrame:
    """Per (election, party) the quantiles of the draws at its period against the result.

    ``draws`` has (t, party, value), ``elections`` (election_date, t, party, actual); draws of
    other periods are filtered out before anything is ranked.
    """
    at = draws.join(elections.select("t", "party").distinct(), ["t", "party"], "left_semi")
    q = quantiles.exact_quantiles(at, ["t", "party"], "value", _LEVELS, _NAMES, n_rows)
    a = F.col("actual")
    return elections.join(q.drop("n"), ["t", "party"]).withColumns({
        "covered_90": a.between(F.col("q05"), F.col("q95")),
        "covered_50": a.between(F.col("q25"), F.col("q75")),
        "abs_error": F.abs(a - F.col("median"))})


def coverage(recovery: DataFrame) -> DataFrame:
    """Coverage and mean error by party, and overall in the row with a null party."""
    return recovery.rollup("party").agg(
        F.avg(F.col("covered_90").cast("int")).alias("coverage_90"),
        F.avg(F.col("covered_50").cast("int")).alias("coverage_50"),
        F.avg("abs_error").alias("mae"))


def residuals(observed: DataFrame, draws: DataFrame, n_rows: int) -> DataFrame:
    """Observed share less fitted median per (t, party); ``observed`` has (t, party, share)."""
    at = draws.join(observed.select("t").distinct(), "t", "left_semi")
    fit = quantiles.exact_quantiles(at, ["t", "party"], "value", [0.5], ["fitted"], n_rows)
    return observed.join(fit.drop("n"), ["t", "party"]).withColumn(
        "residual", F.col("share") - F.col("fitted"))


def residual_summary(res: DataFrame) -> DataFrame:
    r = F.col("residual")
    return res.groupBy("party").agg(
        F.avg(r).alias("mean_residual"), F.stddev_samp(r).alias("sd_residual"),
        F.sqrt(F.avg(r * r)).alias("rmse"))


def predictive_calibration(replicates: DataFrame, n_rows: int) -> DataFrame:
    """Share of observations inside the 5–95 % interval of their replicates, per party.

    ``replicates`` has (obs_idx, party, observed, simulated).
    """
    q = quantiles.exact_quantiles(replicates, ["obs_idx", "party"], "simulated", [0.05, 0.95],
                                  ["q05", "q95"], n_rows)
    obs = replicates.groupBy("obs_idx", "party").agg(F.first("observed").alias("observed"))
    inside = F.col("observed").between(F.col("q05"), F.col("q95")).cast("int")
    return q.join(obs, ["obs_idx", "party"]).groupBy("party").agg(
        F.avg(inside).alias("coverage_90"))


def retrodictive(draws: DataFrame, elections: DataFrame, observed: DataFrame,
                 replicates: DataFrame, n_draws: int, n_replicates: int) -> dict[str, DataFrame]:
    """The three checks of a fit: election recovery, residuals, predictive calibration."""
    recovery = election_recovery(draws, elections, n_draws)
    return {
        "by_election": recovery, "election_recovery": coverage(recovery),
        "residuals": residual_summary(residuals(observed, draws, n_draws)),
        "ppc": predictive_calibration(replicates, n_replicates)}


def by_horizon(log_lik: DataFrame, replicates: DataFrame, mse: DataFrame,
               edges: tuple[int, ...] = (4, 12, 26)) -> dict[str, DataFrame]:
    """Diagnostics by horizon: log scores, error per party, PIT coverage.

    ``replicates`` has (survey_idx, party, horizon, y_rep, y); ``mse`` the draws of the errors as
    (variable, i, j, value).
    """
    pits = pit(replicates, ["survey_idx", "party", "horizon"])
    return {"elpd": elpd_by_horizon(log_lik, edges), "mse": parameter_summary(mse),
            "coverage": pit_coverage(pits, "horizon", edges)}


def pit(replicates: DataFrame, keys: list[str]) -> DataFrame:
    """P(replicate >= observed) per observation; ties count."""
    return replicates.groupBy(*keys).agg(
        F.avg((F.col("y_rep") >= F.col("y")).cast("int")).alias("pit"))


def ppc_p_value(replicates: DataFrame, keys: list[str]) -> DataFrame:
    """P(replicate > observed); ties do not count; sentinel values below 0 are left out."""
    ok = replicates.where((F.col("y_rep") >= 0) & (F.col("y") >= 0))
    return ok.groupBy(*keys).agg(F.avg((F.col("y_rep") > F.col("y")).cast("int")).alias("p_value"))


def pit_coverage(pits: DataFrame, horizon: str = "horizon",
                 edges: tuple[int, ...] = (4, 12, 26)) -> DataFrame:
    """Coverage, bias and count of PIT values by horizon bin and party."""
    p = F.col("pit")
    return pits.groupBy(horizon_bin(F.col(horizon), edges).alias("horizon_bin"), "party").agg(
        F.avg(p.between(0.25, 0.75).cast("int")).alias("coverage_50"),
        F.avg(p.between(0.05, 0.95).cast("int")).alias("coverage_90"),
        (F.avg(p) - 0.5).alias("bias"), F.count(p).alias("n_obs"))


def elpd_by_horizon(log_lik: DataFrame, edges: tuple[int, ...] = (4, 12, 26)) -> DataFrame:
    """Mean log score per survey over its draws, then summed by horizon bin.

    ``log_lik`` has (survey_idx, horizon, value), one row per draw.
    """
    mean = log_lik.groupBy("survey_idx", "horizon").agg(F.avg("value").alias("m"))
    return mean.groupBy(horizon_bin(F.col("horizon"), edges).alias("horizon_bin")).agg(
        F.sum("m").alias("elpd_mean"), F.count(F.lit(1)).alias("n_obs"),
        (F.sum("m") / F.count(F.lit(1))).alias("elpd_per_obs"))


def parameter_summary(draws: DataFrame) -> DataFrame:
    """Mean and spread of every variable over its draws."""
    return draws.groupBy("variable", "i", "j").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def parameter_recovery(draws: DataFrame, truth: DataFrame) -> DataFrame:
    """True against estimated parameters; ``truth`` has (variable, i, j, true_value)."""
    est = parameter_summary(draws)
    same = (est.variable == truth.variable) & est.i.eqNullSafe(truth.i) & est.j.eqNullSafe(truth.j)
    return est.join(truth, same).select(est.variable, est.i, est.j, "true_value", "mean", "sd")


def rhat(draws: DataFrame) -> DataFrame:
    """Potential scale reduction per variable from two aggregates over (variable, chain)."""
    keys = ["variable", "i", "j"]
    per = draws.groupBy(*keys, "chain").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    w = per.groupBy(*keys).agg(F.avg("n").alias("n"), F.avg("v").alias("w"),
                               F.var_samp("m").alias("b"))
    n = F.col("n")
    return w.select(*keys, F.sqrt(((n - 1) / n * F.col("w") + F.col("b")) / F.col("w")).alias("rhat"))


def profile_summary(profile: DataFrame) -> DataFrame:
    """Timing by name over chains with percent of the total and time per call, slowest first."""
    times = ["total_time", "forward_time", "reverse_time"]
    agg = profile.groupBy("name").agg(
        *[F.sum(c).alias(c) for c in (*times, "autodiff_calls")],
        F.avg("total_time").alias("mean_total_time"))
    return rows.share_of_total(agg, times).withColumn(
        "time_per_call_us", F.col("total_time") / F.col("autodiff_calls") * 1e6
    ).orderBy(F.desc("total_time"))


def sampler_totals(diagnostics: DataFrame) -> DataFrame:
    """Divergences and depth hits over chains, one row."""
    return diagnostics.agg(F.sum("num_divergent").alias("n_divergent"),
                           F.sum("num_max_treedepth").alias("max_treedepth_hits"))


def mse_by_fit(obs: DataFrame, cutoff: int) -> DataFrame:
    """Squared error of predicted shares per party, fit window against hold-out.

    ``obs`` has (t, party, y, n, p).
    """
    err = F.col("y") / F.col("n") - F.col("p")
    return obs.groupBy("party", (F.col("t") <= cutoff).alias("is_fit")).agg(
        F.avg(err * err).alias("mse"), F.count(F.lit(1)).alias("n"))


def compare_models(runs: dict[str, DataFrame]) -> DataFrame:
    """One row per model from its per-chain diagnostics (seconds, n_divergent, depth_hits, ess, rhat)."""
    return reshape.tagged_union(runs, "model").groupBy("model").agg(
        F.sum("seconds").alias("seconds"), F.sum("n_divergent").alias("n_divergent"),
        F.sum("depth_hits").alias("depth_hits"), F.min("ess").alias("min_ess"),
        F.max("rhat").alias("max_rhat"))


def divergence_profile(draws: DataFrame) -> DataFrame:
    """Extremes of the parameters per (chain, iter) with the divergence flag of the iteration."""
    a = F.abs("value")
    return draws.groupBy("chain", "iter").agg(
        F.max(a).alias("max_abs"), F.avg(a).alias("mean_abs"), F.min(a).alias("min_abs"),
        F.try_divide(F.max(a), F.min(a)).alias("ratio"), F.max("divergent").alias("divergent"))


def change_probability(draws: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Share of draws per period whose jump exceeds the threshold."""
    return draws.groupBy("t").agg(
        F.avg((F.abs("delta") > threshold).cast("int")).alias("change_prob"))


def house_effects(cell: DataFrame, source: str, unit: str, value: str,
                  weight: str | None = None) -> DataFrame:
    """Mean deviation of each source from its units' means, centred to sum to zero, with overlap.

    ``cell`` has one row per (source, unit); windows see the sources of one unit, and at the end
    one row per source. ``weight`` weighs the cells in the mean of a unit.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    by_unit, whole = Window.partitionBy(unit), Window.partitionBy()
    x = cell.select(
        source, F.count(F.lit(1)).over(by_unit).alias("__sources"),
        (F.col(value) - F.sum(F.col(value) * w).over(by_unit) / F.sum(w).over(by_unit))
        .alias("__dev"))
    per = x.groupBy(source).agg(
        F.avg("__dev").alias("__h"), F.count(F.lit(1)).alias("n_units"),
        F.count_if(F.col("__sources") > 1).alias("n_shared_units"))
    return per.select(source, (F.col("__h") - F.avg("__h").over(whole)).alias("house_effect"),
                      "n_units", "n_shared_units")
