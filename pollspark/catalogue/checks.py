"""Scoring of trends: coverage, residuals, calibration, PIT, log scores, chain health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pollspark.catalogue.base import (
    CTE_DRAWS, CTE_PERIOD, CUTOFF_T, draws, period_votes, query, r6, size_of, table,
)
from pollspark.functions import numeric as N
from pollspark.operators import joins, quantiles, rows
from pollspark.plans import checks as C

_Q4, _Q4N = [0.05, 0.25, 0.5, 0.75, 0.95], ["q05", "q25", "median", "q75", "q95"]
_SQL_Q4 = ", ".join(f"quantile_cont(value, {p}) AS {n}" for p, n in zip(_Q4, _Q4N))
_SQL_BIN = """CASE WHEN h <= 0 THEN 'fit' WHEN h <= 4 THEN '1-4w' WHEN h <= 12 THEN '5-12w'
 WHEN h <= 26 THEN '13-26w' ELSE '>26w' END"""


def _cell_quantiles(spark: SparkSession, sf: str, d: DataFrame, **extra: Column) -> DataFrame:
    return quantiles.exact_quantiles(
        d, ["t", "party"], "value", _Q4, _Q4N, size_of(spark, sf, "lineitem"), extra=extra)


@query(f"""WITH {CTE_DRAWS}, q AS (SELECT t, party, {_SQL_Q4} FROM draws GROUP BY 1, 2),
a AS (SELECT t - 1 AS t, party, avg(value) AS actual FROM draws GROUP BY 1, 2),
c AS (SELECT party, CAST(actual BETWEEN q05 AND q95 AS INTEGER) AS c90,
 CAST(actual BETWEEN q25 AND q75 AS INTEGER) AS c50, abs(actual - median) AS e
 FROM q JOIN a USING (t, party))
SELECT coalesce(party, 'all') AS party, round(avg(c90), 6) AS coverage_90,
round(avg(c50), 6) AS coverage_50, round(avg(e), 6) AS mae, count(*) AS n FROM c GROUP BY ROLLUP (party)""")
def coverage_mae(spark: SparkSession, sf: str) -> DataFrame:
    """Interval coverage and mean error against the next period, by party and overall at once."""
    by_party = Window.partitionBy("party").orderBy("t")  # calendar-sized cells
    cell = _cell_quantiles(spark, sf, draws(spark, sf), mean=F.avg("value")).withColumn(
        "actual", F.when(F.lead("t").over(by_party) == F.col("t") + 1,
                         F.lead("mean").over(by_party)))
    c = cell.where(F.col("actual").isNotNull()).select(
        "party", F.col("actual").between(F.col("q05"), F.col("q95")).cast("int").alias("c90"),
        F.col("actual").between(F.col("q25"), F.col("q75")).cast("int").alias("c50"),
        F.abs(F.col("actual") - F.col("median")).alias("e"))
    return c.rollup("party").agg(
        r6(F.avg("c90")).alias("coverage_90"), r6(F.avg("c50")).alias("coverage_50"),
        r6(F.avg("e")).alias("mae"), F.count(F.lit(1)).alias("n")).withColumn(
        "party", F.coalesce("party", F.lit("all")))


@query(f"""WITH {CTE_DRAWS}, q AS (SELECT t, party, avg(value) - quantile_cont(value, 0.5) AS r
FROM draws GROUP BY 1, 2) SELECT party, round(avg(r), 6) AS mean_residual,
round(stddev_samp(r), 6) AS sd_residual, round(sqrt(avg(r * r)), 6) AS rmse FROM q GROUP BY 1""")
def residual_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Observed mean less fitted median, summarised per party."""
    cell = quantiles.exact_quantiles(
        draws(spark, sf), ["t", "party"], "value", [0.5], ["median"],
        size_of(spark, sf, "lineitem"), extra={"observed": F.avg("value")})
    r = cell.withColumn("r", F.col("observed") - F.col("median"))
    return r.groupBy("party").agg(
        r6(F.avg("r")).alias("mean_residual"), r6(F.stddev_samp("r")).alias("sd_residual"),
        r6(F.sqrt(F.avg(F.col("r") * F.col("r")))).alias("rmse"))


@query(f"""WITH {CTE_DRAWS}, q AS (SELECT t, party, {_SQL_Q4} FROM draws WHERE l_returnflag <> 'R' GROUP BY 1, 2),
o AS (SELECT t, party, avg(value) AS observed FROM draws WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT party, round(avg(CAST(observed BETWEEN q05 AND q95 AS INTEGER)), 6) AS coverage_90, count(*) AS n
FROM q JOIN o USING (t, party) GROUP BY 1""")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Share of observations inside the simulated 90 % interval, in two levels."""
    d = draws(spark, sf, "l_returnflag")
    is_obs = F.col("l_returnflag") == "R"
    d = d.select("t", "party", F.when(~is_obs, F.col("value")).alias("value"),
                 F.when(is_obs, F.col("value")).alias("seen"))
    sim = _cell_quantiles(spark, sf, d, observed=F.avg("seen")).where(
        (F.col("n") > 0) & F.col("observed").isNotNull())
    inside = F.col("observed").between(F.col("q05"), F.col("q95")).cast("int")
    return sim.groupBy("party").agg(
        r6(F.avg(inside)).alias("coverage_90"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CTE_DRAWS}, o AS (SELECT t, party, quantile_cont(value, 0.5) AS obs FROM draws
WHERE l_returnflag = 'R' GROUP BY 1, 2),
p AS (SELECT t, party, avg(CAST(value >= obs AS INTEGER)) AS pit FROM draws JOIN o USING (t, party)
 WHERE l_returnflag <> 'R' GROUP BY 1, 2), b AS (SELECT *, t - {CUTOFF_T} AS h FROM p)
SELECT {_SQL_BIN} AS horizon_bin, party, round(avg(CAST(pit BETWEEN 0.25 AND 0.75 AS INTEGER)), 6) AS coverage_50,
round(avg(CAST(pit BETWEEN 0.05 AND 0.95 AS INTEGER)), 6) AS coverage_90, round(avg(pit) - 0.5, 6) AS bias,
count(*) AS n_obs FROM b GROUP BY 1, 2""")
def pit_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """PIT per observation (ties count), then coverage and bias by horizon and party."""
    n, at = size_of(spark, sf, "lineitem"), ["t", "party"]
    d = draws(spark, sf, "l_returnflag", "l_orderkey", "l_linenumber")
    obs = quantiles.exact_quantiles(d.where("l_returnflag = 'R'"), at, "value", [0.5], ["obs"],
                                    n).drop("n")
    sim = joins.salted_lookup(d.where("l_returnflag <> 'R'"), obs, at,
                              ["l_orderkey", "l_linenumber"], n)
    pit = sim.groupBy(*at).agg(
        F.avg((F.col("value") >= F.col("obs")).cast("int")).alias("pit"))
    return pit.groupBy(N.horizon_bin(F.col("t") - CUTOFF_T).alias("horizon_bin"), "party").agg(
        r6(F.avg(F.col("pit").between(0.25, 0.75).cast("int"))).alias("coverage_50"),
        r6(F.avg(F.col("pit").between(0.05, 0.95).cast("int"))).alias("coverage_90"),
        r6(F.avg("pit") - 0.5).alias("bias"), F.count(F.lit(1)).alias("n_obs"))


@query(f"""WITH {CTE_DRAWS}, c AS (SELECT t, party, l_linenumber AS rep, sum(l_quantity) AS y FROM draws GROUP BY 1, 2, 3),
r AS (SELECT t, party, rep, y / sum(y) OVER (PARTITION BY t, rep) AS s FROM c),
o AS (SELECT t, party, sum(y) / sum(sum(y)) OVER (PARTITION BY t) AS obs FROM c GROUP BY 1, 2)
SELECT party, t > {CUTOFF_T} AS held_out, round(avg(CAST(s > obs AS INTEGER)), 6) AS p_value, count(*) AS n
FROM r JOIN o USING (t, party) GROUP BY 1, 2""")
def ppc_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    """P(replicate > observed) per party, fit against hold-out; shares come from counted cells."""
    c = draws(spark, sf, "l_linenumber", "l_quantity").groupBy(
        "t", "party", F.col("l_linenumber").alias("rep")).agg(F.sum("l_quantity").alias("y"))
    by_rep, by_t = Window.partitionBy("t", "rep"), Window.partitionBy("t")
    rep = c.select("t", "party", (F.col("y") / F.sum("y").over(by_rep)).alias("s"))
    obs = c.groupBy("t", "party").agg(F.sum("y").alias("y")).select(
        "t", "party", (F.col("y") / F.sum("y").over(by_t)).alias("obs"))
    return rep.join(obs, ["t", "party"]).groupBy(
        "party", (F.col("t") > CUTOFF_T).alias("held_out")).agg(
        r6(F.avg((F.col("s") > F.col("obs")).cast("int"))).alias("p_value"),
        F.count(F.lit(1)).alias("n"))


_SQL_PRED = f"""{CTE_PERIOD}, f AS (SELECT party, sum(y) AS fy FROM period WHERE t <= {CUTOFF_T} GROUP BY 1),
pred AS (SELECT party, fy / (SELECT sum(fy) FROM f) AS p FROM f),
x AS (SELECT t, t - {CUTOFF_T} AS h, party, y, p, sum(y) OVER (PARTITION BY t) AS n FROM period JOIN pred USING (party))"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per period with the shares predicted from the fit window."""
    fit = F.when(F.col("t") <= CUTOFF_T, F.col("y"))
    party, whole = Window.partitionBy("party"), Window.partitionBy()  # calendar-sized cells
    return period_votes(spark, sf).withColumns({
        "p": F.sum(fit).over(party) / F.sum(fit).over(whole),
        "n": F.sum("y").over(Window.partitionBy("t"))})


@query(f"""WITH {_SQL_PRED}, s AS (SELECT t, h, lgamma(max(n) + 1) - sum(lgamma(y + 1)) + sum(y * ln(p)) AS multi,
 lgamma(max(n) + 1) + lgamma(sum(100 * p)) - lgamma(max(n) + sum(100 * p))
  + sum(lgamma(y + 100 * p) - lgamma(100 * p) - lgamma(y + 1)) AS dirmulti,
 sum(y * ln(n * p) - n * p - lgamma(y + 1)) AS pois FROM x GROUP BY 1, 2)
SELECT {_SQL_BIN} AS horizon_bin, count(*) AS n_obs, round(sum(multi), 3) AS elpd,
round(sum(multi) / count(*), 4) AS elpd_per_obs, round(sum(dirmulti), 3) AS dirichlet_elpd,
round(sum(pois), 3) AS poisson_elpd FROM s GROUP BY 1""")
def score_by_horizon(spark: SparkSession, sf: str) -> DataFrame:
    """Summed log scores by horizon: multinomial, Dirichlet-multinomial, Poisson."""
    y, p, n = F.col("y"), F.col("p"), F.col("n")
    s = _scored(spark, sf).groupBy("t").agg(
        N.multinomial_log_score(y, p, n).alias("multi"),
        N.dirichlet_multinomial_log_score(y, p * 100).alias("dirmulti"),
        F.sum(N.poisson_log_score(y, n * p)).alias("pois"))
    return s.groupBy(N.horizon_bin(F.col("t") - CUTOFF_T).alias("horizon_bin")).agg(
        F.count(F.lit(1)).alias("n_obs"), F.round(F.sum("multi"), 3).alias("elpd"),
        F.round(F.sum("multi") / F.count(F.lit(1)), 4).alias("elpd_per_obs"),
        F.round(F.sum("dirmulti"), 3).alias("dirichlet_elpd"),
        F.round(F.sum("pois"), 3).alias("poisson_elpd"))


@query(f"""WITH {_SQL_PRED} SELECT party, t <= {CUTOFF_T} AS is_fit, round(avg(power(y / n - p, 2)), 9) AS mse,
count(*) AS n FROM x GROUP BY 1, 2""")
def mse_fit_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """Mean squared error of the predicted shares per party, fit against hold-out."""
    return C.mse_by_fit(_scored(spark, sf), CUTOFF_T).withColumn("mse", F.round("mse", 9))


@query(f"""WITH {CTE_DRAWS}, c AS (SELECT party, l_linenumber AS chain, count(*) AS n, avg(value) AS m,
 var_samp(value) AS v FROM draws GROUP BY 1, 2),
w AS (SELECT party, count(*) AS n_chains, avg(n) AS n, avg(v) AS w, var_samp(m) AS b FROM c GROUP BY 1)
SELECT party, n_chains, round(sqrt(((n - 1) / n * w + b) / w), 6) AS rhat FROM w""")
def chain_rhat(spark: SparkSession, sf: str) -> DataFrame:
    """Between- against within-chain variance per variable, in two aggregates."""
    c = draws(spark, sf, "l_linenumber").groupBy("party", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    w = c.groupBy("party").agg(F.count(F.lit(1)).alias("n_chains"), F.avg("n").alias("n"),
                               F.avg("v").alias("w"), F.var_samp("m").alias("b"))
    n = F.col("n")
    return w.select("party", "n_chains", r6(F.sqrt(
        ((n - 1) / n * F.col("w") + F.col("b")) / F.col("w"))).alias("rhat"))


@query(f"""WITH {CTE_DRAWS}, i AS (SELECT l_linenumber AS chain, t, max(abs(value)) AS mx, avg(abs(value)) AS av,
 min(abs(value)) AS mn, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS divergent FROM draws GROUP BY 1, 2)
SELECT chain AS model, count(*) AS n_iter, CAST(sum(divergent) AS BIGINT) AS n_divergent,
count(CASE WHEN mx / mn > 50 THEN 1 END) AS n_extreme, round(min(mn), 6) AS min_value,
round(max(mx), 6) AS max_value, round(avg(av), 6) AS mean_value FROM i GROUP BY 1""")
def chain_health(spark: SparkSession, sf: str) -> DataFrame:
    """Extremes and flags per (chain, iteration), then totals per chain."""
    a = F.abs("value")
    i = draws(spark, sf, "l_linenumber", "l_returnflag").groupBy("l_linenumber", "t").agg(
        F.max(a).alias("mx"), F.avg(a).alias("av"), F.min(a).alias("mn"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("divergent"))
    return i.groupBy(F.col("l_linenumber").alias("model")).agg(
        F.count(F.lit(1)).alias("n_iter"), F.sum("divergent").alias("n_divergent"),
        F.count_if(F.col("mx") / F.col("mn") > 50).alias("n_extreme"),
        r6(F.min("mn")).alias("min_value"), r6(F.max("mx")).alias("max_value"),
        r6(F.avg("av")).alias("mean_value"))


@query("""WITH p AS (SELECT event_type AS name, sum(value) AS total_time, avg(value) AS mean_time,
count(*) AS calls FROM events GROUP BY 1)
SELECT name, round(total_time, 3) AS total_time, round(mean_time, 6) AS mean_time, calls,
round(total_time / (SELECT sum(total_time) FROM p) * 100, 6) AS pct_total,
round(total_time / calls * 1e6, 2) AS time_per_call_us FROM p""")
def profile_share(spark: SparkSession, sf: str) -> DataFrame:
    """Timing profile by name with its percent of the total."""
    p = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(
        F.sum("value").alias("total_time"), F.avg("value").alias("mean_time"),
        F.count(F.lit(1)).alias("calls"))
    return rows.share_of_total(p, ["total_time"]).select(
        "name", F.round("total_time", 3).alias("total_time"), r6(F.col("mean_time")).alias("mean_time"),
        "calls", r6(F.col("pct_total_time")).alias("pct_total"),
        F.round(F.col("total_time") / F.col("calls") * 1e6, 2).alias("time_per_call_us"))
