"""Period series: paths, differences, trailing weights, entry and exit, fit quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pollspark.catalogue.base import (
    CTE_SHARE, PARTIES, cells, period, period_votes, query, r6, size_of, table,
)
from pollspark.functions import numeric as N
from pollspark.operators import ordered, series as S

THETA = [0.5, 0.3, 0.2]


def shares(spark: SparkSession, sf: str) -> DataFrame:
    """Share per period and party: calendar-sized."""
    w = Window.partitionBy("t")
    return period_votes(spark, sf).withColumn("s", F.col("y") / F.sum("y").over(w))


SQL_W = "OVER (PARTITION BY party ORDER BY t)"


_SQL_PATH = """SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
ROWS UNBOUNDED PRECEDING), 4) AS path FROM events"""


@query(_SQL_PATH)
def running_path(spark: SparkSession, sf: str) -> DataFrame:
    """Running sum of values per user; a hot user is cut into bins."""
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    out = ordered.running_sum(ev, ["user_id"], ["ts", "event_id"], F.col("value"), "path",
                              size_of(spark, sf, "events"))
    return out.select("user_id", "event_id", (F.round("path", 4) + F.lit(0.0)).alias("path"))


@query(_SQL_PATH)
def running_path_in_bins(spark: SparkSession, sf: str) -> DataFrame:
    """The same path the way it runs on a very large table: every user cut, 10,000 bins."""
    n = size_of(spark, sf, "events")
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    out = ordered.running_sum(ev, ["user_id"], ["ts", "event_id"], F.col("value"), "path", n, max(1, n // 10_000))
    return out.select("user_id", "event_id", (F.round("path", 4) + F.lit(0.0)).alias("path"))


_SQL_NEAREST = """WITH m AS (SELECT * FROM events WHERE event_type = 'purchase'),
n AS (SELECT e.event_id, m.event_id AS near_id, row_number() OVER (PARTITION BY e.event_id ORDER BY
 abs(date_diff('microsecond', m.ts, e.ts)), m.ts, CASE WHEN m.ts > e.ts OR (m.ts = e.ts AND
 m.event_id > e.event_id) THEN m.event_id ELSE -m.event_id END) AS rn
 FROM events e JOIN m USING (user_id) WHERE e.event_type <> 'purchase')
SELECT e.event_id, near_id FROM events e LEFT JOIN (SELECT * FROM n WHERE rn = 1) n USING (event_id)
WHERE event_type <> 'purchase'"""


@query(_SQL_NEAREST)
def nearest_event(spark: SparkSession, sf: str) -> DataFrame:
    """For every event the same user's purchase nearest in time, the earlier one of a tie."""
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    out = ordered.nearest_marker(ev, ["user_id"], "ts", "event_id",
                                 F.col("event_type") == "purchase", size_of(spark, sf, "events"))
    return out.select("event_id", "near_id")


@query(_SQL_NEAREST)
def nearest_event_in_bins(spark: SparkSession, sf: str) -> DataFrame:
    """The same lookup with users of more than a hundred events cut into bins."""
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    out = ordered.nearest_marker(ev, ["user_id"], "ts", "event_id", F.col("event_type") == "purchase", size_of(spark, sf, "events"), 20)
    return out.select("event_id", "near_id")


@query(f"""WITH {CTE_SHARE}, d AS (SELECT t, party, s - lag(s) {SQL_W} AS d1,
s - 2 * lag(s) {SQL_W} + lag(s, 2) {SQL_W} AS d2, t - lag(t) {SQL_W} AS gap FROM share)
SELECT party, round(avg(abs(d2)), 6) AS roughness, round(max(d2), 6) AS max_d2,
count(CASE WHEN d1 > 0 THEN 1 END) AS rises, count(CASE WHEN gap > 1 THEN 1 END) AS gaps
FROM d GROUP BY 1""")
def second_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Roughness of every share series, with rises and missing periods."""
    return S.roughness(shares(spark, sf), ["party"], "t", "s").withColumns({
        c: r6(F.col(c)) for c in ("roughness", "max_d2")})


@query(f"""WITH {CTE_SHARE} SELECT t, party, round(s, 6) AS share,
round(0.5 * coalesce(lag(s, 1) {SQL_W}, 0) + 0.3 * coalesce(lag(s, 2) {SQL_W}, 0)
 + 0.2 * coalesce(lag(s, 3) {SQL_W}, 0), 6) AS trailing FROM share""")
def weighted_trailing(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted sum of the values before each period, the nearest one first."""
    return S.weighted_trailing(shares(spark, sf), ["party"], "t", "s", THETA, "trailing").select(
        "t", "party", r6(F.col("s")).alias("share"), r6(F.col("trailing")).alias("trailing"))


@query(f"""WITH {CTE_SHARE}, w AS (SELECT t, party, s, CASE WHEN party = 'small'
 THEN (1 / (1 + exp(-0.1 * (t - 40)))) * (1 / (1 + exp(0.1 * (t - 130)))) ELSE 1.0 END AS w FROM share)
SELECT t, party, round(w, 6) AS weight, round(w * ln(s) + (1 - w) * -10, 6) AS log_odds,
round(0.6 * 0.2 + 0.4 * s, 6) AS mixed, CAST(0.12 AS DOUBLE) AS floor_share,
CAST(0.52 AS DOUBLE) AS ceiling_share FROM w""")
def entry_exit_weight(spark: SparkSession, sf: str) -> DataFrame:
    """Presence weight of a party that comes and goes, blended log shares, loyal base mix."""
    always = (F.col("party") != "small").cast("int")
    w = N.entry_exit_weight(F.col("t"), F.lit(40), F.lit(130), F.lit(0.1), always, always)
    base, floating = F.lit(0.2), F.lit(0.4)
    return shares(spark, sf).withColumn("w", w).select(
        "t", "party", r6(F.col("w")).alias("weight"),
        r6(N.blend(F.col("w"), F.log("s"), F.lit(-10.0))).alias("log_odds"),
        r6(N.floating_mix(base, floating, F.col("s"))).alias("mixed"),
        r6(N.floor_share(base, floating)).alias("floor_share"),
        r6(N.ceiling_share(base, floating)).alias("ceiling_share"))


@query(f"""WITH {CTE_SHARE}, f AS (SELECT t, party, s, avg(s) OVER (PARTITION BY party ORDER BY t
ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS f, s - lag(s) {SQL_W} AS d FROM share),
m AS (SELECT party, avg(s) AS mean_s FROM f WHERE f IS NOT NULL GROUP BY 1)
SELECT party, round(1 - sum((s - f) * (s - f)) / sum((s - mean_s) * (s - mean_s)), 6) AS r2,
round(max(abs(s - f)), 6) AS max_abs_error,
round(avg(CASE WHEN abs(d) > 0.01 THEN 1.0 ELSE 0.0 END), 6) AS change_prob,
round(corr(s, f), 6) AS r FROM f JOIN m USING (party) WHERE f IS NOT NULL GROUP BY 1""")
def fit_quality(spark: SparkSession, sf: str) -> DataFrame:
    """R², largest error, correlation and share of large moves against a trailing mean."""
    f = S.trailing_fit(shares(spark, sf), ["party"], "t", "s", 3)
    moved = F.avg((F.abs("d") > 0.01).cast("int"))
    q = S.fit_quality(f, ["party"], "s", "fit", {"change_prob": moved})
    return q.select("party", *[
        r6(F.col(c)).alias(c) for c in ("r2", "max_abs_error", "change_prob", "r")])


@query(f"""WITH {CTE_SHARE}, m AS (SELECT party, sum(y) / (SELECT sum(y) FROM period) AS p FROM period
GROUP BY 1) SELECT t, party, round((s - p) / sqrt(p * (1 - p)), 6) AS std_residual,
round(ln(p / (SELECT p FROM m WHERE party = 'other')), 6) AS log_ratio FROM share JOIN m USING (party)""")
def standardised_residual(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of each share from the party's overall share, and its log ratio to the residual."""
    party, whole = Window.partitionBy("party"), Window.partitionBy()  # calendar-sized cells
    total = F.sum("y").over(whole)
    x = shares(spark, sf).withColumns({
        "p": F.sum("y").over(party) / total,
        "po": F.sum(F.when(F.col("party") == "other", F.col("y"))).over(whole) / total})
    return x.select(
        "t", "party", r6(N.standardised_residual(F.col("s"), F.col("p"))).alias("std_residual"),
        r6(N.log_ratio(F.col("p"), F.col("po"))).alias("log_ratio"))


@query(f"""WITH {CTE_SHARE}, v AS (SELECT party, avg(s) AS p, stddev_samp(s) AS sigma FROM share GROUP BY 1),
c AS (SELECT a.party, corr(a.s, r.s) AS rho_r, corr(a.s, j.s) AS rho_j FROM share a
 JOIN share r ON a.t = r.t AND r.party = 'other' JOIN share j ON a.t = j.t AND j.party = 'small' GROUP BY 1)
SELECT c.party, round((rho_r * r.p + rho_j * j.p) / (r.p + j.p), 6) AS rho_new,
round(sqrt((r.p * r.p * r.sigma * r.sigma + j.p * j.p * j.sigma * j.sigma) / ((r.p + j.p) * (r.p + j.p))), 6)
 AS sigma_new, round(r.p + j.p, 6) AS p_new
FROM c, v r, v j WHERE r.party = 'other' AND j.party = 'small' AND c.party NOT IN ('other', 'small')""")
def party_dropout(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation, spread and share of the residual after it absorbs another party."""
    # One row per period with the shares of all parties; one aggregate gives every moment.
    y = cells(spark, sf, period())
    total = N.row_sum(PARTIES)
    s = y.select(*[(F.col(p) / total).alias(p) for p in PARTIES])
    both = F.col("other").isNotNull() & F.col("small").isNotNull()
    rest = [p for p in PARTIES if p not in ("other", "small")]
    m = s.agg(
        *[f("other" if k == "r" else "small").alias(f"{n}_{k}") for k in "rj"
          for n, f in (("p", F.avg), ("g", F.stddev_samp))],
        *[F.corr(F.when(both, F.col(p)), F.col("other" if k == "r" else "small")).alias(f"{k}_{p}")
          for k in "rj" for p in rest])
    pr, pj, gr, gj = (F.col(c) for c in ("p_r", "p_j", "g_r", "g_j"))
    each = F.explode(F.array(*[F.struct(
        F.lit(p).alias("party"),
        N.absorbed_correlation(F.col(f"r_{p}"), F.col(f"j_{p}"), pr, pj).alias("rho"))
        for p in rest]))
    spread = N.absorbed_sigma(gr, gj, pr, pj)
    return m.select(each.alias("e"), spread.alias("g"), (pr + pj).alias("p")).select(
        "e.party", r6(F.col("e.rho")).alias("rho_new"), r6(F.col("g")).alias("sigma_new"),
        r6(F.col("p")).alias("p_new"))
