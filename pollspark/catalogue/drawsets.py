"""Posterior draws: melting, names, quantiles, daily rows, snapshots, products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pollspark.catalogue.base import (
    CTE_DRAWS, LAST_DAY, LEVEL_KEYS, LEVELS, ORIGIN, PARTIES, PARTY_IDX, SQL_PARTY,
    SQL_PARTY_IDX, draws, line_parties, orders, party_of, query, r6, size_of, sql_quantiles, sql_t, table,
)
from pollspark.functions import numeric as N
from pollspark.functions.dates import days_open, grid_index, grid_start, iso
from pollspark.functions.text import indexed_name
from pollspark.operators import joins, quantiles, reshape, rows, series as S

# Draws have 7 decimals, so 9 hold every interpolated quantile exactly.
_ROUND_Q = ", ".join(f"round_even(round({k}, 9), 3) AS {k}" for k in LEVEL_KEYS)


def trend(spark: SparkSession, sf: str, **limits: int) -> DataFrame:
    """Seven exact quantiles per (period, party)."""
    return quantiles.exact_quantiles(draws(spark, sf), ["t", "party"], "value", LEVELS, LEVEL_KEYS,
                                     size_of(spark, sf, "lineitem"), **limits)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.bround(F.round(k, 9), 3) + F.lit(0.0) for k in LEVEL_KEYS})


_SQL_TREND = f"""WITH {CTE_DRAWS}, q AS ({sql_quantiles('t, party', 'draws')})
SELECT t, party, {', '.join(f'round({k}, 9) AS {k}' for k in LEVEL_KEYS)} FROM q"""


@query(_SQL_TREND)
def trend_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantile trend of the draws."""
    return trend(spark, sf).select("t", "party", *[F.round(k, 9).alias(k) for k in LEVEL_KEYS])


@query(_SQL_TREND)
def trend_quantiles_by_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The same trend the way it runs on a large table: ranked over value bins."""
    out = trend(spark, sf, one_task_rows=0, rows_per_bin=20_000)
    return out.select("t", "party", *[F.round(k, 9).alias(k) for k in LEVEL_KEYS])


@query(f"""WITH d AS (SELECT 'pi[' || CAST({sql_t('l_shipdate')} AS VARCHAR) || ',' ||
CAST(({SQL_PARTY_IDX.replace('party', f'({SQL_PARTY})')}) AS VARCHAR) || ']' AS variable
FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT variable, count(*) AS n_draws FROM d GROUP BY 1)
SELECT variable, regexp_extract(variable, '^([^\\[]+)', 1) AS base,
CAST(regexp_extract(variable, '\\[(\\d+),', 1) AS INTEGER) AS i,
CAST(regexp_extract(variable, ',(\\d+)\\]', 1) AS INTEGER) AS j, n_draws FROM n""")
def draw_names_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Names such as ``pi[12,3]`` taken apart, once per distinct name."""
    lines = line_parties(spark, sf, "l_shipdate")
    idx = F.element_at(F.create_map(*[F.lit(x) for kv in PARTY_IDX.items() for x in kv]),
                       F.col("party"))
    t = grid_index(F.col("l_shipdate").cast("date"), ORIGIN)
    named = lines.select(F.format_string("pi[%d,%d]", t, idx).alias("variable")).groupBy(
        "variable").agg(F.count(F.lit(1)).alias("n_draws"))
    base, i, j = indexed_name(F.col("variable"))
    return named.select("variable", base.alias("base"), i.alias("i"), j.alias("j"), "n_draws")


def _days(spark: SparkSession, sf: str) -> DataFrame:
    """Days to the end of the last period that has a draw; a scan of one column finds it."""
    t = grid_index(F.col("l_shipdate").cast("date"), ORIGIN)
    return days_open(spark, ORIGIN, LAST_DAY, table(spark, sf, "lineitem"), F.date_sub(grid_start(t + 1, ORIGIN), 1))


def melted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("k", "value"))


@query("""SELECT vec_id, label, CAST(k - 1 AS INTEGER) AS k, round(CAST(v AS DOUBLE), 6) AS value FROM
(SELECT vec_id, label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)""")
def draws_melt(spark: SparkSession, sf: str) -> DataFrame:
    """Array draws as long rows."""
    return melted(spark, sf).withColumn("value", r6(F.col("value").cast("double")))


@query(f"""WITH {CTE_DRAWS}, q AS ({sql_quantiles('t, party', 'draws')}),
d AS (SELECT CAST(unnest(generate_series(DATE '{ORIGIN}', greatest(DATE '{LAST_DAY}', DATE '{ORIGIN}' + CAST((SELECT max(t) FROM draws) AS INTEGER) * 14 - 1), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT strftime(day, '%Y-%m-%d') AS day, party, {_ROUND_Q} FROM d JOIN q ON q.t = {sql_t('day')}""")
def daily_broadcast(spark: SparkSession, sf: str) -> DataFrame:
    """Period quantiles on every day of the period."""
    days = _days(spark, sf)
    return rounded(joins.days_of_periods(days, trend(spark, sf), ORIGIN)).select(
        iso("date").alias("day"), "party", *LEVEL_KEYS)


@query(f"""WITH {CTE_DRAWS}, q AS ({sql_quantiles('t, party', 'draws')}),
l AS (SELECT * FROM q WHERE t = (SELECT max(t) FROM q)), m AS (SELECT count(*) AS n_total,
 count(CASE WHEN CAST(o_orderdate AS DATE) >= DATE '2001-11-05' - 120 THEN 1 END) AS n_recent,
 strftime(max(o_orderdate), '%Y-%m-%d') AS last_date FROM orders)
SELECT strftime(DATE '{ORIGIN}' + (t - 1) * 14, '%Y-%m-%d') AS day, party AS id,
CAST(row_number() OVER (ORDER BY median DESC, party) AS BIGINT) AS rank, {_ROUND_Q},
n_total, n_recent, last_date FROM l, m""")
def current_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Latest period by median, with the totals of the polls; only its draws are summarised."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    t = grid_index(F.col("l_shipdate").cast("date"), ORIGIN)
    latest = joins.latest_only(lines.withColumn("t", t), "t")
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    d = latest.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "t", party_of(F.col("p_type")).alias("party"),
        (F.col("l_extendedprice") / 100000).alias("value"))
    q = quantiles.exact_quantiles(d, ["t", "party"], "value", LEVELS, LEVEL_KEYS,
                                  size_of(spark, sf, "lineitem"))
    day = F.col("day")
    meta = orders(spark, sf).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(day >= F.date_sub(F.lit("2001-11-05").cast("date"), 120)).alias("n_recent"),
        iso(F.max("day")).alias("last_date"))
    w = Window.orderBy(F.desc("median"), "party")  # one row per party
    ranked = q.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return rounded(ranked).crossJoin(meta).select(
        iso(grid_start(F.col("t"), ORIGIN)).alias("day"), F.col("party").alias("id"), "rank",
        *LEVEL_KEYS, "n_total", "n_recent", "last_date")


_SQL_DOC = " || ',' || ".join(
    f"""'"{p}":{{' || """ + " || ',' || ".join(
        f"""'"{k}":' || coalesce(CAST(max(CASE WHEN party = '{p}' THEN {k} END) AS VARCHAR), 'null')"""
        for k in LEVEL_KEYS) + " || '}'" for p in sorted(PARTIES))


@query(f"""WITH {CTE_DRAWS}, q0 AS ({sql_quantiles('t, party', 'draws')}),
q AS (SELECT t, party, {_ROUND_Q} FROM q0),
doc AS (SELECT t, '{{' || {_SQL_DOC} || '}}' AS parties FROM q GROUP BY t),
d AS (SELECT CAST(unnest(generate_series(DATE '{ORIGIN}', greatest(DATE '{LAST_DAY}', DATE '{ORIGIN}' + CAST((SELECT max(t) FROM draws) AS INTEGER) * 14 - 1), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT strftime(day, '%Y-%m-%d') AS date, parties FROM d JOIN doc ON doc.t = {sql_t('day')}""")
def nested_timeseries(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON object per day, nested by party, nulls for a party without draws; nested once per period."""
    q = rounded(trend(spark, sf))
    nested = reshape.nest_by_key(q, ["t"], "party", LEVEL_KEYS, "parties")
    parties = reshape.complete_map(F.col("parties"), sorted(PARTIES), LEVEL_KEYS)
    docs = nested.select("t", F.to_json(parties, {"ignoreNullFields": "false"}).alias("parties"))
    return joins.days_of_periods(_days(spark, sf), docs, ORIGIN).select(
        iso("date").alias("date"), "parties")


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
x AS (SELECT vec_id, label, e, list_transform(e, lambda z: exp(z)) AS a,
 list_transform(e, lambda z: exp(0.5 * z)) AS b,
 list_transform(list_zip(e, list_reverse(e)), lambda z: exp(z[1] + 0.1 * z[2])) AS c FROM v),
y AS (SELECT label, list_sum(a) AS sa, list_sum(b) AS sb, list_sum(c) AS sc,
 unnest(a) AS a, unnest(b) AS b, unnest(c) AS c, unnest(range(len(a))) AS k FROM x)
SELECT label, CAST(k AS INTEGER) AS k, round(avg(a / sa), 6) AS share, round(avg(b / sb), 6) AS long_share,
round(avg(a / sa - b / sb), 6) AS short_share, round(avg(c / sc - a / sa), 6) AS polling_error
FROM y GROUP BY 1, 2""")
def softmax_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax shares per draw, split into long and short term, and the error on share scale."""
    e = F.col("embedding").cast("array<double>")
    v = table(spark, sf, "embeddings").select("label", e.alias("e"))
    half = F.transform("e", lambda x: x * 0.5)
    lng, short = S.long_short_shares(half, F.col("e"))
    err = S.share_error(F.col("e"), F.transform(F.reverse("e"), lambda x: x * 0.1))
    s = v.select("label", N.softmax_array(F.col("e")).alias("a"), lng.alias("b"),
                 short.alias("c"), err.alias("d"))
    long = s.select("label", F.posexplode(F.arrays_zip("a", "b", "c", "d")).alias("k", "z"))
    names = {"a": "share", "b": "long_share", "c": "short_share", "d": "polling_error"}
    return long.groupBy("label", "k").agg(*[
        r6(F.avg(f"z.{c}")).alias(n) for c, n in names.items()])


def basis_table(spark: SparkSession, periods: int, n_basis: int) -> DataFrame:
    """Long spline basis (t, k, b) over ``periods`` periods with evenly spread inner knots."""
    inner = n_basis - 4
    knots = [1 + (periods - 1) * (i + 1) / (inner + 1) for i in range(inner)]
    t = spark.range(1, periods + 1).select(F.col("id").cast("int").alias("t"))
    return t.select("t", F.posexplode(
        N.bspline_basis(F.col("t"), knots, 1.0, float(periods))).alias("k", "b")).where("b <> 0")


def _sql_order(d: int) -> str:
    """Raise a basis by one order: neighbours blended by their distance to the knots."""
    return f"""n{d} AS (SELECT n.t, n.i, coalesce((n.t - a.g) / nullif(b.g - a.g, 0), 0) * v
 + coalesce((d.g - n.t) / nullif(d.g - c.g, 0), 0) * coalesce(lead(v) OVER (PARTITION BY n.t ORDER BY n.i), 0) AS v
 FROM n{d - 1} n JOIN k a ON a.i = n.i JOIN k b ON b.i = n.i + {d} JOIN k c ON c.i = n.i + 1 JOIN k d ON d.i = n.i + {d + 1})"""


@query(f"""WITH k AS (SELECT i, CASE WHEN i < 4 THEN 1.0::DOUBLE WHEN i >= 64 THEN 180.0::DOUBLE
 ELSE 1 + 179 * (i - 3)::DOUBLE / 61 END AS g FROM range(68) r(i)),
p AS (SELECT t FROM range(1, 181) r(t)),
n0 AS (SELECT t, a.i, CASE WHEN (t >= a.g AND t < b.g) OR (t = 180 AND a.i = 63) THEN 1.0 ELSE 0.0 END::DOUBLE AS v
 FROM p, k a JOIN k b ON b.i = a.i + 1), {_sql_order(1)}, {_sql_order(2)}, {_sql_order(3)},
beta AS (SELECT label, k, avg(v) AS beta FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v,
 unnest(range(len(embedding))) AS k FROM embeddings) GROUP BY 1, 2)
SELECT label, CAST(t AS INTEGER) AS t, round(sum(v * beta), 6) AS alpha FROM n3 JOIN beta ON n3.i = beta.k GROUP BY 1, 2""")
def basis_product(spark: SparkSession, sf: str) -> DataFrame:
    """Spline paths: basis times coefficients, summed over the basis.

    The product is linear, so coefficients are averaged per label before the join. Only four
    basis values per period differ from zero, and zeros are not joined.
    """
    beta = melted(spark, sf).groupBy("label", "k").agg(
        F.avg(F.col("value").cast("double")).alias("beta"))
    basis = basis_table(spark, 180, 64)
    return basis.join(beta, "k").groupBy("label", "t").agg(
        r6(F.sum(F.col("b") * F.col("beta"))).alias("alpha"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT i, j FROM range(8) a(i), range(8) b(j)),
o AS (SELECT vec_id, i, j, list_dot_product(e[i*8+1:i*8+8], e[j*8+1:j*8+8]) AS v FROM e, g)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(quantile_cont(v, 0.5), 6) AS median,
round(avg(v), 6) AS mean FROM o GROUP BY 1, 2""")
def pair_products(spark: SparkSession, sf: str) -> DataFrame:
    """Ω = L·Lᵀ per draw (64 values as an 8×8 factor), summarised per cell.

    Every draw gives 64 cells, as many as it has values.
    """
    e = F.col("embedding").cast("array<double>")
    rows_ = F.array(*[F.slice(e, i * 8 + 1, 8) for i in range(8)])
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                 N.dot(F.get("L", F.lit(i)), F.get("L", F.lit(j))).alias("v"))
        for i in range(8) for j in range(8)])
    o = table(spark, sf, "embeddings").select(rows_.alias("L")).select(
        F.explode(cells).alias("c")).select("c.i", "c.j", "c.v")
    n = size_of(spark, sf, "embeddings") * 64
    return quantiles.exact_quantiles(o, ["i", "j"], "v", [0.5], ["median"], n,
                                     extra={"mean": F.avg("v")}).select(
        "i", "j", r6(F.col("median")).alias("median"), r6(F.col("mean")).alias("mean"))


@query("""WITH m AS (SELECT label, k, avg(v) AS v FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v,
unnest(range(len(embedding))) AS k FROM embeddings) GROUP BY 1, 2)
SELECT a.label AS i, b.label AS j, round(corr(a.v, b.v), 6) AS r, round(sum(a.v * b.v), 6) AS omega
FROM m a JOIN m b USING (k) GROUP BY 1, 2""")
def pair_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation and product of the mean draws of two labels; means are taken before pairing."""
    m = melted(spark, sf).groupBy("label", "k").agg(F.avg(F.col("value").cast("double")).alias("v"))
    a = m.select(F.col("label").alias("i"), "k", F.col("v").alias("x"))
    b = m.select(F.col("label").alias("j"), "k", F.col("v").alias("y"))
    return a.join(b, "k").groupBy("i", "j").agg(
        r6(F.corr("x", "y")).alias("r"), r6(F.sum(F.col("x") * F.col("y"))).alias("omega"))


_SQL_MAD = f"""WITH {CTE_DRAWS}, m AS (SELECT party, quantile_cont(value, 0.5) AS median FROM draws GROUP BY 1),
a AS (SELECT party, any_value(median) AS median, quantile_cont(abs(value - median), 0.5) * 1.4826 AS mad
 FROM draws JOIN m USING (party) GROUP BY 1),
s AS (SELECT party, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM draws GROUP BY 1)
SELECT party, n, round(median, 6) AS median, round(mad, 6) AS mad, round(mean, 6) AS mean,
round(sd, 6) AS sd, round(mean - 0.5, 6) AS bias FROM s JOIN a USING (party)"""


@query(_SQL_MAD)
def group_mad(spark: SparkSession, sf: str, **limits: int) -> DataFrame:
    """Median, scaled MAD, mean, spread and distance from a true value per party."""
    d = draws(spark, sf, "l_orderkey", "l_linenumber")
    robust = quantiles.median_and_mad(
        d, ["party"], "value", ["l_orderkey", "l_linenumber"], size_of(spark, sf, "lineitem"),
        extra={"mean": F.avg("value"), "sd": F.stddev_samp("value")}, **limits)
    return robust.select(
        "party", "n", *[r6(F.col(c)).alias(c) for c in ("median", "mad", "mean", "sd")],
        r6(F.col("mean") - 0.5).alias("bias"))


@query(_SQL_MAD)
def group_mad_in_bins(spark: SparkSession, sf: str) -> DataFrame:
    """The same the way it runs on a large table: ranked over bins, medians looked up by a counted broadcast."""
    return group_mad(spark, sf, one_task_rows=0, rows_per_bin=5_000)


@query("""SELECT k, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.05), 6) AS q05,
round(quantile_cont(v, 0.95), 6) AS q95, round(sqrt(avg(v * v)), 6) AS rms FROM
(SELECT CAST(unnest(embedding) AS DOUBLE) AS v, CAST(unnest(range(len(embedding))) AS INTEGER) AS k
 FROM embeddings) GROUP BY 1""")
def variable_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and interval per index of an array variable."""
    m = melted(spark, sf).select("k", F.col("value").cast("double").alias("v"))
    n = size_of(spark, sf, "embeddings") * 64
    q = quantiles.exact_quantiles(m, ["k"], "v", [0.05, 0.95], ["q05", "q95"], n, extra={
        "mean": F.avg("v"), "rms": F.sqrt(F.avg(F.col("v") * F.col("v")))})
    return q.select("k", "n", *[r6(F.col(c)).alias(c)
                                             for c in ("mean", "q05", "q95", "rms")])


@query("""SELECT vec_id, label FROM embeddings
ORDER BY md5('42|' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 100""")
def sample_draws(spark: SparkSession, sf: str) -> DataFrame:
    """A reproducible random choice of 100 draws."""
    return rows.pick(table(spark, sf, "embeddings").select("vec_id", "label"), ["vec_id"], 100, 42)
