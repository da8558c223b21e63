"""Readers, writers and reshaping of whole tables, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollspark.catalogue import standin as S
from pollspark.catalogue.base import query, r6, table
from pollspark.functions import text as X
from pollspark.functions.dates import iso
from pollspark.operators import reshape
from pollspark.plans import canonical, checks, model_input, publish
from pollspark.sources import files

_USED = [S.COLUMNS[p] for p in S.PARTIES]
_PAIRS = " || ".join(f"coalesce('|{p}=' || CAST({S.COLUMNS[p]} AS VARCHAR), '')" for p in sorted(S.PARTIES))


@query(f"""WITH {S.CTE_POLLS}, g AS (SELECT pollster, date_published, date_start, date_end, n, method, {', '.join(f'min({c}) AS {c}' for c in _USED)} FROM valid GROUP BY 1, 2, 3, 4, 5, 6),
i AS (SELECT *, sha256(pollster || '|' || strftime(date_published, '%Y-%m-%d') || '|' || strftime(date_start, '%Y-%m-%d') || '|' || strftime(date_end, '%Y-%m-%d') || '|' || CAST(n AS VARCHAR) || {_PAIRS}) AS uuid FROM g)
SELECT uuid, strftime(date_published, '%Y-%m-%d') AS day, unnest({S.PARTIES}) AS party, unnest([{', '.join(_USED)}]) AS vote_share FROM i""")
def id_migration(spark: SparkSession, sf: str) -> DataFrame:
    """Long rows under old ids, rewritten with content ids to a new path."""
    old = canonical.load_long(S.valid_polls(spark, sf), S.PARTIES).withColumn("uuid", F.substring("uuid", 1, 8))
    new = files.rewrite(old, canonical.migrate_ids, S.folder(spark, "migrated"))
    return new.select("uuid", iso("publishing_date").alias("day"), "party", "vote_share")


@query("""WITH o AS (SELECT DISTINCT o_orderpriority AS source, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders)
SELECT source, CASE WHEN y = '2001' THEN 'current' ELSE y END AS period, 'http://polls.example/' || source || '/' || y AS url FROM o""")
def page_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue of a source's pages, written as one JSON object per source and read back."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), F.year("o_orderdate").cast("string").alias("y")).distinct()
    links = o.select("source", F.when(F.col("y") == "2001", "current").otherwise(F.col("y")).alias("period"), F.concat_ws("/", F.lit("http://polls.example"), "source", "y").alias("url"))
    out = S.folder(spark, "catalogue")
    files.write_catalogue(links, out)
    return files.read_catalogue(spark, out)


@query(f"WITH {S.CTE_LINES}, {S.CTE_TREND} SELECT CAST(t AS INTEGER) AS i, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM draws WHERE party = 'SPD' GROUP BY 1")
def draws_file(spark: SparkSession, sf: str) -> DataFrame:
    """Draws of two variables in one Parquet table; one variable is read and summarised."""
    d = S.draws(spark, sf, "l_linenumber")
    both = d.select(F.lit(1).alias("chain"), F.col("l_linenumber").alias("iter"), F.when(F.col("j") == 2, "pi").otherwise("rest").alias("variable"), "i", "j", "value")
    out = S.folder(spark, "draws")
    both.write.parquet(out)
    read = files.read_draws(spark, out, "pi")
    counts = read.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return checks.parameter_summary(read).join(counts, "i").select("i", "n", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"))


@query("""SELECT event_type AS model, round(sum(value), 4) AS seconds, CAST(sum(CAST(user_id % 7 = 0 AS INTEGER)) AS BIGINT) AS n_divergent, CAST(sum(CAST(user_id % 5 = 0 AS INTEGER)) AS BIGINT) AS depth_hits,
min(value) AS min_ess, max(value) AS max_rhat FROM events GROUP BY 1""")
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """One table of diagnostics per model, compared and written as CSV."""
    ev = table(spark, sf, "events")
    names = sorted(r[0] for r in ev.select("event_type").distinct().collect())  # one frame per model
    user = F.col("user_id")
    runs = {m: ev.where(F.col("event_type") == m).select(F.col("value").alias("seconds"), (user % 7 == 0).cast("bigint").alias("n_divergent"), (user % 5 == 0).cast("bigint").alias("depth_hits"),
                                                         F.col("value").alias("ess"), F.col("value").alias("rhat")) for m in names}
    out = S.folder(spark, "models")
    files.write_csv(checks.compare_models(runs).withColumn("seconds", F.round("seconds", 4)), out)
    return spark.read.csv(out, schema="model string, seconds double, n_divergent bigint, depth_hits bigint, min_ess double, max_rhat double", header=True)


@query(f"""WITH {S.CTE_POLLS}, x AS (SELECT poll_id, unnest(['AfD', 'CDU/CSU', 'FDP', 'GRÜNE', 'LINKE', 'SPD']) AS party, unnest([afd, cdu_csu, fdp, gruene, linke, spd]) AS share FROM valid)
SELECT party, count(*) AS n, count(share) AS n_known, round(sum(share), 4) AS total FROM x GROUP BY 1""")
def dynamic_melt(spark: SparkSession, sf: str) -> DataFrame:
    """Text columns that look like percentages are found, empty columns dropped, and the rest melted."""
    polls = S.valid_polls(spark, sf)
    shown = [F.concat(F.replace(F.col(S.COLUMNS[p]).cast("string"), F.lit("."), F.lit(",")), F.lit(" %")).alias(p) for p in S.PARTIES]
    wide = polls.select(F.col("poll_id").alias("uuid"), "pollster", F.lit(None).cast("string").alias("BSW"), F.lit("a note").alias("remark"), *shown)
    kept = reshape.drop_null_columns(wide)
    found = [c for c in reshape.percent_columns(kept, ["uuid"], X.PERCENT_PATTERN) if c in reshape.party_columns(kept)]
    long = reshape.to_long(kept, ["uuid"], [f"`{c}`" for c in found], "party", "share")
    share = X.percent_value(F.col("share"))
    return long.groupBy("party").agg(F.count(F.lit(1)).alias("n"), F.count(share).alias("n_known"), F.round(F.sum(share), 4).alias("total"))


_WIDE = ", ".join(f'max(CASE WHEN p = {i} THEN n END) AS "{k}__n", round(max(CASE WHEN p = {i} THEN total END), 4) AS "{k}__total"' for i, k in ((1, "F"), (2, "O"), (3, "P")))


@query(f"""WITH g AS (SELECT o_orderpriority AS pollster, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS p, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT pollster, {_WIDE} FROM g GROUP BY 1""")
def wide_structs(spark: SparkSession, sf: str) -> DataFrame:
    """Two values per name as columns with composed names."""
    g = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("pollster"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    wide = reshape.to_wide_structs(g, ["pollster"], "o_orderstatus", ["n", "total"], ["F", "O", "P"])
    return wide.withColumns({f"{c}__total": F.round(f"{c}__total", 4) for c in "FOP"})


_PATTERN = "concat_ws(' | ', " + ", ".join(f"CASE WHEN {S.COLUMNS[p]} > 0 THEN '{p}' END" for p in S.PARTIES) + ")"


@query(f"""WITH {S.CTE_POLLS}, p AS (SELECT poll_id, n, {_PATTERN} AS pattern, {' + '.join(f'CAST(coalesce({c} > 0, false) AS INTEGER)' for c in _USED)} AS k,
 {' + '.join(f'CAST({c} IS NOT NULL AS INTEGER)' for c in _USED)} AS known FROM valid WHERE date_published > DATE '1996-01-01' AND date_published < DATE '2000-12-31'),
q AS (SELECT * FROM p WHERE contains(pattern, 'CDU/CSU') AND pattern <> 'CDU/CSU')
SELECT pattern, dense_rank() OVER (ORDER BY pattern) AS pattern_idx, count(*) AS n_surveys, CAST(sum(known) AS BIGINT) AS n_rows FROM q GROUP BY 1""")
def job_older_input(spark: SparkSession, sf: str) -> DataFrame:
    """The older input path: window, reporting patterns and their index."""
    long = canonical.load_long(S.valid_polls(spark, sf), S.PARTIES)
    rows = model_input.transform_polls(long, "1996-01-01", "2000-12-31", S.PARTIES)
    named = model_input.with_pattern(rows, S.PARTIES, "CDU/CSU", exclude="CDU/CSU")
    return named.groupBy("pattern", F.col("pattern_idx").cast("bigint").alias("pattern_idx")).agg(
        F.count_distinct("uuid").alias("n_surveys"), F.count(F.lit(1)).alias("n_rows"))


@query(f"""WITH s(run, shift) AS (VALUES ('2024-01-01', 0), ('2024-01-02', 1)), p AS (SELECT p_type AS party, count(*) AS n, min(p_size) AS least FROM part GROUP BY 1)
SELECT run, 'by_party' AS section, party, n + shift AS n, least FROM p, s UNION ALL SELECT run, 'total', NULL, CAST(sum(n) AS BIGINT) + any_value(shift), NULL FROM p, s GROUP BY run""")
def benchmark_history(spark: SparkSession, sf: str) -> DataFrame:
    """Check tables of two runs appended to a history, read back as JSON."""
    per = table(spark, sf, "part").groupBy(F.col("p_type").alias("party")).agg(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("least"))
    out = S.folder(spark, "history")
    for shift, run in enumerate(("2024-01-01", "2024-01-02")):
        publish.append_benchmark({"by_party": per.withColumn("n", F.col("n") + shift), "total": per.agg((F.sum("n") + shift).alias("n"))}, run, out)
    doc = F.from_json("value", "party string, n bigint, least bigint")
    return spark.read.parquet(out).select(F.col("run_ts").cast("string").alias("run"), "section", doc.alias("d")).select("run", "section", "d.*")
