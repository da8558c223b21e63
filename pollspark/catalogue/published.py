"""The published documents, written and read back, and the checks of their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pollspark import dims, schemas
from pollspark.catalogue import standin as S
from pollspark.catalogue.base import AS_OF, ORIGIN, query, size_of, sql_t
from pollspark.functions.dates import days_through, iso
from pollspark.plans import canonical, document_checks, publish, trend as trends
from pollspark.sources.files import read_json_lines

NOW = "2001-11-05T00:00:00Z"
_QS = dims.QUANTILE_KEYS


def trend(spark: SparkSession, sf: str) -> DataFrame:
    return trends.trend_table(S.draws(spark, sf), S.PARTIES, size_of(spark, sf, "lineitem"), ORIGIN)


@query(f"WITH {S.CTE_LINES}, {S.CTE_TREND} SELECT t, party, strftime(DATE '{ORIGIN}' + (t - 1) * 14, '%Y-%m-%d') AS date, "
       + ", ".join(f"round({k}, 9) AS {k}" for k in _QS) + " FROM trend")
def job_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Trend table from draws: quantiles per period and party, with the period's first day."""
    return trend(spark, sf).select("t", "party", iso("date").alias("date"), *[F.round(k, 9).alias(k) for k in _QS])


def _daily(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    shares = trend(spark, sf)
    return publish.daily_rows(shares, days_through(shares, "t", ORIGIN), ORIGIN), shares


def _header(spark: SparkSession, sf: str, daily: DataFrame) -> DataFrame:
    return publish.timeseries_header(daily, S.results(spark, sf), S.PARTIES, 2000, (0, None), F.lit(NOW))


@query(f"""WITH {S.CTE_LINES}, {S.CTE_TREND} SELECT strftime(day, '%Y-%m-%d') AS date, key, {', '.join(_QS)},
(SELECT count(DISTINCT day) FROM daily) AS n_days FROM daily""")
def job_timeseries_document(spark: SparkSession, sf: str) -> DataFrame:
    """The daily document, written as header and lines and read back with its schema."""
    daily, _ = _daily(spark, sf)
    out = S.folder(spark, "timeseries")
    publish.write_document(_header(spark, sf, daily), daily, out)
    rows = read_json_lines(spark, f"{out}/rows", schemas.TIMESERIES_ROW)
    head = read_json_lines(spark, f"{out}/header", schemas.TIMESERIES_DOC).select(F.col("metadata.n_days").alias("n_days"))
    return rows.select("date", F.explode("parties").alias("key", "q")).select("date", "key", "q.*").crossJoin(head)  # one row


_SQL_LAST = f"""last AS (SELECT * FROM rounded WHERE t = (SELECT max(t) FROM rounded))"""


@query(f"""WITH {S.CTE_POLLS}, {S.CTE_TREND}, {_SQL_LAST}
SELECT strftime(DATE '{ORIGIN}' + (t - 1) * 14, '%Y-%m-%d') AS date, key AS id, CAST(row_number() OVER (ORDER BY median DESC, key) AS BIGINT) AS rank,
{', '.join(_QS)}, (SELECT count(*) FROM valid) AS n_polls_total, (SELECT count(*) FROM valid WHERE date_published >= DATE '{AS_OF}' - 30) AS n_polls_last_30d,
(SELECT strftime(max(date_published), '%Y-%m-%d') FROM valid) AS last_poll_date,
(SELECT pollster FROM valid ORDER BY date_published DESC, pollster, poll_id LIMIT 1) AS last_poll_pollster FROM last""")
def job_snapshot_document(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot document, written and read back."""
    out = S.folder(spark, "snapshot")
    doc = publish.current_snapshot(trend(spark, sf), S.valid_polls(spark, sf), S.as_of(), F.lit(NOW), ORIGIN)
    publish.write_document(doc, None, out)
    read = read_json_lines(spark, f"{out}/header", schemas.CURRENT_DOC)
    return read.select("date", F.posexplode("parties").alias("at", "p"), "meta.*").select(
        "date", "p.id", (F.col("at") + 1).cast("bigint").alias("rank"), *[f"p.{k}" for k in _QS],
        "n_polls_total", "n_polls_last_30d", "last_poll_date", "last_poll_pollster")


_SHARES = ", ".join(f"round_even(round({S.COLUMNS[p]} / 100, 9), 3) AS {k}" for p, k in zip(S.PARTIES, S.KEYS))


@query(f"""WITH {S.CTE_POLLS} SELECT strftime(date_published, '%Y-%m-%d') AS date, pollster, CAST(n AS BIGINT) AS sample_size, {_SHARES},
(SELECT count(*) FROM valid) AS n_polls FROM valid""")
def job_polls_document(spark: SparkSession, sf: str) -> DataFrame:
    """The polls document, written and read back."""
    out = S.folder(spark, "polls")
    rows = publish.poll_rows(S.valid_polls(spark, sf))
    publish.write_document(publish.polls_header(rows, F.lit(NOW)), rows, out, keep_nulls=True)
    head = read_json_lines(spark, f"{out}/header", schemas.POLLS_DOC).select("n_polls")
    return read_json_lines(spark, f"{out}/rows", schemas.POLL_ROW).select("date", "pollster", "sample_size", *S.KEYS).crossJoin(head)  # one row


# ---- Rules of the documents, on the published texts and on damaged ones ----------------------


def _texts(df: DataFrame) -> DataFrame:
    return publish.json_lines(df, keep_nulls=True)


def _damaged_days(daily: DataFrame) -> DataFrame:
    """Days left out, a party left out, an interval turned round, a value with too many decimals, a broken date."""
    k = F.col("k")
    dated = daily.withColumn("k", F.datediff(F.col("date").cast("date"), F.lit(ORIGIN).cast("date"))).where("k % 53 <> 0")
    moved = F.transform_values("parties", lambda key, q: F.when((key == "SPD") & (k % 61 == 2), q.withField("q10", F.round(q["median"] + 0.2, 3)))
                               .when((key == "AfD") & (k % 67 == 3), q.withField("q25", q["q25"] + 0.0004)).otherwise(q))
    kept = F.map_filter("parties", lambda key, q: ~((key == "FDP") & (k % 59 == 1)))
    broken = F.when(k % 401 == 5, "no date").otherwise(F.col("date"))
    return dated.withColumn("parties", moved).withColumn("parties", kept).withColumn("date", broken).drop("k")


def _damaged_header(head: DataFrame) -> DataFrame:
    first = F.col("elections")[0].withField("results", F.map_filter(F.col("elections")[0]["results"], lambda k, v: F.lit(False)))
    colour = F.transform_values("parties", lambda k, p: F.when(k == "SPD", p.withField("color", F.lit("red"))).otherwise(p))
    return head.select(F.col("metadata").withField("generated_at", F.lit("")).withField("quantiles", F.slice("metadata.quantiles", 1, 6)).alias("metadata"),
                       colour.alias("parties"), F.concat(F.array(first), F.slice("elections", 2, 1000)).alias("elections"))


def _damaged_snapshot(doc: DataFrame) -> DataFrame:
    turned = F.transform(F.reverse("parties"), lambda p: F.when(p["id"] == "SPD", p.withField("median", F.lit(1.5))).when(p["id"] == "AfD", p.withField("q05", F.lit(None).cast("double"))).otherwise(p))
    return doc.withColumns({"parties": turned, "meta": F.col("meta").withField("last_poll_date", F.lit(None).cast("string"))})


def _damaged_polls(rows: DataFrame) -> DataFrame:
    day = F.dayofyear(F.col("date").cast("date"))
    return rows.withColumns({"CDU_CSU": F.when(day == 71, F.lit(7.5)).otherwise(F.col("CDU_CSU")),
                             "SPD": F.when((day == 72) & (F.col("SPD") < 0.9), F.col("SPD") + 0.0004).otherwise(F.col("SPD"))})


_PAIRS = list(zip(_QS, _QS[1:]))
_FALLS = "concat_ws(',', " + ", ".join(f"CASE WHEN {a} > {b} THEN '{a}>{b}' END" for a, b in _PAIRS) + ")"
_LONG = "concat_ws(',', " + ", ".join(f"CASE WHEN round({k}, 3) <> {k} THEN '{k}' END" for k in _QS) + ")"
_TEXT_KEYS = sorted(S.KEYS)


def _sql_days(copy: str, rows: str) -> str:
    """Findings of day rows (copy's name, rows (label, d, key, quantiles) with d null where the date is broken)."""
    keys = ", ".join(f"CASE WHEN count(CASE WHEN key = '{k}' THEN 1 END) = 0 THEN '{k}' END" for k in _TEXT_KEYS)
    return f"""SELECT '{copy}' AS copy, 'timeseries' AS document, 'a date' AS rule, 'timeseries[' || label || '].date' AS place, label AS found FROM {rows} WHERE d IS NULL GROUP BY label, k
UNION ALL SELECT '{copy}', 'timeseries', 'keys', 'timeseries[' || label || '].parties', 'without ' || lost FROM (SELECT label, k, concat_ws(',', {keys}) AS lost FROM {rows} GROUP BY 1, 2) WHERE lost <> ''
UNION ALL SELECT '{copy}', 'timeseries', 'ascending', 'timeseries[' || label || '].parties[' || key || ']', {_FALLS} FROM {rows} WHERE {_FALLS} <> ''
UNION ALL SELECT '{copy}', 'timeseries', 'decimals', 'timeseries[' || label || '].parties[' || key || ']', {_LONG} FROM {rows} WHERE {_LONG} <> ''
UNION ALL SELECT '{copy}', 'timeseries', 'no gaps', 'timeseries[' || CAST(d AS VARCHAR) || ']', 'no next day' FROM (SELECT DISTINCT d FROM {rows} WHERE d IS NOT NULL)
 WHERE d < (SELECT max(d) FROM {rows}) AND d + 1 NOT IN (SELECT d FROM {rows} WHERE d IS NOT NULL)
UNION ALL SELECT '{copy}', 'timeseries', 'count', 'metadata.n_days', CAST(there AS VARCHAR) || ' of ' || CAST(said AS VARCHAR) FROM
 (SELECT (SELECT count(DISTINCT k) FROM {rows}) AS there, (SELECT count(DISTINCT k) FROM sound) AS said) WHERE there <> said"""


_SQL_CHECKS = f"""WITH {S.CTE_POLLS}, {S.CTE_TREND}, {_SQL_LAST},
sound AS (SELECT CAST(day AS VARCHAR) AS label, day AS d, date_diff('day', DATE '{ORIGIN}', day) AS k, key, {', '.join(_QS)} FROM daily),
broken AS (SELECT CASE WHEN k % 401 = 5 THEN 'no date' ELSE label END AS label, CASE WHEN k % 401 <> 5 THEN d END AS d, k, key, q05,
 CASE WHEN key = 'SPD' AND k % 61 = 2 THEN round(median + 0.2, 3) ELSE q10 END AS q10, CASE WHEN key = 'AfD' AND k % 67 = 3 AND NOT (key = 'SPD' AND k % 61 = 2) THEN q25 + 0.0004 ELSE q25 END AS q25,
 median, q75, q90, q95 FROM sound WHERE k % 53 <> 0 AND NOT (key = 'FDP' AND k % 59 = 1)),
shown AS (SELECT strftime(date_published, '%Y-%m-%d') AS date, pollster, dayofyear(date_published) AS y, {_SHARES} FROM valid),
turned AS (SELECT key, CASE WHEN key = 'SPD' THEN 1.5 ELSE median END AS median, row_number() OVER (ORDER BY median, key DESC) - 1 AS no FROM last)
{_sql_days('as published', 'sound')}
UNION ALL {_sql_days('damaged', 'broken')}
UNION ALL SELECT 'damaged', 'timeseries', * FROM (VALUES ('filled', 'metadata.generated_at', ''), ('size', 'metadata.quantiles', '6'), ('matches', 'parties[SPD].color', 'red'), ('populated', 'elections[0].results', '0'))
UNION ALL SELECT 'damaged', 'snapshot', 'required', 'meta.last_poll_date', 'missing'
UNION ALL SELECT copy, 'snapshot', 'size', 'parties', CAST((SELECT count(*) FROM last) AS VARCHAR) FROM (VALUES ('as published'), ('damaged')) c(copy) WHERE (SELECT count(*) FROM last) <> {len(S.KEYS)}
UNION ALL SELECT 'damaged', 'snapshot', 'between', 'parties[' || CAST(no AS VARCHAR) || '].median', '1.5' FROM turned WHERE key = 'SPD'
UNION ALL SELECT 'damaged', 'snapshot', 'required', 'parties[' || CAST(no AS VARCHAR) || '].q05', 'missing' FROM turned WHERE key = 'AfD'
UNION ALL SELECT 'damaged', 'snapshot', 'descending', 'parties', CAST(min(a.no) AS VARCHAR) FROM turned a JOIN turned b ON a.no = b.no + 1 WHERE a.median > b.median HAVING count(*) > 0
UNION ALL SELECT 'damaged', 'polls', 'contains', 'columns', 'without BSW'
UNION ALL SELECT 'damaged', 'polls', 'count', 'n_polls', CAST(n AS VARCHAR) || ' of ' || CAST(n + 1 AS VARCHAR) FROM (SELECT count(*) AS n FROM valid)
UNION ALL SELECT 'damaged', 'polls', 'share', 'polls[' || date || ' ' || pollster || '].CDU_CSU', '7.5' FROM shown WHERE y = 71
UNION ALL SELECT 'damaged', 'polls', 'decimals', 'polls[' || date || ' ' || pollster || ']', 'SPD' FROM shown WHERE y = 72 AND SPD < 0.9"""


@query(_SQL_CHECKS)
def document_rules(spark: SparkSession, sf: str) -> DataFrame:
    """One row per broken rule of the published documents, and of a copy with planted faults."""
    out = S.folder(spark, "published")
    polls, _ = canonical.canonicalize(S.raw_polls(spark, sf), S.as_of(), f"{out}/canonical")
    trend(spark, sf).write.parquet(f"{out}/trend")
    shares = spark.read.parquet(f"{out}/trend")
    publish.export_all(shares, polls, S.results(spark, sf), days_through(shares, "t", ORIGIN), S.PARTIES, 2000, (0, None), S.as_of(), F.lit(NOW), out, origin=ORIGIN)

    def text(path: str) -> DataFrame:
        return spark.read.text(f"{out}/{path}")

    def read(path: str, schema: T.StructType) -> DataFrame:
        return read_json_lines(spark, f"{out}/{path}", schema)

    top = read("polls/header", schemas.POLLS_DOC)
    worse = top.withColumns({"n_polls": F.col("n_polls") + 1, "columns": F.array_remove("columns", "BSW")})
    copies = {
        "as published": [document_checks.timeseries(text("timeseries/header"), text("timeseries/rows"), S.KEYS),
                         document_checks.snapshot(text("snapshot/header"), S.KEYS), document_checks.polls(text("polls/header"), text("polls/rows"), ["BSW"])],
        "damaged": [document_checks.timeseries(_texts(_damaged_header(read("timeseries/header", schemas.TIMESERIES_DOC))),
                                               _texts(_damaged_days(read("timeseries/rows", schemas.TIMESERIES_ROW))), S.KEYS),
                    document_checks.snapshot(_texts(_damaged_snapshot(read("snapshot/header", schemas.CURRENT_DOC))), S.KEYS),
                    document_checks.polls(_texts(worse), _texts(_damaged_polls(read("polls/rows", schemas.POLL_ROW))), ["BSW"])]}
    found = None
    for copy, parts in copies.items():
        for part in parts:
            named = part.select(F.lit(copy).alias("copy"), "*")
            found = named if found is None else found.unionByName(named)
    return found
