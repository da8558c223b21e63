"""Raw polls, results and draws in the published data model, made from the driver's tables.

An order is a poll of its priority's source, its lines are the votes, and part types carry party labels. Every
thirteenth poll stands twice under another id, every fifth has a row that is no vote, every seventeenth adds up to
too much, every eleventh ends too late, and the lowest priority loses its source in every seventh poll, so that each
step of the jobs in ``plans`` has something to do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pollspark import dims
from pollspark.catalogue.base import AS_OF, ELECTIONS, ORIGIN, sql_t, table
from pollspark.functions.dates import grid_index, iso
from pollspark.plans import canonical
from pollspark.schemas import PARTY_COLS
from pollspark.session import shared_dir

# Fixed values of the stand-in data.
LABELS = {"ECONOMY": "CDU/CSU", "LARGE": "SPD", "MEDIUM": "GRÜNE", "PROMO": "FDP", "SMALL": "AfD", "STANDARD": "LINKE"}
PARTIES = list(LABELS.values())
KEYS = [key for _, label, key, _ in dims.PARTIES if label in PARTIES]
COLUMNS = {label: col for col, label, _, _ in dims.PARTIES}
NO_VOTE = "Nichtwähler/Unentschl."
END_YEAR = {int(d[:4]): d for d in ELECTIONS}


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def once(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder, in folders of ``by`` if given, for several readers."""
    path = folder(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def label(p_type: Column) -> Column:
    return dims.map_lookup(LABELS, p_type, F.lit("Sonstige"))


def labelled_lines(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", label(F.col("p_type")).alias("party"))
    lines = table(spark, sf, "lineitem").select("l_partkey", *cols)
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(*cols, "party")


def raw_polls(spark: SparkSession, sf: str) -> DataFrame:
    """Long raw rows of every poll, as the files of the sources hold them."""
    votes = labelled_lines(spark, sf, "l_orderkey", "l_quantity").groupBy("l_orderkey", "party").agg(F.sum("l_quantity").alias("q"))
    total = F.sum("q").over(Window.partitionBy("l_orderkey"))  # a row per party
    points = F.when(F.col("l_orderkey") % 17 == 0, 1200).otherwise(1000)
    share = F.expr("CAST(points * q AS BIGINT) div CAST(total AS BIGINT)") / 10.0
    shares = votes.withColumn("total", total).withColumn("points", points).select("l_orderkey", "party", share.alias("vote_share"))
    odd = F.when((F.col("party") == "LINKE") & (F.col("l_orderkey") % 2 == 1), "PDS").otherwise(F.col("party"))
    aside = table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(NO_VOTE).alias("party"), F.lit(30.0).alias("vote_share"))
    rows = shares.withColumn("party", odd).unionByName(aside)
    day, key, size = F.col("o_orderdate").cast("date"), F.col("o_orderkey"), F.col("o_custkey") % 500 * 10 + 300
    code = F.when(F.col("o_orderstatus") == "P", "T").when(F.col("o_orderstatus") == "F", "O").otherwise("?")
    polls = table(spark, sf, "orders").select(
        key, day.alias("publishing_date"), F.concat_ws(" • ", code, size.cast("string")).alias("Befragte"),
        F.date_format(day, "dd.MM.").alias("Zeitraum"), F.lit(None).cast("string").alias("mode"), size.cast("double").alias("survey_count"),
        F.date_sub(day, 4).alias("sampling_start_day"), F.date_add(day, F.when(key % 11 == 0, 11).otherwise(-1)).alias("sampling_end_day"),
        F.when(~((F.col("o_orderpriority") == "5-LOW") & (key % 7 == 0)), F.col("o_orderpriority")).alias("pollster"), F.lit("current").alias("source_file"))
    copies = F.explode(F.when(key % 13 == 0, F.array(F.lit("u"), F.lit("v"))).otherwise(F.array(F.lit("u"))))
    named = polls.select("*", copies.alias("copy")).withColumn("uuid", F.concat("copy", F.col("o_orderkey").cast("string"))).drop("copy")
    return named.join(rows, F.col("o_orderkey") == F.col("l_orderkey")).drop("o_orderkey", "l_orderkey")


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def valid_polls(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical polls that pass all checks."""
    return canonical.split(canonical.checked(raw_polls(spark, sf), as_of()))[0]


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of all votes of a year as the result of that year's election."""
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("election_year"))
    lines = labelled_lines(spark, sf, "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(
        *[F.sum(F.when(F.col("party") == p, F.col("l_quantity"))).alias(COLUMNS[p]) for p in PARTIES], F.sum("l_quantity").alias("total"))
    votes = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("election_year").agg(*[F.sum(c).alias(c) for c in [*map(COLUMNS.get, PARTIES), "total"]])
    held = spark.createDataFrame(list(END_YEAR.items()), "election_year int, d string").select("election_year", F.to_date("d").alias("election_date"))
    shares = [F.round(F.col(COLUMNS[p]) / F.col("total"), 6).alias(COLUMNS[p]) for p in PARTIES]
    empty = [F.lit(None).cast("double").alias(c) for c in PARTY_COLS if c not in map(COLUMNS.get, PARTIES)]
    return votes.join(held, "election_year").select("election_year", "election_date", *shares, *empty).select("election_year", "election_date", *PARTY_COLS)


def draws(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Line items as draws (i: period, j: party number, value)."""
    lines = labelled_lines(spark, sf, "l_shipdate", "l_extendedprice", *cols)
    number = dims.map_lookup({p: str(n + 1) for n, p in enumerate(PARTIES)}, F.col("party")).cast("int")
    return lines.select(grid_index(F.col("l_shipdate").cast("date"), ORIGIN).alias("i"), number.alias("j"),
                        (F.col("l_extendedprice") / 100000).alias("value"), *cols).where("j IS NOT NULL")


# ---- The same in SQL -----------------------------------------------------------------------

SQL_LABEL = "CASE p_type " + " ".join(f"WHEN '{t}' THEN '{p}'" for t, p in LABELS.items()) + " ELSE 'Sonstige' END"
SQL_KEY = "CASE party " + " ".join(f"WHEN '{p}' THEN '{key}'" for _, p, key, _ in dims.PARTIES) + " END"
_USED = [COLUMNS[p] for p in PARTIES]

CTE_LINES = f"lines AS (SELECT l_orderkey, {SQL_LABEL} AS party, l_quantity, l_shipdate, l_extendedprice, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey)"
_NUMBER = "regexp_replace(regexp_replace(printf('%.13f', {0}), '0+$', ''), '\\.$', '')"
# One row per poll id: party columns in percent, its number of polls; bsw and sonstige are null on this data.
CTE_POLLS = CTE_LINES + f""", votes AS (SELECT l_orderkey, party, sum(l_quantity) AS q FROM lines GROUP BY 1, 2),
shares AS (SELECT l_orderkey, party, (CAST(CASE WHEN l_orderkey % 17 = 0 THEN 1200 ELSE 1000 END * q AS BIGINT)
 // CAST(sum(q) OVER (PARTITION BY l_orderkey) AS BIGINT)) / 10.0 AS s FROM votes),
wide AS (SELECT l_orderkey, {', '.join(f"max(CASE WHEN party = '{p}' THEN s END)::DOUBLE AS {COLUMNS[p]}" for p in PARTIES)},
 max(CASE WHEN party = 'Sonstige' THEN s END)::DOUBLE AS sonstige FROM shares GROUP BY 1),
polled AS (SELECT o_orderkey, CASE WHEN NOT (o_orderpriority = '5-LOW' AND o_orderkey % 7 = 0) THEN o_orderpriority END AS pollster,
 CAST(o_orderdate AS DATE) AS date_published, CAST(o_orderdate AS DATE) - 4 AS date_start,
 CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 11 = 0 THEN 11 ELSE -1 END AS date_end, CAST(o_custkey % 500 * 10 + 300 AS INTEGER) AS n,
 CASE o_orderstatus WHEN 'P' THEN 'phone' WHEN 'F' THEN 'online' ELSE 'unknown' END AS method,
 {', '.join(_USED)}, CAST(NULL AS DOUBLE) AS bsw, sonstige,
 {' + '.join(f'coalesce({c}, 0)' for c in [*_USED, 'sonstige'])} AS raw_sum FROM orders JOIN wide ON l_orderkey = o_orderkey),
named AS (SELECT *, sha256(concat_ws('|', coalesce(pollster, 'NA'), strftime(date_published, '%Y-%m-%d'), strftime(date_start, '%Y-%m-%d'),
 strftime(date_end, '%Y-%m-%d'), CAST(n AS VARCHAR), {', '.join(f"'{c}=' || coalesce({_NUMBER.format(c)}, 'none')" for c in sorted(PARTY_COLS))})) AS poll_id FROM polled),
polls AS (SELECT *, concat_ws('; ', CASE WHEN raw_sum < 95 OR raw_sum > 105 THEN 'V1: vote_share_sum=' || printf('%.1f', raw_sum) || ' outside [95,105]' END,
 CASE WHEN n < 500 OR n > 50000 THEN 'V2: n=' || CAST(n AS VARCHAR) || ' outside [500,50000]' END,
 CASE WHEN date_published > DATE '{AS_OF}' OR date_start > date_end OR date_end > date_published + 7 THEN 'V3: date validity check failed' END,
 CASE WHEN pollster IS NULL THEN 'V5: null in required field (pollster/date_published)' END) AS rejection_reason
 FROM named QUALIFY row_number() OVER (PARTITION BY poll_id ORDER BY CAST(o_orderkey AS VARCHAR)) = 1),
valid AS (SELECT * FROM polls WHERE rejection_reason = '')"""
CTE_RESULTS = f"""ends(election_year, election_date) AS (VALUES {', '.join(f"({y}, DATE '{d}')" for y, d in END_YEAR.items())}),
results AS (SELECT election_year, any_value(election_date) AS election_date, {', '.join(f"round(sum(CASE WHEN party = '{p}' THEN l_quantity END) / sum(l_quantity), 6) AS {COLUMNS[p]}" for p in PARTIES)}
 FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN ends ON election_year = year(o_orderdate) GROUP BY 1)"""
CTE_TREND = f"""draws AS (SELECT {sql_t('l_shipdate')} AS t, party, l_extendedprice / 100000 AS value FROM lines WHERE party <> 'Sonstige'),
trend AS (SELECT t, party, {', '.join(f'quantile_cont(value, {q}) AS {k}' for q, k in zip(dims.QUANTILE_LEVELS, dims.QUANTILE_KEYS))} FROM draws GROUP BY 1, 2),
rounded AS (SELECT t, {SQL_KEY} AS key, party, {', '.join(f'round_even(round({k}, 9), 3) AS {k}' for k in dims.QUANTILE_KEYS)} FROM trend),
days AS (SELECT CAST(unnest(generate_series(DATE '{ORIGIN}', DATE '{ORIGIN}' + CAST((SELECT max(t) FROM trend) AS INTEGER) * 14 - 1, INTERVAL 1 DAY)) AS DATE) AS day),
daily AS (SELECT day, key, {', '.join(dims.QUANTILE_KEYS)} FROM days JOIN rounded ON t = {sql_t('day')})"""


def as_text(polls: DataFrame) -> DataFrame:
    """Dates as texts and sums rounded, for comparison."""
    return polls.withColumns({c: iso(c) for c in ("date_published", "date_start", "date_end")})
