"""Canonical polls: harmonise, pivot, hash, deduplicate, validate, reference tables, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pollspark.catalogue.base import (
    AS_OF, CTE_PERIOD, CTE_SHARE, CTE_VOTES, LAST_DAY, ORIGIN, PARTIES, PARTY_IDX, SQL_ELECTIONS,
    SQL_PARTY, SQL_PARTY_IDX, cells, elections, line_parties, long_cells, orders, party_dim,
    party_of, period, period_votes, query, r6, size_of, sql_t, table,
)
from pollspark.functions import hashing
from pollspark.functions.dates import days_open, grid_index, iso, month_floor
from pollspark.functions.numeric import residual_share, row_sum
from pollspark.operators import joins, ordered, quantiles, reshape, rows
from pollspark.plans import checks

MAJORS = ["economy", "large", "medium", "small"]


@query(f"""WITH {CTE_SHARE} SELECT t, party, CAST(y AS BIGINT) AS y, round(s, 6) AS share FROM share""")
def period_share(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled observed share per 14-day period and party."""
    w = Window.partitionBy("t")  # one row per party: bounded by the party list
    return period_votes(spark, sf).select(
        "t", "party", F.col("y").cast("bigint").alias("y"),
        r6(F.col("y") / F.sum("y").over(w)).alias("share"))


@query(f"""SELECT l_orderkey, {SQL_PARTY} AS party, CAST(sum(l_quantity) AS BIGINT) AS votes
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IS NULL OR p_type <> 'LARGE'
GROUP BY 1, 2""")
def harmonise_parties(spark: SparkSession, sf: str) -> DataFrame:
    """Drop a non-vote category, map the labels, sum per poll and party."""
    part = table(spark, sf, "part").where(rows.not_in(F.col("p_type"), ["LARGE"])).select(
        "p_partkey", party_of(F.col("p_type")).alias("party"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        "l_orderkey", "party").agg(F.sum("l_quantity").cast("bigint").alias("votes"))


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = reshape.to_wide_sum(
        line_parties(spark, sf, "l_orderkey", "l_quantity"), ["l_orderkey"], F.col("party"),
        F.col("l_quantity"), PARTIES)
    return reshape.with_missing_columns(wide, ["micro"])


_SQL_WIDE = ", ".join(
    f"sum(CASE WHEN party = '{p}' THEN votes END) AS {p}" for p in PARTIES)


@query(f"""WITH {CTE_VOTES}, w AS (SELECT l_orderkey, {_SQL_WIDE}, sum(votes) AS total
FROM votes GROUP BY 1)
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, economy, large, medium, small, other,
CAST(NULL AS DOUBLE) AS micro, total AS raw_sum,
round(1 - (coalesce(economy,0)+coalesce(large,0)+coalesce(medium,0)+coalesce(small,0)) / total, 6)
 AS residual FROM w JOIN orders ON l_orderkey = o_orderkey""")
def wide_polls(spark: SparkSession, sf: str) -> DataFrame:
    """One row per poll, one column per party, an absent party column, row sum and residual."""
    wide = _wide(spark, sf).withColumn("raw_sum", row_sum([*PARTIES, "micro"]))
    known = wide.withColumns({f"s_{p}": F.col(p) / F.col("raw_sum") for p in MAJORS})
    o = orders(spark, sf)
    return known.join(o, known.l_orderkey == o.o_orderkey).select(
        "o_orderkey", iso("day").alias("day"), *PARTIES, "micro", "raw_sum",
        r6(residual_share([f"s_{p}" for p in MAJORS])).alias("residual"))


@query(f"""WITH {CTE_VOTES} SELECT l_orderkey AS poll, strftime(o_orderdate, '%Y-%m-%d') AS day,
o_orderpriority AS source, party, votes AS vote_share
FROM votes JOIN orders ON l_orderkey = o_orderkey WHERE party <> 'other'""")
def long_polls(spark: SparkSession, sf: str) -> DataFrame:
    """The wide polls as long rows, restricted to an allow-list of parties."""
    o = orders(spark, sf, "o_orderpriority")
    wide = _wide(spark, sf).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("poll"), iso("day").alias("day"),
        F.col("o_orderpriority").alias("source"), *PARTIES)
    return reshape.to_long(wide, ["poll", "day", "source"], PARTIES, "party", "vote_share").where(
        F.col("party").isin(MAJORS) & F.col("vote_share").isNotNull())


@query(f"""WITH {CTE_VOTES}, w AS (SELECT l_orderkey, {_SQL_WIDE} FROM votes GROUP BY 1)
SELECT o_orderkey, sha256(concat_ws('|', o_orderpriority, strftime(o_orderdate, '%Y-%m-%d'),
'NA', 'NA', CAST(CAST(floor(o_totalprice / 100) AS BIGINT) AS VARCHAR),
""" + ", ".join(f"'{p}=' || coalesce(CAST(CAST({p} AS BIGINT) AS VARCHAR), 'none')"
                for p in sorted(PARTIES)) + """)) AS poll_id
FROM w JOIN orders ON l_orderkey = o_orderkey""")
def poll_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Content id of every poll."""
    o = orders(spark, sf, "o_orderpriority", "o_totalprice")
    wide = _wide(spark, sf).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    none = F.lit(None).cast("date")
    return wide.select("o_orderkey", hashing.poll_id(
        F.col("o_orderpriority"), F.col("day"), none, none,
        F.floor(F.col("o_totalprice") / 100), PARTIES).alias("poll_id"))


@query("""SELECT sha256(text) AS content_id, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang,
arg_min(source, doc_id) AS source FROM documents GROUP BY 1""")
def dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    """Content id per document, first row of every id kept; the text itself is not shuffled."""
    docs = table(spark, sf, "documents").select(
        F.sha2("text", 256).alias("content_id"), "doc_id", "lang", "source")
    return rows.keep_first(docs, ["content_id"], ["doc_id"])


@query("""WITH d AS (SELECT doc_id, sha256(text) AS content_id FROM documents),
known AS (SELECT DISTINCT content_id FROM d WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT content_id, min(doc_id) AS doc_id, count(*) AS copies FROM d
WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND content_id NOT IN (SELECT content_id FROM known)
GROUP BY 1""")
def new_rows_only(spark: SparkSession, sf: str) -> DataFrame:
    """Ids not seen before: documents without a label against those that have one."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_id"))
    labels = table(spark, sf, "labels").select("doc_id")
    known = docs.join(labels, "doc_id", "left_semi")
    incoming = docs.join(labels, "doc_id", "left_anti").groupBy("content_id").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return joins.unseen(incoming, known, "content_id")


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("share_sum"),
        F.max("l_shipdate").cast("date").alias("date_end"))
    o = orders(spark, sf, "o_orderpriority", "o_orderstatus", "o_totalprice")
    n = F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 100))
    source = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    joined = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    return joined.select("o_orderkey", rows.rejection_reason(
        F.col("share_sum"), n, F.col("day"), F.date_add("day", 1), F.col("date_end"), source,
        F.lit(AS_OF).cast("date")).alias("rejection_reason"))


_SQL_VALID = f"""l AS (SELECT l_orderkey, sum(l_quantity) AS q, CAST(max(l_shipdate) AS DATE) AS e
 FROM lineitem GROUP BY 1),
p AS (SELECT o_orderkey, q, e, CAST(o_orderdate AS DATE) AS d,
 CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice / 100) AS BIGINT) END AS n,
 CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS src
 FROM orders LEFT JOIN l ON o_orderkey = l_orderkey),
v AS (SELECT o_orderkey, concat_ws('; ',
 CASE WHEN q < 95 OR q > 105 THEN 'V1: vote_share_sum=' || printf('%.1f', q) || ' outside [95,105]' END,
 CASE WHEN n < 500 OR n > 50000 THEN 'V2: n=' || CAST(n AS VARCHAR) || ' outside [500,50000]' END,
 CASE WHEN d > DATE '{AS_OF}' OR d + 1 > e OR e > d + 7 THEN 'V3: date validity check failed' END,
 CASE WHEN src IS NULL THEN 'V5: null in required field (pollster/date_published)' END)
 AS rejection_reason FROM p)"""


@query(f"WITH {_SQL_VALID} SELECT o_orderkey, rejection_reason, rejection_reason = '' AS valid FROM v")
def validate_split(spark: SparkSession, sf: str) -> DataFrame:
    """All failed checks per poll."""
    return _validated(spark, sf).withColumn("valid", F.col("rejection_reason") == "")


@query(f"""WITH {_SQL_VALID}, r AS (SELECT unnest(string_split(rejection_reason, '; ')) AS r FROM v
WHERE rejection_reason <> '') SELECT substr(r, 1, 2) AS "check", count(*) AS n FROM r GROUP BY 1""")
def reject_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """How often every check fired."""
    return rows.reason_counts(_validated(spark, sf).where("rejection_reason <> ''"))


_META = [("1-URGENT", "Urgent desk", "phone"), ("2-HIGH", "High desk", "online"),
         ("3-MEDIUM", "Medium desk", "mixed"), ("4-NOT SPECIFIED", "Open desk", "phone")]


@query(f"""WITH m(pollster, full_name, primary_method) AS (VALUES {', '.join(map(str, _META))}),
s AS (SELECT o_orderpriority AS pollster, count(*) AS n_polls,
 strftime(min(o_orderdate), '%Y-%m-%d') AS first_poll,
 strftime(max(o_orderdate), '%Y-%m-%d') AS last_poll,
 round(quantile_cont(CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 100) END, 0.5), 6)
 AS median_n,
 round(avg(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) * 100, 6) AS pct_n_known,
 max(CAST(o_orderdate AS DATE)) >= DATE '{AS_OF}' - 730 AS active FROM orders GROUP BY 1)
SELECT pollster, full_name, primary_method, active, n_polls, first_poll, last_poll, median_n,
 pct_n_known FROM s LEFT JOIN m USING (pollster)""")
def source_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage per source with its metadata; a source without metadata keeps nulls."""
    o = orders(spark, sf, "o_orderpriority", "o_orderstatus", "o_totalprice").select(
        F.col("o_orderpriority").alias("pollster"), "day",
        F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 100))
        .cast("double").alias("n"))
    stats = quantiles.exact_quantiles(
        o, ["pollster"], "n", [0.5], ["median_n"], size_of(spark, sf, "orders"), extra={
            "n_polls": F.count(F.lit(1)), "first_poll": F.min("day"), "last_poll": F.max("day"),
            "pct_n_known": F.avg(F.col("n").isNotNull().cast("int")) * 100})
    meta = spark.createDataFrame(
        _META, "pollster string, full_name string, primary_method string")
    return (
        stats.join(meta, "pollster", "left")
        .select("pollster", "full_name", "primary_method",
                (F.col("last_poll") >= F.date_sub(F.lit(AS_OF).cast("date"), 730)).alias("active"),
                "n_polls", iso("first_poll").alias("first_poll"), iso("last_poll").alias("last_poll"),
                r6(F.col("median_n")).alias("median_n"), r6(F.col("pct_n_known")).alias("pct_n_known")))


@query(f"""SELECT 'no recent order' AS gap, CAST(c_custkey AS VARCHAR) AS key FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '{AS_OF}' - 365)
UNION ALL SELECT 'no metadata', o_orderpriority FROM (SELECT DISTINCT o_orderpriority FROM orders)
WHERE o_orderpriority NOT IN ({', '.join(repr(m[0]) for m in _META)})""")
def coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Keys without a partner: customers without a recent order, sources without metadata."""
    recent = table(spark, sf, "orders").where(
        F.col("o_orderdate") >= F.date_sub(F.lit(AS_OF).cast("date"), 365)).select(
        F.col("o_custkey").alias("c_custkey"))
    gaps = joins.missing_keys(table(spark, sf, "customer"), recent, ["c_custkey"]).select(
        F.col("c_custkey").cast("string").alias("key"))
    sources = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("key")).distinct()
    meta = spark.createDataFrame(_META, "key string, full_name string, primary_method string")
    unknown = sources.join(meta, "key", "left").where(F.col("full_name").isNull()).select("key")
    return reshape.tagged_union({"no recent order": gaps, "no metadata": unknown}, "gap")


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000),
b AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
SELECT 'only left' AS part, k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
UNION ALL SELECT 'only right', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a)
UNION ALL SELECT 'both', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'any', k FROM (SELECT k FROM a UNION SELECT k FROM b)
UNION ALL SELECT 'equal', CAST((SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) = 0
 AND (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) = 0 AS INTEGER)""")
def set_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Difference, intersection, union and equality of two key sets."""
    a = table(spark, sf, "customer").where("c_acctbal > 9000").select(
        F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    left, right = a.subtract(b), b.subtract(a)
    equal = left.union(right).agg((F.count(F.lit(1)) == 0).cast("int").alias("k"))
    return reshape.tagged_union({
        "only left": left, "only right": right, "both": a.intersect(b),
        "any": a.union(b).distinct(), "equal": equal}, "part")


@query(f"""SELECT strftime(election_date, '%Y-%m-%d') AS election_date, count(o_orderkey) AS n_polls
FROM {SQL_ELECTIONS} LEFT JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN election_date - 30
AND election_date GROUP BY 1""")
def polls_before_election(spark: SparkSession, sf: str) -> DataFrame:
    """Polls of the 30 days up to each election."""
    out = joins.counts_before(orders(spark, sf), "day", elections(spark), "election_date", 30,
                              name="n_polls")
    return out.withColumn("election_date", iso("election_date"))


@query(f"""WITH {CTE_VOTES}, p AS (SELECT l_orderkey,
string_agg(party, ' | ' ORDER BY {SQL_PARTY_IDX}) AS pattern, count(*) AS n_parties FROM votes
WHERE votes > 0 GROUP BY 1)
SELECT pattern, n_parties, count(*) AS n_polls FROM p GROUP BY 1, 2""")
def party_presence(spark: SparkSession, sf: str) -> DataFrame:
    """How many polls show each set of parties."""
    return _patterns(spark, sf).groupBy("pattern", F.size("party_idx").cast("bigint").alias("n_parties")).agg(
        F.count(F.lit(1)).alias("n_polls"))


@query(f"""WITH {CTE_VOTES}, ok AS (SELECT l_orderkey FROM votes WHERE party <> 'other' AND votes > 0
GROUP BY 1 HAVING count(*) = 4)
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM ok)""")
def viable_polls(spark: SparkSession, sf: str) -> DataFrame:
    """Polls that report every major party."""
    lines = line_parties(spark, sf, "l_orderkey", "l_quantity")
    ids = rows.viable_ids(lines, "l_orderkey", "party", "l_quantity", MAJORS)
    o = orders(spark, sf, "o_orderpriority")
    return o.join(ids, o.o_orderkey == ids.l_orderkey, "left_semi").select(
        "o_orderkey", iso("day").alias("day"), "o_orderpriority")


@query(f"""WITH {CTE_VOTES}, w AS (SELECT l_orderkey, {_SQL_WIDE}, sum(votes) AS total,
 count(CASE WHEN party <> 'other' AND votes > 0 THEN 1 END) AS k FROM votes GROUP BY 1),
c AS (SELECT {sql_t('o_orderdate')} AS t, floor(o_totalprice / 100) AS n, total, """
       + ", ".join(f"coalesce({p}, 0) / total * 100 AS {p}" for p in PARTIES) + """
FROM w JOIN orders ON l_orderkey = o_orderkey WHERE k = 4 AND floor(o_totalprice / 100) > 0)
SELECT t, count(*) AS n_polls, """
       + ", ".join(f"CAST(sum(floor({p} / 100 * n)) AS BIGINT) AS {p}" for p in PARTIES) + """
FROM c GROUP BY 1""")
def zero_fill_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Model input: viable polls, missing parties as 0, shares as counts, summed per period."""
    wide = _wide(spark, sf).drop("micro").withColumn("total", row_sum(PARTIES))
    viable = F.lit(True)
    for p in MAJORS:
        viable = viable & F.coalesce(F.col(p) > 0, F.lit(False))
    o = orders(spark, sf, "o_totalprice")
    n = F.floor(F.col("o_totalprice") / 100)
    joined = wide.where(viable).join(o, F.col("l_orderkey") == F.col("o_orderkey")).where(n > 0)
    counts = joined.fillna(0.0, PARTIES).select(
        grid_index(F.col("day"), ORIGIN).alias("t"),
        *[F.floor(F.col(p) / F.col("total") * 100 / 100 * n).cast("bigint").alias(p)
          for p in PARTIES])
    complete = counts.dropna(subset=PARTIES).where(row_sum(PARTIES) > 0)
    return complete.groupBy("t").agg(
        F.count(F.lit(1)).alias("n_polls"), *[F.sum(p).alias(p) for p in PARTIES])


def calendar(spark: SparkSession, sf: str, start: str = ORIGIN, end: str = LAST_DAY) -> DataFrame:
    """Days up to the last poll, ``end`` at least, with their 14- and 28-day units (restarting every month) and running indexes."""
    days = days_open(spark, start, end, orders(spark, sf), F.col("day")).select(
        "date", month_floor(F.col("date"), 14).alias("layer1"),
        month_floor(F.col("date"), 28).alias("layer2"))
    # Calendar-sized: a few units per month.
    l1 = joins.sorted_positions(days, "layer1", "layer1_idx")
    l2 = joins.sorted_positions(days, "layer2", "layer2_idx")
    return days.join(l1, "layer1").join(l2, "layer2")


_SQL_CAL = f"""d AS (SELECT CAST(unnest(generate_series(DATE '{ORIGIN}', greatest(DATE '{LAST_DAY}', (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)),
 INTERVAL 1 DAY)) AS DATE) AS date),
u AS (SELECT date, CAST(date_trunc('month', date) AS DATE) + CAST(floor((day(date) - 1) / 14.0) AS INTEGER) * 14 AS layer1,
 CAST(date_trunc('month', date) AS DATE) + CAST(floor((day(date) - 1) / 28.0) AS INTEGER) * 28 AS layer2 FROM d),
cal AS (SELECT date, layer1, layer2, dense_rank() OVER (ORDER BY layer1) AS layer1_idx,
 dense_rank() OVER (ORDER BY layer2) AS layer2_idx FROM u)"""


@query(f"""WITH {_SQL_CAL} SELECT strftime(date, '%Y-%m-%d') AS day,
strftime(layer1, '%Y-%m-%d') AS layer1, CAST(layer1_idx AS BIGINT) AS layer1_idx,
CAST(layer2_idx AS BIGINT) AS layer2_idx, count(*) AS n_polls
FROM orders JOIN cal ON CAST(o_orderdate AS DATE) = date GROUP BY 1, 2, 3, 4""")
def month_floor_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Polls per day with both calendar layers; polls are counted before the calendar join."""
    daily = orders(spark, sf).groupBy(F.col("day").alias("date")).agg(
        F.count(F.lit(1)).alias("n_polls"))
    return daily.join(calendar(spark, sf), "date").select(
        iso("date").alias("day"), iso("layer1").alias("layer1"),
        F.col("layer1_idx").cast("bigint").alias("layer1_idx"),
        F.col("layer2_idx").cast("bigint").alias("layer2_idx"), "n_polls")


@query(f"""WITH {_SQL_CAL}, o AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n_polls
FROM orders GROUP BY 1) SELECT strftime(cal.date, '%Y-%m-%d') AS day,
CAST(layer1_idx AS BIGINT) AS layer1_idx, n_polls FROM o RIGHT JOIN cal ON o.date = cal.date""")
def calendar_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every calendar day, also those without a poll."""
    daily = orders(spark, sf).groupBy(F.col("day").alias("date")).agg(
        F.count(F.lit(1)).alias("n_polls"))
    return daily.join(calendar(spark, sf), "date", "right").select(
        iso("date").alias("day"), F.col("layer1_idx").cast("bigint").alias("layer1_idx"), "n_polls")


@query(f"""WITH {_SQL_CAL}, e AS (SELECT o_orderpriority AS source,
CAST(min(o_orderdate) AS DATE) - 1 AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY 1)
SELECT source, coalesce(CAST(a.layer1_idx AS BIGINT), -99) AS idx_start,
coalesce(CAST(b.layer1_idx AS BIGINT), -99) AS idx_end,
CAST(a.date IS NULL AS INTEGER) AS always_entered, CAST(b.date IS NULL AS INTEGER) AS never_exited
FROM e LEFT JOIN cal a ON e.s = a.date LEFT JOIN cal b ON e.e = b.date""")
def era_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Start and end of every source as calendar indexes, flagged where outside the calendar."""
    eras = orders(spark, sf, "o_orderpriority").groupBy(F.col("o_orderpriority").alias("source")).agg(
        F.date_sub(F.min("day"), 1).alias("start_date"), F.max("day").alias("end_date"))
    out = joins.era_index(eras, calendar(spark, sf), "layer1_idx")
    missing = F.lit(-99).cast("bigint")
    return out.select(
        "source", F.coalesce(F.col("idx_start").cast("bigint"), missing).alias("idx_start"),
        F.coalesce(F.col("idx_end").cast("bigint"), missing).alias("idx_end"),
        "always_entered", "never_exited")


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d,
CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE floor(o_totalprice / 100) END AS n FROM orders)
SELECT o_orderkey, round(coalesce(n, (SELECT avg(n) FROM o)), 6) AS n FROM o
WHERE d > DATE '1996-01-01' AND d < DATE '2001-01-01'""")
def impute_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Zero sizes take the mean over all rows; the date filter comes after."""
    o = orders(spark, sf, "o_orderpriority", "o_totalprice").select(
        "o_orderkey", "day", F.when(F.col("o_orderpriority") == "5-LOW", 0.0).otherwise(
            F.floor(F.col("o_totalprice") / 100)).alias("n"))
    day = F.col("day")
    return rows.impute_mean(o, "n").where((day > "1996-01-01") & (day < "2001-01-01")).select(
        "o_orderkey", r6(F.col("n")).alias("n"))


def _patterns(spark: SparkSession, sf: str) -> DataFrame:
    lines = line_parties(spark, sf, "l_orderkey", "l_quantity").where("l_quantity > 0")
    return reshape.reporting_pattern(lines, "l_orderkey", "party", PARTY_IDX)


_SQL_PAT = f"""{CTE_VOTES}, pat AS (SELECT l_orderkey,
string_agg(party, ' | ' ORDER BY {SQL_PARTY_IDX}) AS pattern FROM votes WHERE votes > 0 GROUP BY 1),
srv AS (SELECT l_orderkey, pattern, row_number() OVER (ORDER BY pattern, l_orderkey) AS idx FROM pat)"""


@query(f"""WITH {_SQL_PAT} SELECT pattern, """
       + ", ".join(f"CAST(contains(pattern, '{p}') AS INTEGER) AS has_{p}" for p in PARTIES)
       + """, count(*) AS n_polls, CAST(min(idx) AS BIGINT) AS first_idx,
CAST(max(idx) AS BIGINT) AS last_idx FROM srv GROUP BY pattern""")
def reporting_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns with flags and the range of survey numbers they cover.

    Surveys are numbered by (pattern, id), so a pattern's range follows from the counts alone and
    no row of the table is numbered.
    """
    per = _patterns(spark, sf).groupBy("pattern", *[f"has_{p}" for p in PARTIES]).agg(
        F.count(F.lit(1)).alias("n_polls"))
    w = Window.orderBy("pattern")  # at most one row per subset of the parties
    return per.withColumn("last_idx", F.sum("n_polls").over(
        w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "first_idx", F.col("last_idx") - F.col("n_polls") + 1)


@query(f"""WITH {_SQL_PAT} SELECT party, l_orderkey AS poll, CAST(idx AS BIGINT) AS survey_idx,
CAST(row_number() OVER (PARTITION BY party ORDER BY idx) AS BIGINT) AS position
FROM srv JOIN votes USING (l_orderkey) WHERE votes > 0""")
def presence_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Which surveys report a party, as numbered positions instead of a padded matrix.

    Survey numbers run over the whole table and positions over all surveys of a party, so both
    are binned scans; a list per party would not fit one task.
    """
    n = size_of(spark, sf, "lineitem")  # every poll and every listed party has a line
    srv = ordered.number_rows(_patterns(spark, sf).select("l_orderkey", "pattern", "party_idx"),
                              [], ["pattern", "l_orderkey"], "survey_idx", n)
    names = F.array(*[F.lit(p) for p in PARTIES])
    listed = srv.select(
        "survey_idx", F.col("l_orderkey").alias("poll"),
        F.explode(F.transform("party_idx", lambda i: F.element_at(names, i))).alias("party"))
    return ordered.number_rows(listed, ["party"], ["survey_idx"], "position", n)


@query(f"""WITH x AS (SELECT l_suppkey AS source, CAST(l_discount AS DECIMAL(10,6)) AS v FROM lineitem
UNION ALL SELECT -1 - l_suppkey, CAST(l_quantity AS DECIMAL(10,6)) FROM lineitem),
d AS (SELECT DISTINCT source, v - floor(v) AS d FROM x),
g AS (SELECT source, d, CASE WHEN lag(d) OVER (PARTITION BY source ORDER BY d) > 0
 THEN d - lag(d) OVER (PARTITION BY source ORDER BY d) END AS gap FROM d),
s AS (SELECT source, count(CASE WHEN d > 0 THEN 1 END) AS k,
 CASE WHEN count(CASE WHEN d > 0 THEN 1 END) = 0 THEN 1
 WHEN count(CASE WHEN d > 0 THEN 1 END) = 1 THEN max(d) ELSE min(gap) END AS step FROM g GROUP BY 1)
SELECT source, CASE WHEN max(k) <= 1 OR bool_and(abs(round(CAST(d AS DOUBLE) / CAST(step AS DOUBLE))
 - CAST(d AS DOUBLE) / CAST(step AS DOUBLE)) < 0.0005) THEN CAST(max(step) AS DOUBLE) END AS rounding
FROM d JOIN s USING (source) GROUP BY 1""")
def rounding_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Rounding step of every source, for a fractional and a whole measure."""
    lines = table(spark, sf, "lineitem")
    both = lines.select(F.col("l_suppkey").alias("source"), F.col("l_discount").alias("v")).union(
        lines.select(-1 - F.col("l_suppkey"), F.col("l_quantity")))
    return rows.rounding_interval(both, "source", "v")


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, {sql_t('o_orderdate')} AS t
FROM orders), m AS (SELECT max(d) AS md, max(t) AS mt FROM o)
SELECT o_orderkey, t, t <= 150 AS is_fit, t = mt AS is_latest FROM o, m
WHERE d < md - 120 OR t = mt""")
def holdout_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rows before the hold-out, and the rows of the latest period, with an in-fit flag."""
    o = orders(spark, sf).select("o_orderkey", "day", grid_index(F.col("day"), ORIGIN).alias("t"))
    early = joins.before_cutoff(o, "day", 120).withColumn("is_latest", F.lit(False))
    latest = joins.latest_only(o, "t").withColumn("is_latest", F.lit(True))
    return early.unionByName(latest).select(
        "o_orderkey", "t", (F.col("t") <= 150).alias("is_fit"), "is_latest")


@query(f"""SELECT strftime(election_date, '%Y-%m-%d') AS election_date FROM {SQL_ELECTIONS},
(SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders
 WHERE o_orderstatus = 'F' AND o_orderdate < DATE '2000-01-01') WHERE election_date BETWEEN lo AND hi""")
def within_span(spark: SparkSession, sf: str) -> DataFrame:
    """Elections inside the date span of the polls."""
    o = orders(spark, sf, "o_orderstatus").where(
        (F.col("o_orderstatus") == "F") & (F.col("day") < "2000-01-01"))
    return joins.within_span(elections(spark), "election_date", o, "day").select(
        iso("election_date").alias("election_date"))


@query(f"""WITH {CTE_PERIOD}, e AS (SELECT DISTINCT {sql_t('election_date')} AS t FROM {SQL_ELECTIONS}),
k AS (SELECT DISTINCT t FROM period UNION SELECT t FROM e),
p AS (SELECT t, CAST(row_number() OVER (ORDER BY t) AS BIGINT) AS position FROM k)
SELECT t, position, (SELECT sum(y) FROM period WHERE period.t = p.t) AS y,
t IN (SELECT t FROM e) AS is_election FROM p""")
def key_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Observed and election periods in one sorted key list, with lookups into it."""
    y = cells(spark, sf, period()).select("t", row_sum(PARTIES).alias("y"))
    e = elections(spark).select(
        grid_index(F.col("election_date"), ORIGIN).alias("t"), F.lit(True).alias("is_election"))
    keys = y.unionByName(e, allowMissingColumns=True).groupBy("t").agg(
        F.sum("y").alias("y"), F.coalesce(F.max("is_election"), F.lit(False)).alias("is_election"))
    w = Window.orderBy("t")  # one row per period
    return keys.withColumn("position", F.row_number().over(w).cast("bigint"))


@query(f"""WITH {CTE_SHARE}, y AS (SELECT year(o_orderdate) AS y, o_orderkey FROM orders),
v AS (SELECT y AS election_year, party, sum(votes) AS votes FROM votes JOIN y ON l_orderkey = o_orderkey
 GROUP BY 1, 2), w AS (SELECT election_year, sum(votes) AS valid_votes, """
       + ", ".join(f"sum(CASE WHEN party = '{p}' THEN votes END) AS {p}" for p in PARTIES)
       + """ FROM v GROUP BY 1)
SELECT election_year, CAST(valid_votes AS BIGINT) AS valid_votes,
round((economy + large) / valid_votes, 6) AS union_share,
CASE WHEN election_year >= 1998 THEN round(medium / valid_votes, 6) END AS medium_share,
round(small / valid_votes, 6) AS small_share,
round(1 - (economy + large + CASE WHEN election_year >= 1998 THEN medium ELSE 0 END + small) / valid_votes, 6)
 AS residual FROM w""")
def election_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Votes per year, two parties merged, one absent before its founding, the rest as residual."""
    wide = cells(spark, sf, F.year("day").cast("bigint").alias("election_year")).withColumn(
        "valid", row_sum(PARTIES))
    shares = wide.select(
        "election_year", F.col("valid").cast("bigint").alias("valid_votes"),
        ((F.col("economy") + F.col("large")) / F.col("valid")).alias("u"),
        F.when(F.col("election_year") >= 1998, F.col("medium") / F.col("valid")).alias("m"),
        (F.col("small") / F.col("valid")).alias("s"))
    return shares.select(
        "election_year", "valid_votes", r6(F.col("u")).alias("union_share"),
        r6(F.col("m")).alias("medium_share"), r6(F.col("s")).alias("small_share"),
        r6(residual_share(["u", "m", "s"])).alias("residual"))


@query(f"""WITH {CTE_VOTES}, g AS (SELECT election_date, party FROM {SQL_ELECTIONS},
(VALUES ('economy'), ('large'), ('medium'), ('small'), ('other')) p(party)),
v AS (SELECT CAST(o_orderdate AS DATE) AS d, party, sum(votes) AS y FROM votes
 JOIN orders ON l_orderkey = o_orderkey WHERE party <> 'small' OR o_orderdate >= DATE '1998-01-01'
 GROUP BY 1, 2),
x AS (SELECT election_date, g.party, coalesce(sum(y), 0) AS y FROM g LEFT JOIN v
 ON v.d = g.election_date AND v.party = g.party GROUP BY 1, 2),
s AS (SELECT *, coalesce(y / nullif(sum(y) OVER (PARTITION BY election_date), 0), 0) AS p FROM x),
e AS (SELECT *, CASE WHEN p = 0 THEN 0.001 ELSE p END AS q FROM s)
SELECT strftime(election_date, '%Y-%m-%d') AS election_date, party,
round(q / sum(q) OVER (PARTITION BY election_date), 6) AS e_vote FROM e""")
def election_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Election × party grid, zeros lifted to a small share, rows scaled to 1."""
    grid = elections(spark).select(
        "election_date", F.explode(F.array(*[F.lit(p) for p in PARTIES])).alias("party"))
    o = orders(spark, sf).join(elections(spark), F.col("day") == F.col("election_date"),
                               "left_semi")
    # The orders of a few days come first, so that only their lines meet the parts.
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(
        o, F.col("l_orderkey") == F.col("o_orderkey"))
    day = lines.join(party_dim(spark, sf), F.col("l_partkey") == F.col("p_partkey")).where(
        (F.col("party") != "small") | (F.col("day") >= "1998-01-01")).groupBy(
        F.col("day").alias("election_date"), "party").agg(F.sum("l_quantity").alias("y"))
    w = Window.partitionBy("election_date")
    x = grid.join(day, ["election_date", "party"], "left").fillna(0.0, ["y"])
    share = x.withColumn("p", F.coalesce(
        F.try_divide(F.col("y"), F.sum("y").over(w)), F.lit(0.0)))
    lifted = share.withColumn("q", F.when(F.col("p") == 0, 0.001).otherwise(F.col("p")))
    return lifted.select(iso("election_date").alias("election_date"), "party",
                         r6(F.col("q") / F.sum("q").over(w)).alias("e_vote"))


@query(f"""WITH {CTE_VOTES}, o AS (SELECT o_orderkey, {sql_t('o_orderdate')} AS t, o_orderpriority
 AS source FROM orders), x AS (SELECT t, source, sum(CASE WHEN party = 'economy' THEN votes END) /
 sum(votes) AS r, sum(votes) AS n FROM votes JOIN o ON l_orderkey = o_orderkey GROUP BY 1, 2),
m AS (SELECT t, sum(coalesce(r, 0) * n) / sum(n) AS mean_r FROM x GROUP BY 1),
h AS (SELECT source, avg(coalesce(r, 0) - mean_r) AS h, count(*) AS n_units FROM x JOIN m USING (t)
 GROUP BY 1),
u AS (SELECT t, count(*) AS s FROM x GROUP BY 1),
sh AS (SELECT source, count(CASE WHEN s > 1 THEN 1 END) AS n_shared_units FROM x JOIN u USING (t)
 GROUP BY 1)
SELECT source, round(h - (SELECT avg(h) FROM h), 6) AS house_effect, n_units, n_shared_units
FROM h JOIN sh USING (source)""")
def house_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Mean deviation of every source from the period mean, centred, with its overlap."""
    x = cells(spark, sf, period(), F.col("o_orderpriority").alias("source"))
    x = x.withColumn("n", row_sum(PARTIES)).withColumn(
        "r", F.coalesce("economy", F.lit(0.0)) / F.col("n"))
    return checks.house_effects(x, "source", "t", "r", "n").withColumn(
        "house_effect", r6(F.col("house_effect")))


@query(f"""WITH {CTE_VOTES}, f(grp, party, reported) AS (VALUES ('1-URGENT', 'small', 0),
 ('2-HIGH', 'small', 0), ('2-HIGH', 'medium', 0), ('3-MEDIUM', 'small', 1)),
x AS (SELECT o_orderpriority AS grp, {sql_t('o_orderdate')} AS t, party, sum(votes) AS y
 FROM votes JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)
SELECT grp, t, CASE WHEN coalesce(reported, 1) = 0 THEN 'other' ELSE x.party END AS party,
CAST(sum(y) AS BIGINT) AS y FROM x LEFT JOIN f USING (grp, party) GROUP BY 1, 2, 3""")
def residual_redirect(spark: SparkSession, sf: str) -> DataFrame:
    """Votes of parties that a source does not report move to the residual."""
    flags = spark.createDataFrame(
        [("1-URGENT", "small", 0), ("2-HIGH", "small", 0), ("2-HIGH", "medium", 0),
         ("3-MEDIUM", "small", 1)], "grp string, party string, reported int")
    x = long_cells(cells(spark, sf, period(), F.col("o_orderpriority").alias("grp")))
    return joins.redirect_residual(x, flags, ["grp"], "party", "y", "other", ["grp", "t"]).select(
        "grp", "t", "party", F.col("y").cast("bigint").alias("y"))
