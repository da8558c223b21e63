"""Text, dates, filters, labels, profiles and selections on the plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pollspark.catalogue.base import (
    AS_OF, CTE_SHARE, ORIGIN, orders, period_votes, query, r6, size_of, sql_t, table,
)
from pollspark.dims import map_lookup
from pollspark.functions import dates, hashing, numeric as N, text as X
from pollspark.functions.dates import iso
from pollspark.operators import joins, ordered, reshape, rows

# Cell texts as a poll page has them, built from the orders.
_N = "CAST(floor(o_totalprice / 100) AS INT)"
_THOUSANDS = f"concat(CAST(floor({_N} / 1000) AS INT), '.', lpad(CAST({_N} % 1000 AS STRING), 3, '0'))"
_RAW = {
    "befragte": f"""CASE o_orderpriority WHEN '1-URGENT' THEN concat('T• ', {_THOUSANDS})
      WHEN '2-HIGH' THEN concat('O • ', {_THOUSANDS}) WHEN '3-MEDIUM' THEN concat('TOM• ', {_THOUSANDS})
      WHEN '4-NOT SPECIFIED' THEN concat('?.', lpad(CAST({_N} % 1000 AS STRING), 3, '0'))
      ELSE '?' END""",
    "published": """CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'n. a.'
      ELSE date_format(o_orderdate, 'dd.MM.yyyy') END""",
    "period": """concat(CASE WHEN o_orderstatus = 'O' THEN '??.??.' ELSE
      date_format(o_orderdate - INTERVAL 9 DAYS, 'dd.MM.') END, '–',
      date_format(o_orderdate - INTERVAL 2 DAYS, 'dd.MM.'))""",
    "percent": """concat(CAST(floor(o_totalprice / 10000) AS INT), ',',
      CAST(CAST(floor(o_totalprice / 1000) AS INT) % 10 AS STRING), ' %')""",
}
_DN = "CAST(floor(o_totalprice / 100) AS INTEGER)"
_DT = (f"CAST(CAST(floor({_DN} / 1000.0) AS INTEGER) AS VARCHAR) || '.' || "
       f"lpad(CAST({_DN} % 1000 AS VARCHAR), 3, '0')")
_SQL_RAW = f"""raw AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'T• ' || {_DT}
 WHEN '2-HIGH' THEN 'O • ' || {_DT} WHEN '3-MEDIUM' THEN 'TOM• ' || {_DT}
 WHEN '4-NOT SPECIFIED' THEN '?.' || lpad(CAST({_DN} % 1000 AS VARCHAR), 3, '0') ELSE '?' END AS befragte,
 CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'n. a.'
 ELSE strftime(o_orderdate, '%d.%m.%Y') END AS published,
 CASE WHEN o_orderstatus = 'O' THEN '??.??.' ELSE strftime(o_orderdate - INTERVAL 9 DAY, '%d.%m.') END
 || '–' || strftime(o_orderdate - INTERVAL 2 DAY, '%d.%m.') AS period,
 CAST(CAST(floor(o_totalprice / 10000) AS INTEGER) AS VARCHAR) || ',' ||
 CAST(CAST(floor(o_totalprice / 1000) AS INTEGER) % 10 AS VARCHAR) || ' %' AS percent FROM orders)"""


def _sql_field(month: str, day: str) -> str:
    return (f"CASE WHEN pub IS NOT NULL AND {day} <> '' THEN strftime(make_date(CAST(year(pub) AS BIGINT)"
            f" - CASE WHEN CAST({month} AS BIGINT) > month(pub) THEN 1 ELSE 0 END,"
            f" CAST({month} AS BIGINT), CAST({day} AS BIGINT)), '%Y-%m-%d') END")


@query(f"""WITH {_SQL_RAW}, p AS (SELECT *, CAST(try_strptime(published, '%d.%m.%Y') AS DATE) AS pub,
 regexp_extract(period, '^(\\d+)\\.(\\d+)', 1) AS sd, regexp_extract(period, '^(\\d+)\\.(\\d+)', 2) AS sm,
 regexp_extract(period, '–(\\d+)\\.(\\d+)\\.', 1) AS ed, regexp_extract(period, '–(\\d+)\\.(\\d+)\\.', 2) AS em FROM raw)
SELECT o_orderkey, strftime(pub, '%Y-%m-%d') AS published, {_sql_field('sm', 'sd')} AS field_start,
{_sql_field('em', 'ed')} AS field_end, regexp_extract(befragte, '[A-Za-z]+') AS mode,
CASE regexp_extract(befragte, '^[A-Za-z]+') WHEN 'O' THEN 'online' WHEN 'T' THEN 'phone'
 WHEN 'TOM' THEN 'mixed' ELSE 'unknown' END AS method,
TRY_CAST(replace(replace(replace(regexp_extract(befragte, '[\\d.?]+'), '?.', '1'), '?', '0'), '.', '') AS INTEGER) AS n,
CAST(replace(replace(percent, ' %', ''), ',', '.') AS DOUBLE) AS share FROM p""")
def text_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    """Cell texts of a poll page parsed: dates, field period, mode, sample size, percent."""
    raw = table(spark, sf, "orders").select(
        "o_orderkey", *[F.expr(e).alias(n) for n, e in _RAW.items()])
    pub = dates.dotted_date(F.col("published"))
    start, end = dates.field_period(F.col("period"), pub)
    return raw.select(
        "o_orderkey", iso(pub).alias("published"), iso(start).alias("field_start"),
        iso(end).alias("field_end"), X.mode_code(F.col("befragte")).alias("mode"),
        X.survey_method(F.col("befragte")).alias("method"),
        X.sample_size(F.col("befragte")).alias("n"), X.percent_value(F.col("percent")).alias("share"))


_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("SELECT " + ", ".join(
    f"count({c}) AS {c}__n, CAST(arg_min({c}, o_orderkey) AS VARCHAR) AS {c}__first" for c in _COLS)
    + ", count(empty) AS empty__n, CAST(arg_min(empty, o_orderkey) AS VARCHAR) AS empty__first"
    " FROM (SELECT *, CAST(NULL AS VARCHAR) AS empty FROM orders)")
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Known values and first value of every column."""
    df = table(spark, sf, "orders").select(*_COLS).withColumn("empty", F.lit(None).cast("string"))
    return reshape.column_profile(df, ["o_orderkey"])


@query("""WITH x AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS sum_k, min(k) AS min_k, max(k) AS max_k FROM x GROUP BY 1""")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON column parsed with its schema and summarised."""
    k = F.from_json("props", "struct<k: bigint>")["k"]
    return table(spark, sf, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(
        F.count("k").alias("n"), F.sum("k").alias("sum_k"), F.min("k").alias("min_k"),
        F.max("k").alias("max_k"))


@query(f"""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT strftime(date_trunc('month', d), '%Y-%m') AS month,
count(CASE WHEN d BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' THEN 1 END) AS inclusive,
count(CASE WHEN d > DATE '1996-01-01' AND d < DATE '2000-12-31' THEN 1 END) AS exclusive,
count(CASE WHEN d >= DATE '{AS_OF}' - 120 THEN 1 END) AS recent, max(date_diff('day', DATE '{ORIGIN}', d)) AS last_offset
FROM o GROUP BY 1""")
def date_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Inclusive, exclusive and recent date windows side by side, per month."""
    d = F.col("day")
    recent = d >= F.date_sub(F.lit(AS_OF).cast("date"), 120)
    return orders(spark, sf).groupBy(F.date_format(d, "yyyy-MM").alias("month")).agg(
        F.count_if(d.between("1996-01-01", "2000-12-31")).alias("inclusive"),
        F.count_if((d > "1996-01-01") & (d < "2000-12-31")).alias("exclusive"),
        F.count_if(recent).alias("recent"),
        F.max(F.datediff(d, F.lit(ORIGIN).cast("date"))).cast("bigint").alias("last_offset"))


@query("""WITH x AS (SELECT p_brand, p_size, CASE WHEN p_size = 1 THEN -99 ELSE p_size END AS coded FROM part
WHERE p_type IN ('ECONOMY', 'SMALL', 'MEDIUM') AND contains(p_name, 'r') AND p_brand <> 'Brand#1')
SELECT p_brand, count(*) AS n, count(CASE WHEN p_size BETWEEN 5 AND 40 THEN 1 END) AS within,
count(CASE WHEN p_size > 5 AND p_size < 40 THEN 1 END) AS inside,
CAST(sum(nullif(coded, -99)) AS BIGINT) AS decoded, count(CASE WHEN coded >= 0 THEN 1 END) AS n_valid FROM x GROUP BY 1""")
def allow_and_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Allow-list, substring, negated label, closed and open bounds, sentinel decode."""
    x = table(spark, sf, "part").where(
        F.col("p_type").isin("ECONOMY", "SMALL", "MEDIUM") & F.col("p_name").contains("r")
        & (F.col("p_brand") != "Brand#1")).select(
        "p_brand", "p_size", F.when(F.col("p_size") == 1, -99).otherwise(F.col("p_size")).alias("coded"))
    size = F.col("p_size")
    return x.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(size.between(5, 40)).alias("within"),
        F.count_if((size > 5) & (size < 40)).alias("inside"),
        F.sum(F.nullif(F.col("coded"), F.lit(-99))).alias("decoded"),
        F.count_if(F.col("coded") >= 0).alias("n_valid"))


@query(f"""WITH {CTE_SHARE}, s AS (SELECT t, sum(round(s, 2)) AS total FROM share WHERE s IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN sha256(text) ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents)
SELECT 'sum off' AS kind, count(*) AS n FROM s WHERE abs(total - 1) > 0.001
UNION ALL SELECT 'close', count(*) FROM s WHERE abs(total - 1) <= 0.011
UNION ALL SELECT 'content id', count(*) FROM d WHERE regexp_full_match(id, '[0-9a-f]{{64}}')
UNION ALL SELECT 'other id', count(*) FROM d WHERE NOT regexp_full_match(id, '[0-9a-f]{{64}}')""")
def tolerance_and_format(spark: SparkSession, sf: str) -> DataFrame:
    """Row sums within a tolerance, closeness, and the format of ids."""
    w = Window.partitionBy("t")
    s = period_votes(spark, sf).withColumn(
        "s", F.round(F.col("y") / F.sum("y").over(w), 2)).dropna(subset=["s"]).groupBy("t").agg(
        F.sum("s").alias("total"))
    d = table(spark, sf, "documents").select(
        F.when(F.col("lang") == "en", F.sha2("text", 256)).otherwise(
            F.col("doc_id").cast("string")).alias("id"))
    is_id = hashing.is_content_id(F.col("id"))
    one = F.lit(1.0)
    sums = s.agg(
        F.count_if(F.abs(F.col("total") - 1) > 0.001).alias("sum off"),
        F.count_if(N.is_close(F.col("total"), one, rtol=0.0, atol=0.011)
                   & N.is_finite(F.col("total"))).alias("close"))
    ids = d.agg(F.count_if(is_id).alias("content id"), F.count_if(~is_id).alias("other id"))
    return sums.unpivot([], ["sum off", "close"], "kind", "n").union(
        ids.unpivot([], ["content id", "other id"], "kind", "n"))


_LABELS = {"ECONOMY": "Economy", "LARGE": "Large", "MEDIUM": "Medium", "SMALL": "Small"}


@query("""SELECT p_type AS id, CASE p_type WHEN 'ECONOMY' THEN 'Economy' WHEN 'LARGE' THEN 'Large'
WHEN 'MEDIUM' THEN 'Medium' WHEN 'SMALL' THEN 'Small' ELSE 'unknown' END AS display,
CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN 'core' WHEN p_type IN ('LARGE', 'SMALL') THEN 'edge' ELSE 'rest' END AS tier,
count(*) AS n_parts, round(avg(p_retailprice) / 100, 6) AS share,
CAST(row_number() OVER (ORDER BY count(*) DESC, p_type NULLS LAST) AS BIGINT) AS rank FROM part GROUP BY 1, 2, 3""")
def sorted_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels by map with a default, priority tiers, and a ranking with missing values last."""
    g = table(spark, sf, "part").groupBy("p_type").agg(
        F.count(F.lit(1)).alias("n_parts"), F.avg("p_retailprice").alias("avg_price"))
    kind = F.col("p_type")
    ranked = g.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("n_parts"), F.asc_nulls_last("p_type"))).cast("bigint"))
    return ranked.withColumnsRenamed({"p_type": "id"}).select(
        "id", map_lookup(_LABELS, F.col("id"), F.lit("unknown")).alias("display"),
        F.when(F.col("id").isin("ECONOMY", "LARGE"), "core")
        .when(F.col("id").isin("LARGE", "SMALL"), "edge").otherwise("rest").alias("tier"),
        "n_parts", r6(F.col("avg_price") / 100).alias("share"), "rank")


@query(f"""WITH {CTE_SHARE}, m AS (SELECT max(s) AS top, min(t) AS t0, max(t) AS t1 FROM share)
SELECT t, string_agg(party || ' ' || printf('%.1f', round(s * 1000) / 10) || '%', ', ' ORDER BY s DESC, party) AS panel,
round(max(s) / max(top), 6) AS width, CAST(max(t0) AS INTEGER) AS first_t, CAST(max(t1) AS INTEGER) AS last_t
FROM share, m GROUP BY 1""")
def panel_strings(spark: SparkSession, sf: str) -> DataFrame:
    """Parties of a period by share as display text, with bar width and axis range."""
    w = Window.partitionBy("t")
    s = period_votes(spark, sf).withColumn("s", F.col("y") / F.sum("y").over(w))
    shown = F.transform("e", lambda x: F.concat(
        x["party"], F.lit(" "), F.format_string("%.1f", F.round(x["s"] * 1000) / 10), F.lit("%")))
    ordered_ = F.array_sort(
        F.collect_list(F.struct("party", "s")),
        lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1)
        .when(a["party"] < b["party"], -1).otherwise(1))
    whole = Window.partitionBy()  # one row per period
    return s.groupBy("t").agg(ordered_.alias("e"), F.max("s").alias("m")).select(
        "t", F.array_join(shown, ", ").alias("panel"),
        r6(F.col("m") / F.max("m").over(whole)).alias("width"),
        F.min("t").over(whole).alias("first_t"), F.max("t").over(whole).alias("last_t"))


@query(f"""WITH v AS (SELECT l_returnflag AS party, o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, l_quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT party, count(DISTINCT o_orderkey) AS n_polls, count(DISTINCT o_custkey) AS n_sources,
strftime(min(d), '%Y-%m-%d') AS first_day, strftime(max(d), '%Y-%m-%d') AS last_day,
CAST(sum(l_quantity) AS BIGINT) AS total FROM v WHERE l_quantity > 0 GROUP BY 1""")
def distinct_and_extent(spark: SparkSession, sf: str) -> DataFrame:
    """Exact distinct counts, first and last day, totals per category.

    Lines are summed per (poll, category) first, so a poll enters the join once per category.
    """
    lines = table(spark, sf, "lineitem").where("l_quantity > 0").groupBy(
        "l_orderkey", F.col("l_returnflag").alias("party")).agg(F.sum("l_quantity").alias("q"))
    o = orders(spark, sf, "o_custkey")
    v = lines.join(o, lines.l_orderkey == o.o_orderkey)
    # Spark counts distinct values in two steps, first per (party, source).
    return v.groupBy("party").agg(
        F.count(F.lit(1)).alias("n_polls"), F.count_distinct("o_custkey").alias("n_sources"),
        iso(F.min("day")).alias("first_day"), iso(F.max("day")).alias("last_day"),
        F.sum("q").cast("bigint").alias("total"))


@query("""SELECT o_orderpriority AS source, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS rn
FROM orders) WHERE rn = 1""")
def latest_per_source(spark: SparkSession, sf: str) -> DataFrame:
    """Latest poll of every source as an aggregate, so a large source combines on the map side."""
    o = orders(spark, sf, "o_orderpriority", "o_totalprice").select(
        F.col("o_orderpriority").alias("source"), "o_orderkey", "day", "o_totalprice")
    return rows.latest_per_group(o, ["source"], "day", "o_orderkey").withColumn("day", iso("day"))


@query("""WITH u AS (SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS bal, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_nationkey, s_acctbal, NULL FROM supplier)
SELECT nation, count(CASE WHEN kind = 'customer' THEN 1 END) AS customers, count(CASE WHEN kind = 'supplier' THEN 1 END) AS suppliers,
round(max(CASE WHEN kind = 'customer' THEN bal END), 6) AS top_customer, round(max(CASE WHEN kind = 'supplier' THEN bal END), 6)
 AS top_supplier, count(segment) AS with_segment FROM u GROUP BY 1""")
def tagged_union(spark: SparkSession, sf: str) -> DataFrame:
    """Union by name with provenance, absent columns null, pivoted by provenance."""
    c = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"),
        F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))
    u = reshape.tagged_union({"customer": c, "supplier": s}, "kind")
    is_c, is_s = F.col("kind") == "customer", F.col("kind") == "supplier"
    return u.groupBy("nation").agg(
        F.count_if(is_c).alias("customers"), F.count_if(is_s).alias("suppliers"),
        r6(F.max(F.when(is_c, F.col("bal")))).alias("top_customer"),
        r6(F.max(F.when(is_s, F.col("bal")))).alias("top_supplier"),
        F.count("segment").alias("with_segment"))


@query("""SELECT page_id, regexp_extract(url, '([^/]+)/*$', 1) AS base, replace(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '.', '_') AS site,
contains(url, 'example') AS has_example, starts_with(url, 'https') AS is_https, regexp_matches(url, '/[0-9]+') AS numbered,
concat_ws('|', nullif(regexp_extract(url, 'page=([0-9]+)', 1), ''), nullif(regexp_extract(url, 'ref=([a-z]+)', 1), '')) AS query_parts,
regexp_replace(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')), '[^\\p{L}\\p{M}\\p{N}_\\s/]', '', 'g') AS header
FROM pages""")
def text_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Base names, contains/starts/matches, conditional joins of parts, cleaned headers."""
    url = F.col("url")
    part = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    return table(spark, sf, "pages").select(
        "page_id", X.base_name(url).alias("base"),
        F.replace(F.regexp_extract(url, "^[a-z]+://([^/]+)", 1), F.lit("."), F.lit("_")).alias("site"),
        url.contains("example").alias("has_example"), url.startswith("https").alias("is_https"),
        url.rlike("/[0-9]+").alias("numbered"),
        F.concat_ws("|", part("page=([0-9]+)"), part("ref=([a-z]+)")).alias("query_parts"),
        X.header_name(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("header"))


@query(f"""WITH o AS (SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS d, {sql_t('o_orderdate')} AS t FROM orders)
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY d, o_orderkey) AS BIGINT) AS poll_idx,
CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS BIGINT) AS source_idx,
CAST(dense_rank() OVER (ORDER BY t) AS BIGINT) AS period_idx,
strftime(lag(d) OVER (PARTITION BY o_orderpriority ORDER BY d, o_orderkey), '%Y-%m-%d') AS previous_day FROM o""")
def survey_index(spark: SparkSession, sf: str) -> DataFrame:
    """Running number of every poll, positions of its source and period, previous poll's day.

    The running number spans the table and a source may hold most of it, so both are binned
    scans; sources and periods are short key lists.
    """
    n = size_of(spark, sf, "orders")
    o = orders(spark, sf, "o_orderpriority").withColumn(
        "t", dates.grid_index(F.col("day"), ORIGIN))
    out = ordered.number_rows(o, [], ["day", "o_orderkey"], "poll_idx", n)
    out = ordered.scan(out, ["o_orderpriority"], ["day", "o_orderkey"],
                       {"previous_day": ("lag", F.col("day"))}, n)
    src = joins.sorted_positions(o, "o_orderpriority", "source_idx")
    per = joins.sorted_positions(o, "t", "period_idx")
    return out.join(src, "o_orderpriority").join(per, "t").select(
        "o_orderkey", "poll_idx", F.col("source_idx").cast("bigint").alias("source_idx"),
        F.col("period_idx").cast("bigint").alias("period_idx"),
        iso("previous_day").alias("previous_day"))
