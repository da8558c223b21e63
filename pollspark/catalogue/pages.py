"""Web pages: links and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollspark.catalogue.base import query, table
from pollspark.sources import pages as P

_NAV = "array_to_string(regexp_extract_all(html, '(?is)<nav[^>]*>(.*?)</nav>', 1), ' ')"
_ANCHOR = P.ANCHOR.replace("'", "''")


# The references of these pages, ampersands last.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def _sql_unescaped(sql: str) -> str:
    for name, character in REFERENCES.items():
        sql = f"replace({sql}, '{name}', '{character.replace("'", "''")}')"
    return sql

_SQL_URL = """CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href
 WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href ELSE '?' END"""


@query(f"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all({_NAV}, '{_ANCHOR}', 1)) AS quoted,
 unnest(regexp_extract_all({_NAV}, '{_ANCHOR}', 2)) AS inside FROM pages),
b AS (SELECT page_id, url, {_sql_unescaped("trim(quoted, chr(34) || chr(39))")} AS href,
 {_sql_unescaped("regexp_replace(inside, '<[^>]*>', '', 'g')")} AS label FROM a)
SELECT page_id, trim(label) AS label, {_SQL_URL} AS target, count(*) AS n FROM b GROUP BY 1, 2, 3""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors of the navigation block with absolute targets."""
    return P.links(table(spark, sf, "pages"), "nav").groupBy("page_id", "label", "target").agg(
        F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1)) AS inner_html FROM pages),
t AS (SELECT page_id, trim(regexp_replace(inner_html, '(?s)<[^>]*>', '', 'g')) AS cell FROM r)
SELECT page_id, cell, count(*) AS n FROM t WHERE NOT contains(cell, 'tion') AND cell <> '' AND cell <> '–' GROUP BY 1, 2""")
def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a page as text, without rows that carry a marker word, blanks as null."""
    return P.block_rows(table(spark, sf, "pages"), "li", drop=["tion"]).where(
        F.col("cell").isNotNull()).groupBy("page_id", "cell").agg(F.count(F.lit(1)).alias("n"))
