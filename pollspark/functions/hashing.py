"""Content ids and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollspark.functions.dates import iso
from pollspark.functions.text import number_text


def _or(text: Column, missing: str) -> Column:
    return F.coalesce(text, F.lit(missing))


def row_id(source: Column, published: Column, start: Column, end: Column, n: Column,
           shares: Column) -> Column:
    """SHA-256 id of one scraped row; ``shares`` is a map from party header to value.

    Every missing value prints as ``none``. Parties enter in name order, and only those that
    carry a value: a column that appears on the page later must not change the ids of old rows.
    """
    known = F.map_filter(shares, lambda k, v: v.isNotNull())
    pairs = F.transform(
        F.array_sort(F.map_entries(known)),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    head = F.array(
        _or(source, "none"), _or(iso(published), "none"), _or(iso(start), "none"),
        _or(iso(end), "none"), _or(n.cast("string"), "none"),
    )
    return F.sha2(F.array_join(F.concat(head, pairs), "|"), 256)


def poll_id(source: Column, published: Column, start: Column, end: Column, n: Column,
            parties: list[str]) -> Column:
    """SHA-256 id of one canonical poll over a fixed set of party columns.

    Missing dates and sizes print as ``NA``, a missing party as ``none``.
    """
    pairs = [
        F.concat(F.lit(f"{p}="), _or(number_text(F.col(p)), "none")) for p in sorted(parties)
    ]
    head = [
        _or(source, "NA"), _or(iso(published), "NA"), _or(iso(start), "NA"),
        _or(iso(end), "NA"), _or(n.cast("string"), "NA"),
    ]
    return F.sha2(F.concat_ws("|", *head, *pairs), 256)


def is_content_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def fingerprint(df: DataFrame, row_hash: Column | None = None) -> DataFrame:
    """Order-free content fingerprint: row count and sum of row hashes, one row.

    Partial sums combine on the map side, so only one row per task is shuffled.
    """
    h = F.xxhash64(*[F.col(c) for c in df.columns]) if row_hash is None else row_hash
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
        .alias("hash_sum"),
    )
