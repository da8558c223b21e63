"""Ordered scans that survive a hot key.

A plain window sends every row of one key to one task, which fails when a key holds a large part
of the table. Here the order of such keys is cut into bins. Each (key, bin) group is one
window partition, and what the bins before it add up to enters as one extra "carry" row that
sorts first. Results are the same as with the plain window, but for the order in which
floating-point values are added, and no group exceeds a bin.

Cut points come from a small hash-chosen sample of the order columns. They only balance the work:
any cuts give the same result. Being literals or a written table, they stay the same when a lost
executor makes Spark run a stage again. There may be any number of bins: beyond ``LITERALS`` they
are bins of bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pollspark.session import checkpointed

ROWS_PER_BIN = 1_000_000
MAX_BINS = 4096
LITERALS = 512
_SAMPLES_PER_BIN = 40
_BIN, _SUB, _ROW, _HOT = "__bin", "__sub", "__row", "__hot"


def cut_points(df: DataFrame, cols: list[str], n_rows: int,
               rows_per_bin: int = ROWS_PER_BIN) -> list[tuple[str, ...]]:
    """Cut points, as text, of the order ``cols``; none where ``n_rows`` fits one bin.

    ``n_rows`` is an upper bound of the rows in ``df``, usually the row count of its table, which
    Parquet answers from the footers. The sample holds about 40 keys per bin; at most four times
    as many reach the driver, should ``n_rows`` be too low.
    """
    bins = min(MAX_BINS, math.ceil(n_rows / max(1, rows_per_bin)))  # literal cuts; ``with_bins`` goes on inside them
    if bins <= 1:
        return []
    target = bins * _SAMPLES_PER_BIN
    every = max(1, n_rows // target)
    # Equal keys cannot be cut apart, so a null single column is no cut; in a wider key it is the least value.
    keys = df.select(*cols).dropna() if len(cols) == 1 else df.select(*cols)
    if every > 1:
        keys = keys.where(F.pmod(F.xxhash64(*cols), F.lit(every)) == 0)
    text = [F.col(c).cast("string").alias(f"s{i}") for i, c in enumerate(cols)]
    # The bound takes the keys of least hash, so it thins the sample evenly over the whole order.
    sample = keys.distinct().orderBy(F.xxhash64(*cols)).limit(4 * target).orderBy(*cols).select(*text).collect()
    at = sorted({i * len(sample) // bins for i in range(1, bins)} - {0})
    return [tuple(sample[i]) for i in at]


_TREE = 64


def bin_of(df: DataFrame, cols: list[str], cuts: list[tuple[str, ...]]) -> Column:
    """Number of cut points at or below the row's order key.

    A compiled tree of comparisons finds one of at most 64 ranges of cuts, and two short array
    filters the place inside, so 4096 cuts cost about 20 comparisons.
    """
    if not cuts:
        return F.lit(0)
    kinds = [df.schema[c].dataType for c in cols]

    def pack(parts: list[Column]) -> Column:
        return parts[0] if len(parts) == 1 else F.struct(
            *[p.alias(c) for p, c in zip(parts, cols)])

    def point(cut: tuple[str, ...]) -> Column:
        return pack([F.lit(v).cast(k) for v, k in zip(cut, kinds)])

    here = pack([F.col(c) for c in cols])
    width = -(-len(cuts) // _TREE)
    groups = [cuts[i:i + width] for i in range(0, len(cuts), width)]

    plain = not any(isinstance(k, T.StringType) for k in kinds) and all(v is not None for c in cuts for v in c)
    key_type = kinds[0] if len(cols) == 1 else T.StructType(
        [T.StructField(c, k) for c, k in zip(cols, kinds)])

    def array_of(points: list[tuple[str, ...]]) -> Column:
        """Points as an array; where no text is among them, as one folded constant."""
        if not plain:
            return F.array(*[point(c) for c in points])
        parts = [F.split(F.lit(",".join(p[i] for p in points)), ",").cast(T.ArrayType(k))
                 for i, k in enumerate(kinds)]
        return parts[0] if len(parts) == 1 else F.arrays_zip(*parts).cast(T.ArrayType(key_type))

    def count(points: list[tuple[str, ...]]) -> Column:
        return F.size(F.filter(array_of(points), lambda c: c <= here))

    def inside(group: list[tuple[str, ...]]) -> Column:
        """Cuts of a group at or below the key, the first one known to be."""
        step = max(1, math.isqrt(len(group)))
        if len(group) <= 8:
            return count(group)
        parts = [group[i:i + step] for i in range(0, len(group), step)]
        nested = F.array(*[array_of(p) for p in parts])
        first = count([p[0] for p in parts])
        rest = F.size(F.filter(F.element_at(nested, first), lambda c: c <= here))
        return (first - 1) * step + rest

    def tree(low: int, high: int) -> Column:
        """Groups low..high - 1, where the key is at or above the head of ``low``."""
        if high - low == 1:
            base = low * width
            return F.lit(base + 1) if width == 1 else F.lit(base) + inside(groups[low])
        mid = (low + high) // 2
        return F.when(here >= point(groups[mid][0]), tree(mid, high)).otherwise(tree(low, mid))

    return F.when(here >= point(groups[0][0]), tree(0, len(groups))).otherwise(0)


_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def with_bins(rows: DataFrame, sampled: DataFrame, cols: list[str], n_rows: int,
              rows_per_bin: int) -> tuple[DataFrame, bool]:
    """Rows with their bin (``__bin``, ``__sub``), and whether there are bins of bins.

    Up to ``LITERALS`` bins are found among literal cut points. Beyond, these cut the order coarsely,
    and the cut points inside each coarse bin come from a sample that stays on the executors: a
    sorted list per coarse bin, written once, parted into blocks whose heads are joined on the bin and whose
    cuts are joined on (bin, block), so a row meets twice the root of a list. Any number of bins is possible.
    """
    bins = math.ceil(n_rows / max(1, rows_per_bin))
    two = bins > LITERALS
    coarse = cut_points(sampled, cols, n_rows, math.ceil(n_rows / min(LITERALS, math.isqrt(bins) + 1)) if two else rows_per_bin)
    placed = rows.withColumn(_BIN, bin_of(rows, cols, coarse))
    if not two:
        return placed.withColumn(_SUB, F.lit(0)), False
    inside = math.ceil(bins / (len(coarse) + 1))
    every = max(1, n_rows // (bins * _SAMPLES_PER_BIN))
    keys = sampled.select(*cols)
    if every > 1:
        keys = keys.where(F.pmod(F.xxhash64(*cols), F.lit(every)) == 0)
    keys = keys.distinct().withColumn(_BIN, bin_of(rows, cols, coarse))
    # A coarse bin holds about ``_SAMPLES_PER_BIN * inside`` keys of the sample.
    w = Window.partitionBy(_BIN)
    at = F.row_number().over(w.orderBy(*[F.asc_nulls_first(c) for c in cols]))
    step = keys.withColumns({"__at": at, "__of": F.count(F.lit(1)).over(w)})
    first = F.floor(F.col("__at") * inside / F.col("__of")) > F.floor((F.col("__at") - 1) * inside / F.col("__of"))
    width = math.isqrt(inside) + 1
    block = F.floor((F.col("__at") * inside / F.col("__of")) / width).cast("int")
    cuts = checkpointed(step.where(first).groupBy(_BIN, block.alias("__block")).agg(
        F.sort_array(F.collect_list(F.struct(*cols))).alias("__cuts")))
    head = F.struct(F.get("__cuts", F.lit(0)).alias("head"), "__block")
    heads = cuts.groupBy(_BIN).agg(F.sort_array(F.collect_list(head)).alias("__heads"))
    here = F.struct(*cols)
    # At most ``LITERALS`` lists of the root of a coarse bin's cuts.
    found = placed.join(F.broadcast(heads), _BIN, "left").withColumn(
        "__block", F.try_element_at(F.filter("__heads", lambda h: h["head"] <= here), F.lit(-1))["__block"]).drop("__heads")
    sub = F.col("__block") * (width + 1) + F.size(F.filter("__cuts", lambda c: c <= here))
    return found.join(cuts, [_BIN, "__block"], "left").withColumn(_SUB, F.coalesce(sub, F.lit(0))).drop("__cuts", "__block"), True


def hot_keys(df: DataFrame, keys: list[str], order: list[str], n_rows: int,
             rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Keys with more rows than one task should take, at most about one per bin.

    Sizes are estimated from the rows of every m-th hash of the order, about 1000 rows at the
    limit; a key misjudged near the limit is only cut, or not cut, and the result is the same.
    """
    every = max(1, rows_per_bin // 1000)
    chosen = df if every == 1 else df.where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0)
    big = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(
        F.col("__n") * every > rows_per_bin)
    return checkpointed(big.select(*keys))


def flag_hot(df: DataFrame, keys: list[str], hot: DataFrame, name: str) -> DataFrame:
    """Mark the rows of hot keys; Spark broadcasts the list while its stored size allows it."""
    known = hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias(name))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__h_{k}"))
    return df.join(known, same, "left").drop(*[f"__h_{k}" for k in keys]).fillna(False, [name])


def _binned(rows: DataFrame, keys: list[str], order: list[str], n_rows: int,
            rows_per_bin: int) -> tuple[DataFrame, bool] | None:
    """Rows with ``__hot``, ``__bin`` and ``__sub``; None where no group outgrows one task."""
    if n_rows <= rows_per_bin:
        return None
    flagged = rows.withColumn(_HOT, F.lit(True))
    if keys:
        hot = hot_keys(rows, keys, order, n_rows, rows_per_bin)
        if hot.isEmpty():
            return None
        flagged = flag_hot(rows, keys, hot, _HOT)
    placed, two = with_bins(flagged, flagged.where(_HOT), order, n_rows, rows_per_bin)
    return placed.withColumns({b: F.when(F.col(_HOT), F.col(b)).otherwise(0) for b in (_BIN, _SUB)}), two


def _carried(totals: DataFrame, keys: list[str], kinds: dict[str, str], two: bool,
             reverse: bool = False) -> DataFrame:
    """What the bins before each bin of a key add up to, where there is such a bin.

    ``totals`` has one row per (key, bin, sub-bin). With bins of bins the sums run over the
    coarse bins and inside each of them, so no window holds more than a share of the bins.
    """
    arrow = F.desc_nulls_last if reverse else F.asc_nulls_first

    def before(df: DataFrame, part: list[str], by: str, tail: str) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(arrow(by))
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({f"__n{tail}": F.row_number().over(w), **{
            n + tail: F.lag(n).over(w) if kind == "lag" else _MERGE[kind](n).over(earlier)
            for n, kind in kinds.items()}})

    if not two:
        one = before(totals, keys, _BIN, "_c").where("__n_c > 1")
        return one.select(*keys, _BIN, _SUB, *[F.col(f"{n}_c").alias(n) for n in kinds])

    def last(n: str) -> Column:
        return F.min_by(n, _SUB) if reverse else F.max_by(n, _SUB)

    per_bin = totals.groupBy(*keys, _BIN).agg(*[
        (last(n) if kind == "lag" else _MERGE[kind](n)).alias(n) for n, kind in kinds.items()])
    coarse = before(per_bin, keys, _BIN, "_c").select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col(_BIN).alias("__k_bin"), "__n_c", *[f"{n}_c" for n in kinds])
    fine = before(totals, [*keys, _BIN], _SUB, "_f")
    same = F.col(_BIN) == F.col("__k_bin")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))

    def both(n: str, kind: str) -> Column:
        f, c = F.col(f"{n}_f"), F.col(f"{n}_c")
        if kind == "lag":
            return F.when(F.col("__n_f") > 1, f).otherwise(c)
        if kind == "sum":
            return F.coalesce(f + c, f, c)
        return F.greatest(f, c) if kind == "max" else F.least(f, c)

    return fine.join(coarse, same).where("__n_f > 1 OR __n_c > 1").select(
        *keys, _BIN, _SUB, *[both(n, kind).alias(n) for n, kind in kinds.items()])


def scan(df: DataFrame, keys: list[str], order: list[str],
         values: dict[str, tuple[str, Column]], n_rows: int,
         rows_per_bin: int = ROWS_PER_BIN, reverse: bool = False) -> DataFrame:
    """Add running values per key: ``{name: (kind, expression)}``.

    Kinds ``sum``, ``max``, ``min`` run over the rows up to and including the current one;
    ``lag`` is the expression's value on the row before. ``order`` must be a total order of the
    rows of a key, ascending with nulls first; ``reverse`` turns it round. Where the table or its
    largest key fits one task this is a plain window; otherwise only the hot keys are cut.
    """
    arrow = F.desc_nulls_last if reverse else F.asc_nulls_first
    ordering = [arrow(c) for c in order]
    names = {name: f"__v_{name}" for name in values}
    rows = df.withColumns({names[n]: e for n, (_, e) in values.items()})
    kinds = {names[n]: kind for n, (kind, _) in values.items()}

    binned = _binned(rows, keys, order, n_rows, rows_per_bin)
    if binned is None:
        part, w = rows, Window.partitionBy(*keys).orderBy(*ordering)
    else:
        placed, two = binned
        totals = placed.where(_HOT).groupBy(*keys, _BIN, _SUB).agg(*[
            (F.max_by(n, F.struct(*order)) if kind == "lag" and not reverse
             else F.min_by(n, F.struct(*order)) if kind == "lag"
             else _MERGE[kind](n)).alias(n) for n, kind in kinds.items()])
        carry = _carried(totals, keys, kinds, two, reverse).withColumn(_ROW, F.lit(0))
        part = placed.withColumn(_ROW, F.lit(1)).unionByName(carry, allowMissingColumns=True)
        w = Window.partitionBy(*keys, _BIN, _SUB).orderBy(F.asc(_ROW), *ordering)

    up_to_here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = part.withColumns({
        n: F.lag(names[n]).over(w) if kind == "lag" else _MERGE[kind](names[n]).over(up_to_here)
        for n, (kind, _) in values.items()
    })
    if _ROW in part.columns:
        out = out.where(F.col(_ROW) == 1)
    return out.drop(_BIN, _SUB, _ROW, _HOT, *names.values())


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str, n_rows: int,
                rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Row numbers from 1 per key (over the whole table when ``keys`` is empty)."""
    return scan(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, n_rows, rows_per_bin)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str,
                n_rows: int, rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    return scan(df, keys, order, {name: ("sum", value)}, n_rows, rows_per_bin)


def nearest_marker(df: DataFrame, keys: list[str], time: str, tie: str, is_marker: Column,
                   n_rows: int, rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """For every row that is no marker, the marker of the same key nearest in time.

    Adds ``near_time`` and ``near_id``; of two at the same distance the earlier one wins. Null
    where a key has no marker. One sort serves both directions: a bin of a hot key is framed by a
    row for the last marker before it and one for the first marker after it.
    """
    point = F.struct(F.col(time).alias("t"), F.col(tie).alias("i"))
    rows = df.withColumns({"__m": F.when(is_marker, point), "__is": F.coalesce(is_marker, F.lit(False))})
    binned = _binned(rows, keys, [time, tie], n_rows, rows_per_bin)
    by = [*keys]
    if binned is None:
        part = rows.withColumn(_ROW, F.lit(1))
    else:
        placed, two = binned
        by += [_BIN, _SUB]
        totals = placed.where(_HOT).groupBy(*by).agg(F.max("__m").alias("__m"), F.min("__m").alias("__first"))
        # Written once for two readers; one row per key and bin.
        totals = checkpointed(totals)
        back = _carried(totals.drop("__first"), keys, {"__m": "max"}, two).withColumn(_ROW, F.lit(0))
        ahead = _carried(totals.drop("__m").withColumnRenamed("__first", "__m"), keys, {"__m": "min"}, two, reverse=True).withColumn(_ROW, F.lit(2))
        part = placed.withColumn(_ROW, F.lit(1)).unionByName(back, allowMissingColumns=True).unionByName(ahead, allowMissingColumns=True)
    over = f"OVER (PARTITION BY {', '.join(f'`{c}`' for c in by)} ORDER BY {_ROW}, `{time}`, `{tie}`)"
    part = part.withColumns({"__prev": F.expr(f"lag(__m) IGNORE NULLS {over}"), "__next": F.expr(f"lead(__m) IGNORE NULLS {over}")})

    here = F.col(time)
    use_next = F.col("__prev").isNull() | (
        F.col("__next.t") - here < here - F.col("__prev.t"))
    best = F.when(F.col("__next").isNotNull() & use_next, F.col("__next")).otherwise(
        F.col("__prev"))
    return (
        part.where((F.col(_ROW) == 1) & ~F.col("__is"))
        .withColumn("__best", best)
        .withColumns({"near_time": F.col("__best.t"), "near_id": F.col("__best.i")})
        .drop("__m", "__is", "__prev", "__next", "__best", _BIN, _SUB, _ROW, _HOT)
    )
