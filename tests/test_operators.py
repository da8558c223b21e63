"""Operators: binned scans and rank quantiles against plain ones, joins, selection, reshaping."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pollspark.functions.text import PERCENT_PATTERN
from pollspark.operators import joins, ordered, quantiles, reshape, rows

d = dt.date


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, a third of the times equal, null keys and null values."""
    rnd = random.Random(7)
    data = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{rnd.randrange(40)}")
        time = 500 if i % 3 == 1 else rnd.randrange(1000)
        value = None if i % 97 == 0 else float(rnd.choice([1.5, 2.5, rnd.randrange(1000)]))
        data.append((key, time, i, value))
    return spark.createDataFrame(data, "key string, time int, id int, value double").repartition(5)


def same(a, b):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("reverse", [False, True])
def test_scan_equals_window(skewed, keys, reverse):
    order = ["time", "id"]
    arrow = F.desc_nulls_last if reverse else F.asc_nulls_first
    w = Window.partitionBy(*keys).orderBy(*[arrow(c) for c in order])
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select("*", F.sum("id").over(run).alias("s"), F.max("value").over(run).alias("m"),
                         F.min("value").over(run).alias("n"), F.lag("value").over(w).alias("p"))
    values = {"s": ("sum", F.col("id")), "m": ("max", F.col("value")), "n": ("min", F.col("value")),
              "p": ("lag", F.col("value"))}
    same(ordered.scan(skewed, keys, order, values, 3000, 100, reverse), want)
    same(ordered.scan(skewed, keys, order, values, 3000, reverse=reverse), want)


def test_bins_are_even(skewed):
    cuts = ordered.cut_points(skewed, ["time", "id"], 3000, 100)
    assert 20 <= len(cuts) < 30
    sizes = skewed.groupBy(ordered.bin_of(skewed, ["time", "id"], cuts).alias("b")).count().collect()
    assert len(sizes) == len(cuts) + 1
    assert max(r["count"] for r in sizes) < 500


def test_one_bin_needs_no_job(skewed):
    assert ordered.cut_points(skewed, ["time"], 3000) == []


def test_number_rows_over_table(skewed):
    got = ordered.number_rows(skewed, [], ["time", "id"], "n", 3000, 100)
    assert [r.n for r in got.orderBy("time", "id").collect()] == list(range(1, 3001))


@pytest.mark.parametrize("keys", [["key"], ["key", "odd"]])
def test_rank_quantiles_equal_percentile(skewed, keys):
    df = skewed.withColumn("odd", F.col("id") % 2)
    probs, names = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0], ["a", "b", "c", "d", "e", "f"]
    plain = quantiles.exact_quantiles(df, keys, "value", probs, names, 3000)
    ranked = quantiles.exact_quantiles(df, keys, "value", probs, names, 3000, 0, 100)
    r = lambda q: q.select(*keys, "n", *[F.round(x, 9).alias(x) for x in names])
    same(r(ranked), r(plain.where("n > 0")))


def test_median_and_mad(skewed):
    a = quantiles.median_and_mad(skewed, ["key"], "value", ["id"], 3000)
    b = quantiles.median_and_mad(skewed, ["key"], "value", ["id"], 3000, one_task_rows=0, rows_per_bin=100)
    same(a.select("key", F.round("median", 9), F.round("mad", 9)),
         b.select("key", F.round("median", 9), F.round("mad", 9)))


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_salted_lookup(skewed, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    per = skewed.groupBy("key").agg(F.max("id").alias("top"))
    same(joins.salted_lookup(skewed, per, ["key"], ["id"], 3000, 100),
         skewed.join(per, "key"))


@pytest.mark.parametrize("per_bin", [20, 10_000])
def test_nearest_marker(spark, per_bin):
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    data = [("a" if i % 3 else "b", base + dt.timedelta(minutes=rnd.randrange(300)), i, i % 4 == 0)
            for i in range(300)] + [("c", base, 900, False)]
    df = spark.createDataFrame(data, "key string, ts timestamp_ntz, id int, mark boolean")
    out = ordered.nearest_marker(df, ["key"], "ts", "id", F.col("mark"), 301, per_bin)
    got = {r.id: (r.near_time, r.near_id) for r in out.collect()}
    for key, ts, i, mark in data:
        if mark:
            continue
        marks = [(abs(t - ts), t, n) for k, t, n, m in data if m and k == key]
        if not marks:
            assert got[i] == (None, None)
            continue
        assert got[i][0] == min(marks)[1]


def test_keep_first_is_idempotent_and_handles_hot_copies(spark):
    data = [("x", 5, "late", {"a": 1.0}), ("x", 2, "early", {"a": 2.0}), ("x", None, "none", {}),
            ("y", None, "only", {"b": 1.0}), (None, 1, "null key", {})]
    df = spark.createDataFrame(data, "k string, o int, v string, m map<string,double>")
    for x in (df, df.drop("m")):
        once = rows.keep_first(x, ["k"], ["o"])
        assert {(r.k, r.v) for r in once.collect()} == {("x", "early"), ("y", "only"), (None, "null key")}
        assert once.columns == x.columns
        assert rows.keep_first(once, ["k"], ["o"]).count() == 3


def test_rejection_reasons(spark):
    p = d(2024, 5, 1)
    cases = [
        (95.0, 500, p, None, None, "A", ""), (105.0, 50000, p, None, p + dt.timedelta(7), "A", ""),
        (100.0, None, p, None, None, "A", ""), (None, None, p, None, None, "A", ""),
        (88.89999999999999, None, d(1998, 12, 16), None, None, "A", "V1: vote_share_sum=88.9 outside [95,105]"),
        (100.0, 0, p, None, None, "A", "V2: n=0 outside [500,50000]"),
        (100.0, None, d(2007, 6, 13), d(2007, 6, 24), d(2007, 6, 6), "A", "V3: date validity check failed"),
        (100.0, None, p, None, p + dt.timedelta(8), "A", "V3: date validity check failed"),
        (100.0, None, d(2024, 6, 2), None, None, "A", "V3: date validity check failed"),
        (100.0, None, None, None, None, "A",
         "V3: date validity check failed; V5: null in required field (pollster/date_published)"),
        (100.0, None, p, None, None, None, "V5: null in required field (pollster/date_published)"),
        (94.9, 499, p, None, None, "A",
         "V1: vote_share_sum=94.9 outside [95,105]; V2: n=499 outside [500,50000]"),
    ]
    df = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(cases)],
                               "i int, s double, n int, p date, a date, e date, src string")
    c = F.col
    reason = rows.rejection_reason(c("s"), c("n"), c("p"), c("a"), c("e"), c("src"), F.lit(d(2024, 6, 1)))
    got = [r.r for r in df.select("i", reason.alias("r")).orderBy("i").collect()]
    assert got == [x[6] for x in cases]
    counts = {r["check"]: r.n for r in rows.reason_counts(
        df.select(reason.alias("rejection_reason")).where("rejection_reason <> ''")).collect()}
    assert counts == {"V1": 2, "V2": 2, "V3": 4, "V5": 2}


def test_deny_list_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert {r.x for r in df.where(rows.not_in(F.col("x"), ["a"])).collect()} == {"b", None}


def test_rounding_interval(spark):
    values = {"half": [1.0, 2.5, 3.0], "tenth": [1.1, 2.2, 3.3, 4.0], "whole": [1.0, 2.0],
              "odd": [0.1, 0.25, 0.4, 0.45], "single": [1.2, 3.2], "fifth": [0.2, 0.4, 0.8]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "s string, v double")
    got = {r.s: r.rounding for r in rows.rounding_interval(df, "s", "v").collect()}
    assert got == {"half": 0.5, "tenth": 0.1, "whole": 1.0, "odd": 0.05, "single": 0.2, "fifth": 0.2}
    bad = spark.createDataFrame([("x", v) for v in (0.1, 0.4, 0.55)], "s string, v double")
    assert rows.rounding_interval(bad, "s", "v").first().rounding is None


def test_impute_and_share_of_total(spark):
    df = spark.createDataFrame([(1, 0), (2, 10), (3, 20), (4, None)], "i int, n int")
    assert [r.n for r in rows.impute_mean(df, "n").orderBy("i").collect()] == [15.0, 10.0, 20.0, 15.0]
    p = rows.share_of_total(df.fillna(0), ["n"])
    assert [round(r.pct_n, 3) for r in p.orderBy("i").collect()] == [0, 33.333, 66.667, 0]


def test_pick_is_reproducible(spark):
    df = spark.range(1000)
    a = {r.id for r in rows.pick(df, ["id"], 50, 1).collect()}
    assert a == {r.id for r in rows.pick(df.repartition(9), ["id"], 50, 1).collect()} and len(a) == 50
    assert a != {r.id for r in rows.pick(df, ["id"], 50, 2).collect()}


def test_counts_before_includes_both_ends(spark):
    e = d(2024, 5, 31)
    polls = [(e,), (e,), (e - dt.timedelta(30),), (e - dt.timedelta(31),), (e + dt.timedelta(1),), (None,)]
    p = spark.createDataFrame(polls, "day date")
    a = spark.createDataFrame([(e,), (d(1990, 1, 1),)], "anchor date")
    got = {r.anchor: r.n for r in joins.counts_before(p, "day", a, "anchor", 30).collect()}
    assert got == {e: 3, d(1990, 1, 1): 0}


def test_shared_units_and_components(spark):
    pairs = [("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", 2), ("x", 8), ("y", 8), ("z", 9)]
    df = spark.createDataFrame(pairs, "s string, u int")
    got = {r.s: (r.n_units, r.n_shared_units) for r in joins.shared_units(df, "s", "u").collect()}
    assert got == {"a": (1, 1), "b": (2, 2), "c": (1, 1), "x": (1, 1), "y": (1, 1), "z": (1, 0)}
    comp = {r.s: r.component for r in joins.source_components(df, "s", "u").collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}


def test_redirect_keeps_totals(spark):
    x = spark.createDataFrame([(1, "A", 5.0), (1, "B", 2.0), (1, "R", 3.0), (2, "B", 4.0)], "id int, p string, v double")
    f = spark.createDataFrame([(1, "B", 0), (2, "B", 1)], "id int, p string, reported int")
    got = {(r.id, r.p): r.v for r in joins.redirect_residual(x, f, ["id"], "p", "v", "R", ["id"]).collect()}
    assert got == {(1, "A"): 5.0, (1, "R"): 5.0, (2, "B"): 4.0}


def test_wide_and_back(spark):
    long = [(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)]
    df = spark.createDataFrame(long, "id int, k string, v double")
    wide = reshape.to_wide(df, ["id"], "k", "v", ["a", "b"])
    back = reshape.to_long(wide, ["id"], ["a", "b"], "k", "v").where("v is not null")
    same(back, df)
    filled = reshape.to_wide(df, ["id"], "k", "v", ["a", "b"], fill=-99.0)
    assert filled.where("id = 2").first().b == -99.0
    s = reshape.to_wide_structs(df.withColumn("w", F.col("v") * 2), ["id"], "k", ["v", "w"], ["a", "b"])
    assert s.columns == ["id", "a__v", "a__w", "b__v", "b__w"]


def test_listed_but_empty_is_zero(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", 2.0), (1, "b", 3.0)], "id int, k string, v double")
    r = reshape.to_wide_sum(df, ["id"], F.col("k"), F.col("v"), ["a", "b", "c"]).first()
    assert (r.a, r.b, r.c) == (0.0, 5.0, None)


def test_profiles(spark):
    df = spark.createDataFrame([(1, None, "x 5 %", None), (2, "y", "6 %", None)], "i int, a string, p string, z string")
    r = reshape.column_profile(df, ["i"]).first()
    assert (r.a__n, r.a__first, r.p__first, r.z__n) == (1, "y", "x 5 %", 0)
    assert reshape.percent_columns(df, ["i"], PERCENT_PATTERN) == ["p"]
    assert reshape.drop_null_columns(df).columns == ["i", "a", "p"]
    assert reshape.party_columns(df.withColumn("uuid", F.lit("u"))) == ["a", "i", "p", "z"]


def test_reporting_pattern(spark):
    df = spark.createDataFrame([(1, "B"), (1, "A"), (1, "A"), (2, "C")], "id int, p string")
    got = {r.id: (r.pattern, r.party_idx, r.has_C) for r in reshape.reporting_pattern(
        df, "id", "p", {"A": 1, "B": 2, "C": 3}).collect()}
    assert got == {1: ("A | B", [1, 2], 0), 2: ("C", [3], 1)}


def test_era_index(spark):
    cal = spark.createDataFrame([(d(2024, 1, 1), 1), (d(2024, 1, 2), 2)], "date date, idx int")
    eras = spark.createDataFrame([("a", d(2024, 1, 2), d(2099, 1, 1)), ("b", d(2000, 1, 1), d(2024, 1, 1))],
                                 "party string, start_date date, end_date date")
    got = {r.party: (r.idx_start, r.idx_end, r.always_entered, r.never_exited)
           for r in joins.era_index(eras, cal, "idx").collect()}
    assert got == {"a": (2, None, 0, 1), "b": (None, 1, 1, 0)}


def test_null_keys_meet(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 3.0, 2), ("a", 5.0, 3)], "k string, v double, i int")
    for limits in ({}, {"one_task_rows": 0, "rows_per_bin": 2}):
        got = {r.k: (r.n, r.median) for r in quantiles.median_and_mad(df, ["k"], "v", ["i"], 3, **limits).collect()}
        assert got == {None: (2, 2.0), "a": (1, 5.0)}


def test_cut_points_among_null_orders(spark):
    rows = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, F.col("id").cast("int")).alias("a"), "id")
    cuts = ordered.cut_points(rows, ["a", "id"], 3_000, 100)
    sizes = [r["count"] for r in rows.groupBy(ordered.bin_of(rows, ["a", "id"], cuts).alias("b")).count().collect()]
    assert len(sizes) == 30 and max(sizes) < 300


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(f"s{i:03}", i + d) for i in range(120) for d in (0, 1)] + [("t", 999)], "s string, u int")
    comp = {r.s: r.component for r in joins.source_components(df, "s", "u").collect()}
    assert comp.pop("t") == "t" and set(comp.values()) == {"s000"}


def test_nesting_skips_null_keys_and_fills_missing(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, None, 2.0)], "t int, k string, v double")
    nested = reshape.nest_by_key(df, ["t"], "k", ["v"], "m")
    full = nested.select(reshape.complete_map(F.col("m"), ["a", "b"], ["v"]).alias("m")).first().m
    assert full["a"].v == 1.0 and full["b"].v is None
