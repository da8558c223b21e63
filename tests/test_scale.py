"""Properties of plans that matter on large tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from pollspark.catalogue.base import draws, table
from pollspark.operators import ordered, quantiles, rows

QUERIES = entry_module.queries()
# These write and read when called; what they return is a plain scan.
EAGER = {"stream_dedup", "stream_periods", "stream_routes", "document_rules", "source_files"} | {
    n for n in QUERIES if n.startswith(("job_", "snapshot_"))}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def conf(spark):
    """Set options for one test."""
    old = {}

    def put(**options):
        for k, v in options.items():
            k = k.replace("__", ".")
            old[k] = spark.conf.get(k, None)
            spark.conf.set(k, v)
    yield put
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_row_python_and_no_wide_product(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "BatchEvalPython" not in text
    # Products only with a one-row aggregate or a fixed list on one side.
    assert "CartesianProduct" not in text


def test_lookup_side_is_not_hinted(spark, sf, conf):
    conf(**{"spark__sql__autoBroadcastJoinThreshold": "-1"})
    text = plan(QUERIES["period_share"](spark, sf))
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text


def test_hot_lookup_key_is_split(spark, sf, tmp_path, conf):
    """With a key that holds a third of the lines, adaptive execution splits its partition."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    many = lines.crossJoin(spark.range(20)).withColumn(
        "l_partkey", F.when(F.col("id") < 7, 1).otherwise(F.col("l_partkey"))).drop("id")
    many.repartition(16).write.parquet(f"{tmp_path}/lineitem.parquet")
    table(spark, sf, "part").write.parquet(f"{tmp_path}/part.parquet")
    conf(**{"spark__sql__autoBroadcastJoinThreshold": "-1",
            "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
            "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20KB",
            "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
            "spark__sql__adaptive__advisoryPartitionSizeInBytes": "20KB"})
    df = QUERIES["harmonise_parties"](spark, str(tmp_path))
    total = df.agg(F.sum("votes")).collect()[0][0]
    assert total > 0
    df.collect()
    assert "skew=true" in plan(df)


def test_scan_reads_only_needed_columns(spark, sf):
    text = plan(QUERIES["period_share"](spark, sf))
    schemas = [s.split(">")[0] for s in text.split("ReadSchema: struct<")[1:]]
    assert "l_orderkey:bigint,l_partkey:bigint,l_quantity:double" in schemas
    assert "p_partkey:bigint,p_type:string" in schemas
    assert "o_orderkey:bigint,o_orderdate:timestamp_ntz" in schemas


def test_filters_reach_the_scan(spark, sf):
    text = plan(QUERIES["allow_and_bounds"](spark, sf))
    pushed = text.split("PushedFilters: ")[1].split("ReadSchema")[0]
    assert "In(p_type" in pushed and "StringContains(p_name" in pushed


def test_copies_are_combined_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit("same").alias("k"), F.col("id").alias("o"))
    text = plan(rows.keep_first(df, ["k"], ["o"]))
    assert "partial_min" in text and "Window" not in text


def test_hot_key_never_fills_one_group(spark):
    """Two thirds of the rows under one key: groups of the scan stay near the bin size."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("key"),
        F.col("id").alias("o"), F.lit(1).alias("v"))
    hot = ordered.hot_keys(df, ["key"], ["o"], 30_000, 1000)
    assert [tuple(r) for r in hot.collect()] == [(0,)]
    flagged = ordered.flag_hot(df, ["key"], hot, "hot").where("hot")
    cuts = ordered.cut_points(flagged, ["o"], 30_000, 1000)
    sizes = flagged.groupBy(ordered.bin_of(df, ["o"], cuts).alias("b")).count()
    assert sizes.agg(F.max("count")).first()[0] < 2000
    out = ordered.running_sum(df, ["key"], ["o"], F.col("v"), "s", 30_000, 1000)
    assert out.where("key = 0").agg(F.max("s"), F.count_distinct("s")).first() == (20_000, 20_000)
    assert out.where("key <> 0").agg(F.max("s")).first()[0] == 1 and out.count() == 30_000


def test_small_groups_keep_the_plain_way(spark, sf):
    """A large table of small groups is not ranked over bins."""
    d = draws(spark, sf)
    q = quantiles.exact_quantiles(d, ["t", "party"], "value", [0.5], ["m"], 10**9, 10_000)
    assert "percentile" in plan(q) and "Window" not in plan(q)
    ranked = quantiles.exact_quantiles(d, ["party"], "value", [0.5], ["m"], 10**9, 100, 1000)
    assert "percentile" not in plan(ranked)


def test_extra_aggregates_on_both_ways(spark, sf):
    d = draws(spark, sf)
    extra = {"mean": F.avg("value")}
    a, b = (quantiles.exact_quantiles(d, ["party"], "value", [0.5], ["m"], 6000, limit, 500, extra)
            for limit in (10**6, 0))
    r = lambda x: sorted((y.party, y.n, round(y.m, 9), round(y["mean"], 9)) for y in x.collect())
    assert r(a) == r(b)


def test_ranked_quantiles_keep_groups_without_values(spark):
    from pyspark.sql import functions as F

    from pollspark.operators.quantiles import exact_quantiles

    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 5.0)], "g string, x double")
    extra = {"rows": F.count(F.lit(1))}
    small, large = (
        sorted(map(str, exact_quantiles(df, ["g"], "x", [0.5], ["m"], 4, one_task_rows=limit, rows_per_bin=1, extra=extra).collect()))
        for limit in (100, 0))
    assert small == large and len(small) == 3


def test_cut_points_leave_no_tail(spark):
    from pollspark.operators.ordered import bin_of, cut_points

    df = spark.range(20_000).selectExpr("id % 7919 AS x", "id")
    cuts = cut_points(df, ["x", "id"], 20_000, 100)
    counts = [r["count"] for r in df.groupBy(bin_of(df, ["x", "id"], cuts).alias("bin")).count().collect()]
    assert len(counts) > 150 and max(counts) < 4 * sum(counts) / len(counts)


def test_trailing_weights_stay_at_their_position(spark):
    from pollspark.operators.series import weighted_trailing

    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 4.0)], "t long, x double").selectExpr("'k' AS k", "*")
    got = {r.t: r.w for r in weighted_trailing(df, ["k"], "t", "x", [0.5, 0.3, 0.2], "w").collect()}
    assert abs(got[4] - 0.8) < 1e-12


def test_bins_of_bins_are_even(spark, monkeypatch):
    """More bins than literal cut points: the largest stays under three times the mean."""
    monkeypatch.setattr(ordered, "LITERALS", 16)
    df = spark.range(40_000).select((F.col("id") * F.col("id") % 40_009).alias("o"), "id")
    binned, two = ordered.with_bins(df, df, ["o", "id"], 40_000, 100)
    sizes = binned.groupBy("__bin", "__sub").count()
    n, most = sizes.agg(F.count("*"), F.max("count")).first()
    assert two and n > 200 and most < 3 * 40_000 / n
    values = {"s": ("sum", F.col("id")), "m": ("max", F.col("id")), "n": ("min", F.col("id")), "p": ("lag", F.col("id"))}
    for keys, reverse in (([], False), ([], True), (["k"], False), (["k"], True)):
        rows = df.withColumn("k", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2))
        a = ordered.scan(rows, keys, ["o", "id"], values, 40_000, 100, reverse)
        b = ordered.scan(rows, keys, ["o", "id"], values, 40_000, reverse=reverse)
        assert a.exceptAll(b).isEmpty() and a.count() == 40_000


def test_nearest_marker_sorts_the_facts_once(spark, sf):
    text = plan(QUERIES["nearest_event"](spark, sf))
    assert text.count("Exchange") == 1 and text.count("Sort ") == 1


def test_days_after_the_calendar_are_kept(spark, sf, tmp_path):
    o = table(spark, sf, "orders")
    o.withColumn("o_orderdate", F.col("o_orderdate") + F.expr("INTERVAL 9 YEARS")).write.parquet(f"{tmp_path}/orders.parquet")
    df = QUERIES["month_floor_grid"](spark, str(tmp_path))
    assert df.agg(F.sum("n_polls")).first()[0] == o.count()
