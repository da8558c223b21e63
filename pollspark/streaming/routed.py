"""A stream whose every row comes out once, under a route: new, repeated, late or broken.

A row is broken if it lacks its key, source or time, or a rule of the caller names a fault. It is late if its time lies
more than the allowed lateness before the latest time that earlier batches have seen of its source: each source has its
own watermark, so a source that fails or falls behind holds up no other. It is repeated if its key is known or stands
earlier in the batch. Nothing is dropped: late and broken rows are the side output of the same query.

State is the buckets of known keys and one row per source; both are commits named by the batch, so a batch that runs
again after a failure sees the state before it and replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pollspark.operators.joins import same_keys
from pollspark.sources.snapshots import SnapshotTable
from pollspark.streaming.known_ids import BUCKETS, KnownIds

ROUTES = ("new", "repeated", "late", "broken")
_SEEN = T.StructType([T.StructField("source", T.StringType()), T.StructField("seen", T.TimestampType()), T.StructField("part", T.IntegerType())])


def route_batch(batch: DataFrame, out: str, key: str, source: str, time: str, order: list[str], lateness: str,
                fault: Column, batch_id: int, buckets: int = BUCKETS) -> None:
    """Write the rows of one batch with ``route`` and ``fault``; ``order`` makes the first of equal keys the new one."""
    spark, name = batch.sparkSession, f"batch-{batch_id}"
    ids, marks, table = KnownIds(spark, f"{out}/ids", buckets), SnapshotTable(spark, f"{out}/seen", "part"), SnapshotTable(spark, f"{out}/rows", "route")
    ids.compact(without=name)
    lacking = F.when(F.col(key).isNull(), "no key").when(F.col(source).isNull(), "no source").when(F.col(time).isNull(), "no time")
    rows = batch.withColumn("fault", F.coalesce(lacking, fault))

    # One row per source and batch, the later batches holding the maximum of all before.
    seen = marks.read(_SEEN, without=name).groupBy("source").agg(F.max("seen").alias("__seen")).withColumnRenamed("source", source)
    with_mark = same_keys(rows, seen, [source], "left")
    late = F.coalesce(F.col(time) < F.col("__seen") - F.expr(f"INTERVAL {lateness}"), F.lit(False))
    judged = with_mark.withColumn("route", F.when(F.col("fault").isNotNull(), "broken").when(late, "late")).drop("__seen")

    # Of the rows in time the first of each key that is not known is new: a minimum per key, so copies meet on the map side.
    timely = judged.where("route IS NULL")
    first = timely.groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    fresh = ids.unseen(first, key, name, source=batch.where(F.col(key).isNotNull())).select(F.col(key).alias("__key"), "__first")
    is_first = (F.col(key) == F.col("__key")) & (F.struct(*order) == F.col("__first"))
    routed = judged.join(fresh, is_first & F.col("route").isNull(), "left") \
        .withColumn("route", F.coalesce("route", F.when(F.col("__key").isNotNull(), "new").otherwise("repeated"))).drop("__key", "__first")
    table.append(routed.select(*batch.columns, "fault", "route"), name)

    written = table.read(_schema(batch.schema), only=name)
    sound = written.where("route <> 'broken'")
    marks.append(sound.groupBy(F.col(source).alias("source")).agg(F.max(time).cast("timestamp").alias("seen")).withColumn("part", F.lit(0)), name)
    ids.add(written.where("route = 'new'"), key, name)


def _schema(of: T.StructType) -> T.StructType:
    return T.StructType([*of.fields, T.StructField("fault", T.StringType()), T.StructField("route", T.StringType())])


def read(spark: SparkSession, out: str, schema: T.StructType, route: str | None = None) -> DataFrame:
    """Routed rows; one route reads only its own folders."""
    return SnapshotTable(spark, f"{out}/rows", "route").read(_schema(schema), parts=None if route is None else [route])


def run(stream: DataFrame, out: str, key: str, source: str, time: str, order: list[str], lateness: str, fault: Column) -> None:
    """Route everything the stream has now, batch by batch, then stop."""
    def step(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            route_batch(batch, out, key, source, time, order, lateness, fault, batch_id)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
