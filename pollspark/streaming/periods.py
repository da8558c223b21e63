"""Tumbling periods with a fixed origin over a stream."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, time: str, group: str, value: str, origin: str, days: int,
             out: str, lateness: str = "7 days") -> DataFrame:
    """Count and sum per period and group of everything the stream has now.

    State is one row per open period and group; the watermark closes periods. Updates replace a
    period's row, each batch in its own folder, and reading takes the latest row of a period.
    """
    spark = stream.sparkSession
    shift = (date.fromisoformat(origin) - date(1970, 1, 1)).days % days
    period = F.window(time, f"{days} days", startTime=f"{shift} days")
    agg = (
        stream.withWatermark(time, lateness).groupBy(period.alias("w"), group)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    )

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.select(
            # Days since the epoch, so the session time zone plays no part.
            F.date_add(F.lit("1970-01-01").cast("date"),
                       F.floor(F.unix_seconds("w.start") / 86400).cast("int"))
            .alias("period_start"), group, "n", "total",
            F.lit(batch_id).alias("version"),
        ).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    query = (
        agg.writeStream.outputMode("update").foreachBatch(step)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/data")
    return rows.groupBy("period_start", group).agg(
        F.max_by("n", "version").alias("n"), F.max_by("total", "version").alias("total"))
