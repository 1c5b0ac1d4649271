"""Delay updates as a stream: files of updates in, the last update of each trip kept as state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delays import latest
from ..storage import shared_dir

SCHEMA = "trip long, first_idx long, delay long, reveal_time long"


def follow(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Reads all update files of ``folder`` as a stream, ``files`` in a micro-batch, and returns the last delay of each trip.

    State is one row per trip.  A micro-batch writes the trips it changed, so a restarted query repeats at most one batch.
    """
    home = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    updates = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)
    last = F.max_by(F.struct("first_idx", "delay", "reveal_time"), F.struct("reveal_time", "first_idx", "delay"))
    state = updates.groupBy("trip").agg(last.alias("u")).select("trip", "u.*")

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{home}/changes/batch={batch}")

    query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return latest(spark.read.schema(SCHEMA).parquet(f"{home}/changes"))


def counts_by_window(spark: SparkSession, folder: str, schema: str, time: str, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Rows of a stream of files per window of event time; a window closes once the watermark has passed it, or at the stream's end."""
    home = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    rows = spark.readStream.schema(schema).parquet(folder).withWatermark(time, lateness)
    counted = rows.groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("start"), "events")

    def write(changed: DataFrame, batch: int) -> None:
        changed.withColumn("n", F.lit(batch)).write.mode("overwrite").parquet(f"{home}/changes/batch={batch}")

    query = counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("start timestamp, events long, n int").parquet(f"{home}/changes").groupBy("start").agg(F.max_by("events", "n").alias("events"))
