"""Streams: event counts by window, incremental ingest of chunk files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merging import upsert
from ..session import run_folder


def windowed_counts(spark: SparkSession, path: str, schema, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total): tumbling counts of a Parquet stream, run to its end; late rows beyond the
    watermark are dropped, as the stream's definition says, which one batch of files never meets."""
    folder = f"{run_folder(spark)}/stream-{uuid.uuid4().hex}"
    parent, name = path.rsplit("/", 1)
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not name.endswith(".parquet") else f"{parent}/{name}*")
    counts = (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))
    )
    out = f"{folder}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    # a window that several batches touched: the last state holds
    return found.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("s")).select("window_start", "event_type", "s.n", "s.total")


def ingest_batch(store: DataFrame, arrived: DataFrame, order: list) -> DataFrame:
    """What foreachBatch does with arrived chunk rows: the last of each chunk_id replaces what the store has; repeated
    delivery changes nothing."""
    return upsert(store, arrived, ["chunk_id"], order)
