"""Incremental summaries of event streams (an extension: the batch operators need no stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, value: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts, sums and extremes per window and key; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total", "least", "most")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def run_to_end(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Drive a bounded stream to its end into Parquet files in a shared folder, with
    its checkpoint beside them. In complete mode each batch replaces the table;
    in append mode the file sink adds to it."""
    out, state = f"{path}/table", f"{path}/checkpoint"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
