"""Merging of runs as they arrive: the last row of each key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(stream: DataFrame, key: str, order: str) -> DataFrame:
    """A streaming frame with the row of largest ``order`` for each key; state is one row a key."""
    rest = [c for c in stream.columns if c != key]
    return stream.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("m")).select(key, "m.*")


def upsert_to_parquet(stream: DataFrame, key: str, order: str, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's changed keys as a table of its own, named by batch, so that a repeated batch overwrites itself."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return latest(stream, key, order).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def read_merged(spark, path: str, key: str, order: str) -> DataFrame:
    return latest(spark.read.parquet(path).drop("batch"), key, order)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts in tumbling windows; rows later than ``late`` don't count and closed windows' state is dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
