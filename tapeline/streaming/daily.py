"""An extension: incremental daily counts over a folder that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream; `name` may be one file or a folder of parts."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")


def daily_counts(events: DataFrame, time: str, by: str | None = None) -> DataFrame:
    """Rows per day (and `by`), however late they come: what is kept between runs is one row per day, not the events."""
    keys = [F.col(time).cast("timestamp").cast("date").alias("day"), *([F.col(by)] if by else [])]
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def run_available(counts: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Takes in what has arrived so far, writes the counts to the folder `sink` and stops; the next call goes on from `checkpoint`.

    Both are folders that all executors share. Every call replaces the counts as a whole.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    return counts.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()
