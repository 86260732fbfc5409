"""Incremental indexing with Structured Streaming: new documents become postings as they arrive.

An addition to the batch build. Each micro-batch overwrites its own folder, so that a batch
that is repeated after a failure is not counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from marlstone.operators.search import postings


def index_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "doc_id", field: str = "text") -> StreamingQuery:
    """Follow a folder of Parquet files and write the postings of new rows below ``target``."""
    rows = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        postings(batch, key, (field,)).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(64)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type, value) of each type in tumbling windows; later ones than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
