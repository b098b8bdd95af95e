"""Documents as they arrive: a directory stream, extraction without state, templates learnt batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.templates import learn


def arriving(spark: SparkSession, path: str, schema: str, format: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """Rows of files that land in a folder."""
    return spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_per_trigger).load(path)


def extract_each_batch(source: DataFrame, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch through an extractor of DataFrames, appended under out/batch=<id>: a batch that is run again after a
    failure replaces its own folder, so each document is written once."""

    def write(batch: DataFrame, number: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def learn_each_batch(source: DataFrame, records: Callable[[DataFrame], DataFrame], store: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Every micro-batch of records upserted into a versioned template store: version n+1 is written from version n."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(schema).parquet(f"{store}/v={number - 1}") if number else spark.createDataFrame([], schema)
        learn(old, records(batch)).write.mode("overwrite").parquet(f"{store}/v={number}")

    return source.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, kind: Column, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, kind, n) of a stream with a timestamp ts: tumbling windows, closed once the watermark has passed."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", length), kind.alias("kind")).agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("window_start"), "kind", "n")
