"""Resumable extraction as a stream: each batch of new chunks is taken once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "id long, document_id long, content string, page_number int"


def run_available(spark: SparkSession, source: str, schema: str, process: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> int:
    """Process the files of `source` that came since the last run, and append the results to `sink`.

    The stream's checkpoint records which files a batch has; a batch that is
    run again after a failure writes the same folder anew, so nothing is
    skipped or doubled.  Returns the number of batches of this run.
    """
    done = []

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        done.append(number)

    q = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len(done)


def progress_counts(spark: SparkSession, source: str, schema: str, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """A stream of (start, status, n): recorded states per window of updated_at, with rows that come later than `late` left out."""
    s = spark.readStream.schema(schema).parquet(source).withWatermark("updated_at", late)
    return s.groupBy(F.window("updated_at", window).alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "status", "n")
