"""Counters of a corpus that arrives as a stream: they outlive micro-batches, restarts and repeated batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from proselake.plans.rollups import merged, partials


def add_batch(batch: DataFrame, number: int, path: str, by: list[str], text: str = "text") -> None:
    """Write the sums of one batch below its number. A batch that comes again takes the place of its first time."""
    partials(batch, by, text).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")


def count_stream(stream: DataFrame, path: str, by: list[str], checkpoint: str, text: str = "text", **trigger) -> StreamingQuery:
    """Keep the sums of a stream of documents by group in the folder `path`, which should be shared and used by nothing else.

    Spark numbers batches in `checkpoint` and repeats the one it was in when it comes back, under its number; so each document
    counts once, whatever failed. Sums are small whatever the size of a batch.
    """
    write = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: add_batch(batch, number, path, by, text))
    return (write.trigger(**trigger) if trigger else write).start()


def totals(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """The sums so far, as `partials` would have them over all documents at once."""
    return merged(spark.read.parquet(path).drop("batch"), by)


def compact(spark: SparkSession, path: str, by: list[str], to: str) -> None:
    """Write the sums so far as one batch of a new folder, for a stream that goes on there with a checkpoint of its own."""
    totals(spark, path, by).coalesce(1).write.mode("errorifexists").parquet(f"{to}/batch=-1")
