"""The analyses over a stream of documents: stateless, so each micro-batch is the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proselake.plans.analyze import CHECKS, analyze


def analyze_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", checks=CHECKS) -> DataFrame:
    """Reports of parquet documents that arrive in a folder."""
    return analyze(spark.readStream.schema(schema).parquet(path), checks=list(checks))
