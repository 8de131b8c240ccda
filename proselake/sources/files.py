"""Whole text files as documents, and reports as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.functions.text import MAX_BYTES


def read_texts(spark: SparkSession, path: str, limit: int | None = MAX_BYTES, pattern: str = "*") -> DataFrame:
    """(path, size, text, error) of every file below a folder of any store that Spark reads.

    A file over `limit` bytes gives an error and no text, one that is not UTF-8 likewise; no limit with None.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    # the filter on the length reaches the reader, so no larger file is opened; of those only names and sizes are listed
    read = found if limit is None else found.where(F.col("length") <= limit)
    good = F.coalesce(F.is_valid_utf8(F.col("content").cast("string")), F.lit(True))
    out = read.select("path", F.col("length").alias("size"), F.when(good, F.decode("content", "UTF-8")).alias("text"), F.when(~good, F.lit("input is not UTF-8")).alias("error"))
    if limit is None:
        return out
    error = F.format_string(f"input of %d bytes is over the limit of {limit}", "length")
    large = found.select("path", "length").where(F.col("length") > limit)
    return out.union(large.select("path", F.col("length").alias("size"), F.lit(None).cast("string").alias("text"), error.alias("error")))


def as_json(reports: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, report): each row's other columns as one JSON text, absent reports left out."""
    return reports.select(key, F.to_json(F.struct(*(c for c in reports.columns if c != key))).alias("report"))


def write_json(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line, absent reports left out."""
    reports.write.mode(mode).option("ignoreNullFields", "true").json(path)
