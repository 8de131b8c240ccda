"""A corpus pipeline of five operators: quality rules, near-duplicates, repeats, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of `documents`, with `n_chars` brought up to date where a stage changes the text and there is such a column.
Every stage gives an empty table for an empty one, and keeps columns of any name; what it does with null and empty
texts, ties and repeated rows stands with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.llm.decontaminate import uncontaminated
from proselake.llm.near_duplicates import drop_near_duplicates
from proselake.llm.packing import pack
from proselake.llm.quality import passing
from proselake.llm.repeats import drop_repeats
from proselake.llm.shared import settle, table, temporary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null and empty texts have too few words and go; repeated rows are judged alike."""
    return passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id, of repeated rows the first met.

    Null and empty texts are like nothing and stay.
    """
    return drop_near_duplicates(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that occur twice; those of which nothing is left go, as do null and empty
    texts. Repeated rows are repeats of each other: from 200 bytes on, nothing is left of them.
    """
    out = drop_repeats(docs).where(F.length("text") > 0)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and empty texts have none and stay; so do repeated rows."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1,024 ids. A null or empty text is its end id alone; each of
    several repeated rows has its own place.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next one; what a stage wrote on its way goes
    once its result stands in files."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark) as done:
            docs = done(settle(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express tokenization; a test holds all stages against plain versions of them instead.
ORACLE_SQL = None
