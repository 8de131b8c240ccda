"""Roll-ups of a corpus: sums of whole numbers for each group, which merge exactly, and what follows from them.

`measures` gives each document its counts, `partials` sums them by group, in any of several groupings at once, and `merged` adds up
partial tables of any number of loads or micro-batches. All sums are integers, so the order and the split do not matter; only
`summary` divides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselake.functions.exact import fused
from proselake.functions.text import batches, round1, sentences, text_counts, text_of, word_and_glue_counts
from proselake.operators import sentences as S

#: What is counted of a document; `length_squares` sums the squares of its sentences' lengths in words.
MEASURES = ("documents", "tokens", "words", "syllables", "sentences", "lengths", "length_squares", "passives", "issues", "glue_words", "long_sentences")
_WIDE = "decimal(38,0)"


def measures(docs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by..., counts...) of each row: narrow. A null text counts as a document without words."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    batches(docs.sparkSession)
    d = docs.select(*by, sentences(text).alias("__s"), word_and_glue_counts(text_of(text)).alias("__w"), text_counts(cut=False)(text_of(text)).alias("__c"))
    d = d.withColumn("__n", F.transform("__s", lambda s: F.size(s["words"]).cast("long")))
    n = {
        "documents": F.lit(1), "tokens": F.col("__c.tokens"), "words": F.col("__w.words"), "syllables": F.col("__c.syllables"), "sentences": F.size("__s"), "lengths": total(F.col("__n")),
        "length_squares": total(F.transform("__n", lambda x: x * x)), "passives": F.size(S.passives(F.col("__s"))), "issues": F.size(S.grammar_issues(F.col("__s"))),
        "glue_words": F.col("__w.glue"), "long_sentences": F.size(F.filter("__n", lambda x: x > 30)),
    }
    return d.select(*by, *(n[m].cast("long").alias(m) for m in MEASURES))


def _sums() -> list[Column]:
    return [F.sum(F.col(m).cast(_WIDE)).cast(_WIDE).alias(m) for m in MEASURES]


def partials(docs: DataFrame, by: list[str], text: str = "text", sets: list[list[str]] | None = None) -> DataFrame:
    """(by..., grouping, sums...): a row for each group of each grouping set; without `sets` of every subset of `by`.

    `grouping` has a bit for each column of `by`, the first one highest, which is set where the column is summed over; so a
    null that stands for all is told from a null in the data. Sums are taken in each task before rows move.
    """
    m = measures(docs, by, text)
    if sets is None:
        return m.cube(*by).agg(F.grouping_id().cast("long").alias("grouping"), *_sums())
    # one pass over the counts of the finest groups serves all sets
    finest = m.groupBy(*by).agg(*_sums())
    grouped = finest.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in by))
    return grouped.agg(F.grouping_id().cast("long").alias("grouping"), *_sums()).select(*by, "grouping", *MEASURES)


def merged(tables: list[DataFrame] | DataFrame, by: list[str]) -> DataFrame:
    """Partial tables added up: the same as `partials` over all their documents together."""
    whole = tables if isinstance(tables, DataFrame) else reduce(DataFrame.unionByName, tables)
    return whole.groupBy(*by, "grouping").agg(*_sums())


def summary(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., grouping, documents, words, mean_length, deviation, grade, passive_percentage, glue_index, issues_per_100) of each group."""
    d = lambda c: F.col(c).cast("double")
    ratio = lambda a, b, k: F.when(F.col(b) > 0, round1(d(a) / d(b) * k))
    # n times the squares, less the square of the sum, is a whole number until the root is taken
    spread = (F.col("sentences") * F.col("length_squares") - F.col("lengths") * F.col("lengths")).cast("double")
    grade = fused(0.39, d("tokens") / d("sentences"), F.lit(11.8) * (d("syllables") / d("tokens"))) - F.lit(15.59)
    return parts.select(
        *by, "grouping", F.col("documents").cast("long").alias("documents"), F.col("words").cast("long").alias("words"), ratio("lengths", "sentences", 1).alias("mean_length"),
        F.when(F.col("sentences") > 0, round1(F.sqrt(spread) / d("sentences"))).alias("deviation"), F.when((F.col("tokens") > 0) & (F.col("sentences") > 0), round1(grade)).alias("grade"),
        ratio("passives", "sentences", 100).alias("passive_percentage"), ratio("glue_words", "words", 100).alias("glue_index"), ratio("issues", "sentences", 100).alias("issues_per_100"),
    )
