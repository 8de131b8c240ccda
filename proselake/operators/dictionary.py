"""Syllables by a dictionary that is a table: each distinct word of a corpus is looked up once, however large both are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselake.functions.exact import fused
from proselake.functions.text import bare_text, batches, estimated_syllables, split_text, syllable_sum, tokens, word_counts

#: Words that may be sent to all tasks with their syllables: those that most documents hold.
HOT_WORDS = 1000


def _summed(docs: DataFrame, dictionary: DataFrame, made: dict[str, Column], key: str, text: str) -> DataFrame:
    """(__row, __key, columns of `made`, __y) of each row, with __y the sum of its words' syllables.

    Each row has the sum of its words' estimates; only words of the dictionary leave it, with what their entries differ from these.
    """
    batches(docs.sparkSession)
    d = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), F.col(text).alias("__t"))
    # a document's own repetitions are counted within its row, so a word is one row for each document
    each = d.select("__row", F.explode(word_counts(bare_text("__t"))).alias("__w")).select("__row", F.col("__w.word").alias("word"), F.col("__w.count").alias("__n"))
    # of several entries for a word the least counts
    stated = dictionary.where("word IS NOT NULL AND syllables IS NOT NULL").groupBy("word").agg(F.min(F.col("syllables").cast("long")).alias("__s"))
    more = stated.select("word", (F.col("__s") - estimated_syllables(F.col("word"))).alias("__more")).where("__more <> 0")
    known = each.groupBy("word").agg(F.count("*").alias("__docs")).join(more, "word")
    hot = known.orderBy(F.desc("__docs"), "word").limit(HOT_WORDS).select("word", "__more")
    # frequent words stay where they are; the others meet by an exchange in which no word stands out
    near = each.join(F.broadcast(hot), "word")
    rest = each.join(F.broadcast(hot.select("word")), "word", "left_anti").join(more, "word")
    added = near.unionByName(rest).groupBy("__row").agg(F.sum(F.col("__n") * F.col("__more")).alias("__added"))
    own = d.select("__row", "__key", syllable_sum()(bare_text("__t")).alias("__e"), *(c.alias(n) for n, c in made.items()))
    return own.join(added, "__row", "left").select("__row", "__key", *made, (F.col("__e") + F.coalesce("__added", F.lit(0))).cast("long").alias("__y"))


def syllable_totals(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, syllables) of each row: by the dictionary (word, syllables), else estimated.

    Words are taken in lower case without marks at their edges, and so should the dictionary's be. Null and empty texts have
    none; rows with equal keys stay documents of their own. Rows are told apart by where they stand, so the input should come
    from files or an ordered plan.
    """
    return _summed(docs, dictionary, {}, key, text).select(F.col("__key").alias(key), F.col("__y").alias("syllables"))


def readability_by(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, grade, sentences, words, syllables) of each row by a dictionary as in `syllable_totals`; the grade is null without words."""
    made = {"__tokens": F.size(tokens("__t")).cast("long"), "__sentences": F.size(split_text("__t")).cast("long")}
    n, m, y = F.col("__tokens"), F.col("__sentences"), F.col("__y")
    grade = fused(0.39, n / m, F.lit(11.8) * (y / n)) - F.lit(15.59)
    return _summed(docs, dictionary, made, key, text).select(F.col("__key").alias(key), F.when((n > 0) & (m > 0), grade).alias("grade"), m.alias("sentences"), n.alias("words"), y.alias("syllables"))
