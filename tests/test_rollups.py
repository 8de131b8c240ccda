"""Roll-ups merge exactly, and a stream's sums equal those of all its documents at once."""

import random
import statistics

from pyspark.sql import functions as F

from proselake.functions.text import split_sentences
from proselake.plans.rollups import MEASURES, merged, partials, summary
from proselake.streaming.rollups import add_batch, compact, count_stream, totals

BY = ["lang", "source"]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(n, seed=1):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice("The report was written quickly by a team of nice people in towns".split()) for _ in range(rng.randint(1, 40))) + rng.choice([".", "!", ""])
    return [(i, rng.choice([None, "", line(), " ".join(line() for _ in range(6))]), rng.choice(["en", "fr", None]), rng.choice(["a", "b"])) for i in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_groups_and_merges(spark):
    docs = documents(60)
    d = spark.createDataFrame(docs, SCHEMA)
    whole = partials(d, BY)
    names = [*BY, "grouping", *MEASURES]
    assert whole.columns == names
    split = [partials(d.where(F.col("doc_id") % 3 == k), BY) for k in range(3)]
    assert rows(merged(split, BY).select(names)) == rows(whole) == rows(merged(merged(split, BY), BY).select(names))
    chosen = partials(d, BY, sets=[["lang"], []])
    assert rows(chosen) == rows(whole.where("grouping IN (1, 3)"))
    # by hand: documents and lengths of sentences of each group, a null language being a group of its own
    for r in summary(whole, BY).collect():
        mine = [t for _, t, lang, source in docs if (r["grouping"] & 2 or lang == r["lang"]) and (r["grouping"] & 1 or source == r["source"])]
        n = [len(s.split()) for t in mine for s, _ in split_sentences(t or "")]
        assert r["documents"] == len(mine) and r["mean_length"] == int(sum(n) / len(n) * 10 + 0.5) / 10 and abs(r["deviation"] - statistics.pstdev(n)) <= 0.0501
    assert partials(d.limit(0), BY).where("grouping < 3").count() == 0


def test_stream(spark, tmp_path):
    """Files come in three lots; the stream stops and starts again; then its last batch is repeated, and one fails halfway."""
    docs = documents(45, 2)
    d = spark.createDataFrame(docs, SCHEMA)
    want = rows(partials(d, BY))
    source, path, state = (str(tmp_path / x) for x in ("in", "sums", "state"))
    for k in range(3):
        d.where(F.col("doc_id") % 3 == k).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = count_stream(stream, path, BY, state, availableNow=True)
        assert query.awaitTermination(120)
    names = [*BY, "grouping", *MEASURES]
    assert rows(totals(spark, path, BY).select(names)) == want
    # Spark repeats a batch under its number
    add_batch(d.where("doc_id % 3 = 2"), 2, path, BY)
    assert rows(totals(spark, path, BY).select(names)) == want
    compact(spark, path, BY, str(tmp_path / "next"))
    add_batch(d, 0, str(tmp_path / "next"), BY)
    assert rows(totals(spark, str(tmp_path / "next"), BY).select(names)) == rows(merged([partials(d, BY), partials(d, BY)], BY).select(names))
