"""A dictionary table of a million words, with hot words, repeated rows, odd entries; no literal in the plan."""

from pyspark.sql import functions as F

from proselake.functions.text import syllables
from proselake.operators import dictionary as D


def test_dictionary_table(spark, monkeypatch):
    monkeypatch.setattr(D, "HOT_WORDS", 2)
    texts = [(1, "The cat qbc qjjjjjj the the table."), (1, "The cat qbc qjjjjjj the the table."), (2, None), (3, ""), (4, "-- ** 4"), (None, "the qh unknowable"), (5, "QBC the " * 50)]
    d = spark.createDataFrame(texts, "doc_id int, text string")
    table = spark.range(1_000_000).selectExpr("concat('q', translate(id, '0123456789', 'abcdefghij')) AS word", "cast(id % 9 AS int) AS syllables").union(spark.createDataFrame([("the", 5), ("the", 4), (None, 3), ("cat", None)], "word string, syllables int"))
    made = D.syllable_totals(d, table)
    known = {"the": 4, "qbc": 12 % 9, "qjjjjjj": 999_999 % 9, "qh": 7}
    words = {w for _, t in texts for w in (t or "").lower().replace(".", "").split() if w.strip("-*0123456789")}
    guess = {r["w"]: r["s"] for r in spark.createDataFrame([(w,) for w in sorted(words)], "w string").select("w", syllables(F.col("w")).alias("s")).collect()}
    want = [(i, sum(known.get(w, guess.get(w, 0)) for w in (t or "").lower().replace(".", "").split())) for i, t in texts]
    # a token of marks or digits alone is no word here
    assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str)
    assert len(made._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    graded = {r["doc_id"]: r for r in D.readability_by(d.where("doc_id IN (1, 2, 5)"), table).collect()}
    assert graded[2]["grade"] is None and graded[1]["words"] == 7 and graded[1]["sentences"] == 1 and graded[5]["syllables"] == 50 * (3 + 4)
    assert D.syllable_totals(d.limit(0), table).count() == 0 and D.syllable_totals(d, table.limit(0)).count() == len(texts)
