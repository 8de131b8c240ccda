"""Phrases and pieces by automata against plain searches."""

import random

from pyspark.sql import functions as F

from proselake.functions import kept as K
from proselake.functions.phrases import PhraseSet, phrase_counts
from proselake.operators import documents as D
from proselake.operators import words as W


def test_counts():
    """As `str.count` has them: leftmost, no overlaps of a phrase's own, others do not matter."""
    rng = random.Random(3)
    for _ in range(300):
        listed = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 4))) for _ in range(8)]
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 60)))
        found = PhraseSet(listed).found(text)
        assert [found.get(k, 0) for k in range(8)] == [text.count(p) if p else 0 for p in listed]


def test_phrase_tables(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 200))) for _ in range(60)] + [None, ""]
    listed = sorted({"".join(rng.choice("abcé ") for _ in range(rng.randint(1, 5))) for _ in range(80)})
    d = spark.createDataFrame([(i if i % 7 else 0, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, phrase string")
    want = sorted((i if i % 7 else 0, p, t.count(p)) for i, t in enumerate(texts) for p in listed if t and p in t)
    table = spark.createDataFrame([(p,) for p in [*listed, None, "", listed[0]]], "phrase string")
    for bound in (4 << 20, 20):
        monkeypatch.setattr(W, "PHRASE_BYTES", bound)
        for given in ([*listed, "", listed[0]], table):
            assert sorted(tuple(r) for r in W.phrases(d, given).collect()) == want
    assert W.phrases(d, []).count() == 0 and W.phrases(d.limit(0), listed).count() == 0
    assert d.select(phrase_counts(listed)("text")).first()[0] == [(texts[0] or "").count(p) for p in listed]


def test_large_vocabulary(spark, tmp_path):
    """40,000 pieces count as a longest match over bytes does, and a worker makes their automaton once."""
    rng = random.Random(5)
    pieces = {"".join(rng.choice("abcdefghijé ") for _ in range(rng.randint(1, 7))) for _ in range(45_000)}
    pieces = sorted(pieces)[:40_000]
    known = {p.encode() for p in pieces}
    texts = ["".join(rng.choice("abcdefghijké ") for _ in range(rng.randint(0, 120))) for _ in range(200)]

    def plain(text):
        data, at, n = text.encode(), 0, 0
        while at < len(data):
            at += next((k for k in range(min(16, len(data) - at), 0, -1) if data[at : at + k] in known), 1)
            n += 1
        return n

    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    got = d.select("text", D.greedy_count(pieces)("text")).collect()
    assert {t: n for t, n in got} == {t: plain(t) for t in texts}


def test_kept():
    made = []
    one = lambda k: K.kept(("test", k), lambda: made.append(k) or k, room=2)
    assert [one(k) for k in (1, 2, 1, 3, 1, 2)] == [1, 2, 1, 3, 1, 2] and made == [1, 2, 3, 2]
    for k in (1, 2, 3):
        K._KEPT.pop(("test", k), None)


def test_shared_columns(spark):
    """The reports are the same with a column of counts that a plan has already."""
    text = "At the end of the day we had a bit of a synergy. " + " ".join(W.PHRASES) * 2
    d = spark.createDataFrame([(text,), (None,)], "text string").withColumn("c", W.phrase_column("text"))
    for f in (W.cliches, W.diction, W.jargon, W.style):
        a, b = (d.select(f("text", **extra).alias("r")).collect() for extra in ({}, {"counts": F.col("c")}))
        assert a == b
