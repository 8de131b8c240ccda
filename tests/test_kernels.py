"""What workers count: syllables and words as the column expressions have them, in bounded batches."""

import random
import sys

import pyarrow as pa
from pyspark.sql import functions as F

from proselake.functions import letters
from proselake.functions import text as T
from proselake.operators import dictionary as D
from proselake.operators import words as W
from proselake.plans import queries as Q
from proselake.plans.analyze import analyze


def test_white_space():
    assert {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()} == set(T.WHITE) | set("\x1c\x1d\x1e\x1f")
    assert T.pieces("a\x1cb  c\x1d") == ["a\x1cb", "c\x1d"] and T.pieces(" a　b\x85") == ["a", "b"]


def test_syllables_of_workers(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("aeiouybcdeltnrs'é𝄞-") for _ in range(rng.randint(1, 9))) + rng.choice(["", "e", "le", "ed", "ted", "ded", "te"]) for _ in range(4000)})
    stated = {w: k % 5 for k, w in enumerate(words[::7])}
    d = spark.createDataFrame([(i, " ".join(words[i::50])) for i in range(50)] + [(50, None), (51, "")], "doc_id int, text string")
    for known in (None, stated):
        total = F.aggregate(F.transform(T.bare_tokens("text"), lambda w: T.syllables(w, known)), F.lit(0), lambda a, x: a + x).cast("long")  # noqa: B023
        rows = d.select(total.alias("want"), T.syllable_sum(known)(T.bare_text("text")).alias("got")).collect()
        assert [r["got"] for r in rows] == [r["want"] for r in rows] and rows[0]["got"] > 0
        lists = d.select(T.word_and_syllable_counts(known)(F.array(T.bare_text("text"), F.lit("a le"))).alias("c"), F.size(T.bare_tokens("text")).alias("n")).collect()
        assert [(r["c"][0]["words"], r["c"][0]["syllables"]) for r in lists] == [(r["n"], x["want"]) for r, x in zip(lists, rows, strict=True)]


def test_batches_are_bounded(spark):
    names = [f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    d = spark.createDataFrame([(1, "The the barn.")], "doc_id int, text string")
    table = spark.createDataFrame([("the", 2)], "word string, syllables int")
    before = [spark.conf.get(n) for n in names]
    for make in (lambda: analyze(d), lambda: D.syllable_totals(d, table), lambda: W.overused(d)):
        for n in names:
            spark.conf.unset(n)
        make()
        assert [spark.conf.get(n) for n in names] == [str(T.BATCH_ROWS), str(T.BATCH_BYTES)]
    spark.conf.set(names[0], "7")
    analyze(d)
    assert spark.conf.get(names[0]) == "7"
    for n, x in zip(names, before, strict=True):
        spark.conf.set(n, x)


def test_workers_of_queries_hold_one_bounded_batch(spark, tmp_path):
    def batch(texts: pa.Array) -> pa.Array:
        n = pa.array([len(texts)] * len(texts), pa.int64())
        return pa.StructArray.from_arrays([n, pa.array([texts.nbytes] * len(texts), pa.int64())], ["rows", "bytes"])

    names = [f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(n) for n in names]
    long = "The barn was built. " * 5000
    d = spark.createDataFrame([(i, long if i < 48 else "It was lit.", "en", "a") for i in range(1280)], "doc_id long, text string, lang string, source string")
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    task = spark.read.parquet(f"{tmp_path}/documents.parquet").coalesce(1)
    for query in (Q.grammar, Q.grammar_issues, Q.passive_voice, Q.passive_voice_strict, Q.style):
        for n in names:
            spark.conf.unset(n)
        made = query(spark, str(tmp_path))
        most = task.select(F.arrow_udf(batch, "struct<rows:bigint,bytes:bigint>")("text").alias("b")).agg(F.max("b.rows").alias("rows"), F.max("b.bytes").alias("bytes")).first()
        # the last row of a batch may pass the bound
        assert most["rows"] == T.BATCH_ROWS and 0 < most["bytes"] <= T.BATCH_BYTES + 2 * len(long), query
        if query is Q.grammar:
            got = made.where("doc_id >= 40").agg(F.count("*"), F.max("sentence_count"), F.max("passive_count"), F.min("passive_count")).first()
            assert got[0] == 1240 and got[1] > 5000 and got[2] >= 5000 and got[3] >= 1
    for n, x in zip(names, before, strict=True):
        spark.conf.set(n, x)


def test_only_words_of_the_dictionary_move(spark):
    d = spark.createDataFrame([(1, "the barn stood"), (2, "the mill"), (3, None)], "doc_id int, text string")
    table = spark.createDataFrame([("the", 4), ("mill", 1), ("absent", 9)], "word string, syllables int")
    made = D.syllable_totals(d, table)
    assert sorted(map(tuple, made.collect())) == [(1, 6), (2, 5), (3, 0)]
    # the sentences of a text and its other columns stay out of the words' joins
    plan = D.readability_by(d, table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split_text(") <= 2


def test_repeated_runs():
    w = "a b c d a b c e a b".split()
    assert W.repeated_runs(w) == [("a b", 3), ("a b c", 2), ("b c", 2)] and W.repeated_runs([]) == [] and W.repeated_runs(["a"]) == []
    assert W.repeated_runs(["x"] * 6) == [("x x", 5), ("x x x", 4), ("x x x x", 3)]


def test_consistency_of_texts_with_one_side(spark):
    us, uk, _ = W.lex.SPELLINGS[0]
    d = spark.createDataFrame([(1, f"{us} {uk}"), (2, f"{us}x {uk}"), (3, us), (4, None)], "doc_id int, text string")
    assert [r["n"] for r in d.select(W.consistency()["total_issues"].alias("n")).collect()] == [1, 0, 0, 0]
    assert [r["n"] for r in d.select(W.consistency("text", "en-us")["total_issues"].alias("n")).collect()] == [2, 1, 0, 0]


#: Edges of all kinds: marks, letter numbers, circled letters, vowel signs, digits, what only Python takes for white space.
_EDGES = ["", "", "", ".", ",", "\"", "'", "-", "…", "Ⅷ", "ⓐ", "ा", "\u0301", "3", "½", "\x1c", "(", "ß", "İ", "Σ", "𝄞"]


def _odd_texts(n):
    rng = random.Random(9)
    word = lambda: rng.choice(_EDGES) + "".join(rng.choice("aeEyouybcdelTtnrs") for _ in range(rng.randint(0, 9))) + rng.choice(["", "le", "ed", "the"]) + rng.choice(_EDGES)
    return [rng.choice([" ", "\n", "\u2003"]).join(word() + rng.choice(["", "", ".", "!", "\n\n"]) for _ in range(rng.randint(0, 80))) for _ in range(n)] + [None, "", " \n\n \n\n", "— –"]


def test_counts_of_whole_texts(spark):
    d = spark.createDataFrame(list(enumerate(_odd_texts(60))), "doc_id int, text string")
    for known in (None, {"the": 0, "e": 7, "ῥς": 2}):
        total = F.aggregate(F.transform(T.bare_tokens("text"), lambda w: T.syllables(w, known)), F.lit(0), lambda a, x: a + x).cast("long")  # noqa: B023
        rows = d.select("text", F.size(T.tokens("text")).alias("n"), total.alias("y"), T.text_counts(known)("text").alias("got")).collect()
        for r in rows:
            assert tuple(r["got"]) == (r["n"], r["y"], len(T.split_sentences(r["text"] or ""))), r["text"]
    rows = d.select(T.words("text").alias("w"), T.word_and_glue_counts("text").alias("got"), T.text_counts(cut=False)("text")["sentences"].alias("m")).collect()
    assert [tuple(r["got"]) for r in rows] == [(len(r["w"]), sum(w in W.lex.GLUE for w in r["w"])) for r in rows] and {r["m"] for r in rows} == {None}


def test_counts_of_paragraphs(spark):
    d = spark.createDataFrame(list(enumerate(_odd_texts(60))), "doc_id int, text string")
    each = F.transform(T.paragraphs("text"), lambda p: F.struct(p.alias("p"), F.size(T.words(p)).alias("w"), F.aggregate(F.transform(T.words(p), lambda w: T.syllables(w)), F.lit(0), lambda a, x: a + x).alias("y")))
    some = False
    for r in d.select(each.alias("want"), T.paragraph_counts(None, 8, 1.5)("text").alias("got")).collect():
        for k, (x, p) in enumerate(zip(r["want"], r["got"], strict=True), 1):
            dense = x["w"] > 8 and x["y"] / x["w"] > 1.5
            some = some or dense
            assert tuple(p) == (k, len(T.split_sentences(x["p"])) if dense else None, x["w"], x["y"])
    assert some


def test_readability_takes_one_pass(spark):
    from proselake.operators import sentences as S

    d = spark.createDataFrame([(1, "Rows of boats lay idle. Nobody waited there."), (2, ""), (3, None)], "doc_id int, text string")
    d = d.select("doc_id", S.readability(F.col("text"), None, 12.0).alias("a"), S.readability(F.col("text"), T.split_text("text"), 12.0).alias("b"))
    assert all(r["a"] == r["b"] for r in d.collect())
    # texts go to a worker as they stand, and only counts come back
    plan = d.select("a")._jdf.queryExecution().executedPlan().toString()
    assert "split_text" not in plan and "regexp_replace" not in plan


def test_estimates_of_whole_texts():
    texts = [t for t in _odd_texts(3000) if t] + ["Tree .le e.le (ale) led 'ed. x. -- 7 shh a.e", "Être élevé né…", "e" * 9, "İe ile", "d..e..ed ne"]
    for text in texts:
        want = sum(map(T.estimate, filter(None, map(letters.bare, T.pieces(text)))))
        assert letters.estimated_sum(text) == (None if "İ" in text else want), text
