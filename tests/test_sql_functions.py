"""SQL functions give what the columns give, and become part of the plan that calls them."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.functions.sql import register
from proselake.operators import documents as D
from proselake.plans import queries as Q


@pytest.fixture(scope="module")
def docs(spark):
    register(spark)
    rows = [(1, "It's a *cat's* tail. Cats' tails are here!\n\n  Two tables. \n\n \n\n# Made"), (2, None), (3, ""), (4, "é-à 'tis -- x y")]
    return spark.createDataFrame(rows, "doc_id int, text string")


def test_scalars(spark, docs):
    got = spark.sql("SELECT words(text), paragraphs(text), sentences(text), prose(text), headings(text), token_count(text) FROM {d}", d=docs)
    want = docs.select(T.words("text"), T.paragraphs("text"), T.split_text("text"), D.prose("text"), D.headings("text"), F.octet_length(T.text_of("text")).cast("long"))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    known = spark.createDataFrame([(w,) for w in ("table", "made", "needed", "the", "y", "", None, "queue", "aioli", "whistled", "little")], "word string")
    got = known.select(F.expr("syllables(word)"), F.when(F.col("word").isNull(), 0).otherwise(T.syllables(F.col("word")))).collect()
    assert all(a == b for a, b in got)


def test_tables(spark, docs):
    got = spark.sql("SELECT doc_id, pos, word FROM {d}, LATERAL each_word(text)", d=docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, docs.select("doc_id", F.posexplode(T.words("text"))).collect()))
    got = spark.sql("SELECT doc_id, num, sentence, line FROM {d}, LATERAL each_sentence(text)", d=docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, docs.select("doc_id", F.explode(T.split_text("text")).alias("s")).select("doc_id", "s.*").collect()))
    assert spark.sql("SELECT count(*) FROM {d}, LATERAL each_paragraph(text)", d=docs).first()[0] == 4


@pytest.mark.parametrize(("call", "column"), [("words(text)", "words"), ("paragraphs(text)", "paragraphs")])
def test_plans(spark, docs, call, column):
    plan = lambda df: re.sub(r"#\d+|lambda \w+|x_\d+", "", df._jdf.queryExecution().optimizedPlan().toString())
    assert plan(spark.sql(f"SELECT {call} AS c FROM {{d}}", d=docs)) == plan(docs.select(getattr(T, column)("text").alias("c")))


def test_texts_without_words(spark, tmp_path):
    """They have no last word; the registered query gives them a row as its SQL does."""
    texts = ["", " \n\n \t", "** !!", "?\n...\n(*)", "\u00a0", "A.", "The mill.\n\nIt runs -- on\nwater."]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = Q.sql_kernels(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(Q.SQL["sql_kernels"]).fetchall())
    assert {r["doc_id"] for r in got if r["last_md5"] is None} == {0, 1, 2, 3, 4}
