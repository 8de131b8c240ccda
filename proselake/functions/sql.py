"""The text kernels as SQL functions: those with a SQL body become part of the plan that calls them, others are Arrow functions.

After ``register(spark)`` a session has ``words(text)``, ``paragraphs(text)``, ``syllables(word)``, ``sentences(text)``,
``prose(text)``, ``headings(text)`` and ``token_count(text)``, and the table functions ``each_word(text)``, ``each_paragraph(text)``
and ``each_sentence(text)``, to be joined by LATERAL. A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from proselake.functions.text import _MARK, batches, split_sentences

_TRIMMED = r'regexp_replace({x}, R"(?U)^\s+|\s+$", "")'
_WORDS = rf'''array_remove(split(lower(regexp_replace(coalesce(text, ""), R"(?U)(?<!\S){_MARK}+|{_MARK}+(?!\S)", "")), R"(?U)\s+"), "")'''
_PARAGRAPHS = rf'''filter(transform(split(coalesce(text, ""), "\n\n"), p -> {_TRIMMED.format(x="p")}), p -> p <> "")'''


def _syllables() -> str:
    """The estimate: groups of vowels, less a silent e, with a final -le, less a final -ed, and at least one."""
    groups = 'size(regexp_extract_all(word, "[aeiouy]+", 0))'
    silent = f'CASE WHEN endswith(word, "e") AND {groups} > 1 AND NOT word RLIKE "[ldtn]e$" THEN 1 ELSE 0 END'
    n = f'({groups} - {silent} + CASE WHEN word RLIKE "[^aeiouy]le$" THEN 1 ELSE 0 END)'
    return f'CASE WHEN word IS NULL OR word = "" THEN 0 ELSE greatest({n} - CASE WHEN endswith(word, "ed") AND {n} > 1 AND NOT word RLIKE "[td]ed$" THEN 1 ELSE 0 END, 1) END'


_SCALARS = {"words": ("text STRING", "ARRAY<STRING>", _WORDS), "paragraphs": ("text STRING", "ARRAY<STRING>", _PARAGRAPHS), "syllables": ("word STRING", "INT", _syllables())}
_TABLES = {"each_word": ("pos INT, word STRING", _WORDS), "each_paragraph": ("pos INT, paragraph STRING", _PARAGRAPHS)}


class _EachSentence:
    def eval(self, text: str):
        for k, (sentence, line) in enumerate(split_sentences(text or "")):
            yield k + 1, sentence, line


def register(spark: SparkSession, vocabulary: list[str] | None = None) -> None:
    """Give a session the functions. Tokens are counted by the vocabulary, without one as bytes; functions of these names
    that the session has of its own are replaced.
    """
    from proselake.functions.text import split_text
    from proselake.operators import documents as D

    batches(spark)
    for name, (given, kind, body) in _SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {kind} RETURN {body}")
    for name, (columns, body) in _TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS TABLE ({columns}) RETURN SELECT pos, col FROM posexplode({body})")
    spark.udf.register("sentences", split_text)
    spark.udf.register("prose", D.prose_function())
    spark.udf.register("headings", D.headings_function())
    if vocabulary:
        spark.udf.register("token_count", D.greedy_count(vocabulary))
    else:
        spark.sql('CREATE OR REPLACE TEMPORARY FUNCTION token_count(text STRING) RETURNS BIGINT RETURN CAST(octet_length(coalesce(text, "")) AS BIGINT)')
    spark.udtf.register("each_sentence", F.udtf(_EachSentence, returnType="num int, sentence string, line int"))
