"""The composite analysis: one nullable struct column per requested check, narrow, and the gates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselake.functions.text import MAX_BYTES, batches, paragraph_counts, sentences, stripped, text_of, too_large, words
from proselake.operators import sentences as S
from proselake.operators import words as W
from proselake.operators.documents import prose, token_report

#: The report of each check: the contract of all results, also where a check is not asked for.
REPORTS = {
    "readability": "struct<grade:double,sentences:bigint,words:bigint,syllables:bigint,max_grade:double,over_max:boolean>",
    "grammar": (
        "struct<issues:array<struct<issue_type:string,message:string,sentence_num:int,severity:string>>,"
        "passive_voice:array<struct<text:string,confidence:double,sentence_num:int,auxiliary:string,participle:string,has_by_phrase:boolean>>,"
        "passive_count:bigint,passive_percentage:double,sentence_count:bigint,passive_max:double,over_max:boolean>"
    ),
    "sticky": "struct<overall_glue_index:double,sticky_count:bigint,semi_sticky_count:bigint,sticky_sentences:array<struct<sentence_num:int,glue_percentage:double,text:string>>>",
    "pacing": "struct<fast_percentage:double,medium_percentage:double,slow_percentage:double>",
    "sentence_length": "struct<avg_length:double,std_deviation:double,variety_score:double,shortest:bigint,longest:bigint,very_long:array<struct<sentence_num:int,word_count:bigint>>>",
    "transitions": "struct<sentences_with_transitions:bigint,transition_percentage:double,total_transitions:bigint,unique_transitions:bigint,most_common:array<struct<transition:string,count:bigint>>>",
    "overused": "struct<overused_words:array<struct<word:string,count:bigint,frequency:double>>,total_unique_words:bigint>",
    "repeated": "struct<total_repeated:bigint,phrases:array<struct<phrase:string,count:bigint>>>",
    "echoes": "struct<total_echoes:bigint,echoes:array<struct<word:string,paragraph:int,distance:int,occurrences:bigint>>>",
    "sensory": "struct<sensory_count:bigint,sensory_percentage:double,by_sense:map<string,struct<count:bigint,percentage:double>>>",
    "diction": "struct<total_vague:bigint,unique_vague:bigint,most_common:array<struct<word:string,count:bigint>>>",
    "cliches": "struct<total_cliches:bigint,cliches:array<struct<cliche:string,count:bigint>>>",
    "consistency": "struct<dialect:string,total_issues:bigint,issues:array<string>>",
    "acronyms": "struct<total_acronyms:bigint,unique_acronyms:bigint,acronym_list:array<struct<acronym:string,count:bigint>>>",
    "jargon": "struct<total_jargon:bigint,unique_jargon:bigint,jargon_list:array<struct<jargon:string,count:bigint>>>",
    "complex_paragraphs": "struct<complex_count:bigint,percentage:double,complex_paragraphs:array<struct<paragraph_num:int,avg_sentence_length:double,avg_syllables:double>>>",
    "conjunction_starts": "struct<count:bigint,percentage:double>",
    "style": "struct<adverb_count:bigint,hidden_verbs:array<struct<noun:string,verb:string,count:bigint>>,style_score:int>",
}
#: The names of the checks, in their order.
CHECKS = tuple(REPORTS)


def check_names(checks=None, exclude=None) -> tuple[str, ...]:
    """The checks to run; unknown names and both lists at once are errors of the caller."""
    if checks and exclude:
        raise ValueError("either checks or exclude can be given")
    for name in [*(checks or ()), *(exclude or ())]:
        if name not in CHECKS:
            raise ValueError(f"no such check: {name}")
    return tuple(c for c in CHECKS if (not checks or c in checks) and c not in (exclude or ()))


def prepared(docs: DataFrame, names, text: str = "__t", dictionary=None) -> DataFrame:
    """`docs` with what the reports of these checks share: sentences ``__s``, words ``__w``, and counts of
    paragraphs ``__p`` and of phrases ``__f`` where they are needed."""
    batches(docs.sparkSession)
    d = docs.withColumn("__s", sentences(text)).withColumn("__w", words(text))
    if {"diction", "cliches", "jargon", "style"} & set(names):
        d = d.withColumn("__f", W.phrase_column(text))
    if "complex_paragraphs" in names:
        d = d.withColumn("__p", paragraph_counts(dictionary, *S.COMPLEX)(F.col(text)))
    return d


def reports(names, max_grade=None, passive_max=None, dialect=None, dictionary=None, passive: Column | None = None) -> dict[str, Column]:
    """The report column of each of these checks, over the columns of `prepared`; `passive` is the number for the score."""
    s, w, t, f = F.col("__s"), F.col("__w"), F.col("__t"), F.col("__f")
    made = {
        "readability": lambda: S.readability(t, s, max_grade, dictionary),
        "grammar": lambda: S.grammar(s, passive_max),
        "sticky": lambda: S.sticky(t, s, w),
        "pacing": lambda: S.pacing(s),
        "sentence_length": lambda: S.sentence_length(s),
        "transitions": lambda: S.transitions(s),
        "overused": lambda: W.overused_report(t, w=w),
        "repeated": lambda: W.repeated_report(t, w=w),
        "echoes": lambda: W.echoes_report(t),
        "sensory": lambda: W.sensory(t, w),
        "diction": lambda: W.diction(t, w, f),
        "cliches": lambda: W.cliches(t, f),
        "consistency": lambda: W.consistency(t, dialect),
        "acronyms": lambda: W.acronyms(t),
        "jargon": lambda: W.jargon(t, w, f),
        "complex_paragraphs": lambda: S.complex_paragraphs(F.col("__p")),
        "conjunction_starts": lambda: S.conjunction_starts(s),
        "style": lambda: W.style(t, passive, w, f),
    }
    return {n: made[n]() for n in names}


def analyze(docs: DataFrame, checks=None, exclude=None, strip_md: bool = False, max_grade=None, passive_max=None, dialect=None, key: str = "doc_id", text: str = "text", dictionary=None, limit: int | None = MAX_BYTES) -> DataFrame:
    """(key, error, one struct per check) of each row, in one narrow pass: array expressions over the row, no exchange.

    A blank or too large text gives an error and null reports; with `limit` None no text is too large. Rows with equal
    keys stay documents of their own.
    """
    names = check_names(checks, exclude)
    d = prepared(docs.select(key, (prose(text) if strip_md else text_of(text)).alias("__t")), names, dictionary=dictionary)
    made = reports(names, max_grade, passive_max, dialect, dictionary, F.size(S.passives(F.col("__s"))) if "grammar" in names else None)
    error = F.coalesce(too_large("__t", limit), F.when(stripped(F.col("__t")) == "", "no scorable text in input"))
    return d.withColumn("error", error).select(key, "error", *(F.when(F.col("error").isNull(), made[n]).alias(n) for n in names))


def gate(analyzed: DataFrame, style_min: int | None = None) -> DataFrame:
    """`analyzed` with ``pass``: the style score reaches its minimum, and no requested limit is exceeded."""
    ok = F.col("error").isNull()
    if style_min is not None:
        ok = ok & (F.col("style")["style_score"] >= style_min)
    for name in ("readability", "grammar"):
        if name in analyzed.columns:
            ok = ok & ~F.coalesce(F.col(name)["over_max"], F.lit(False))
    return analyzed.withColumn("pass", ok)


def budget_gate(docs: DataFrame, vocabulary: list[str], budget: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, token_report(text, vocabulary, budget).alias("tokens"))
