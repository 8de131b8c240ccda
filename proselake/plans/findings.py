"""What the analyses find as one long table: a row for each finding of each check, for counts, joins and suppression.

Findings with a place have its line in the text, lines that hold a directive counted as empty; findings of a whole document have
line 0. Their amounts sum to the totals of the reports, so reports can be made of findings again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselake.functions.text import MAX_BYTES, let, paragraph_lines, split_text, stripped, text_of, too_large
from proselake.operators import sentences as S
from proselake.operators.documents import directives_blanked, prose, suppressions, unsuppressed
from proselake.plans.analyze import check_names, prepared, reports

FINDING = "array<struct<check:string,ordinal:int,line:int,kind:string,severity:string,message:string,amount:bigint>>"
#: Checks that directives know by the name of their report where they name a range of lines.
_REGIONS = {"sticky_sentences": "sticky"}


def line_maps(d: DataFrame, raw: str, scored: str, marker: str, paras: bool = True) -> DataFrame:
    """`d` with the line of each sentence ``__l`` and of each paragraph ``__k`` of a raw text, lines with directives empty.

    Where the sentences ``__s`` are those of the very text their own lines serve, and the text is not split again.
    """
    blanked = directives_blanked(F.col(raw), marker)
    d = d.withColumn("__b", F.when(F.col(raw).contains("<!--") | (F.col(raw) != F.col(scored)), blanked))
    d = d.withColumn("__again", split_text("__b"))
    lines = F.transform(F.when(F.col("__b").isNull(), F.transform("__s", lambda s: F.struct(s["line"].alias("line")))).otherwise(F.transform("__again", lambda s: F.struct(s["line"].alias("line")))), lambda s: s["line"])
    return d.withColumns({"__l": lines, "__k": paragraph_lines(F.coalesce("__b", F.col(raw))) if paras else F.lit(None).cast("array<int>")}).drop("__b", "__again")


def _items(check: str, found: Column, message, line=None, kind=None, severity=None, amount=None) -> Column:
    """`found` as findings of a check; each part is a function of an entry."""
    part = lambda f, x, default, to: F.lit(default).cast(to) if f is None else f(x).cast(to)
    one = lambda x, i: F.struct(
        F.lit(check).alias("check"), i.alias("ordinal"), F.coalesce(part(line, x, 0, "int"), F.lit(0)).alias("line"), part(kind, x, None, "string").alias("kind"),
        part(severity, x, None, "string").alias("severity"), message(x).alias("message"), part(amount, x, 1, "long").alias("amount"))
    return F.coalesce(F.transform(found, one), F.array().cast(FINDING))


def _of_reports(made: dict[str, Column]) -> list[Column]:
    at = lambda name: lambda x: F.get("__l", x[name] - 1)
    para = lambda name: lambda x: F.get("__k", x[name] - 1)
    sents = F.col("__s")
    tell = lambda form, *parts: lambda x: F.format_string(form, *(x[p] for p in parts))

    def grammar(r: Column) -> Column:
        issues = F.transform(r["issues"], lambda x: F.struct(x["issue_type"].alias("kind"), x["severity"].alias("severity"), x["message"].alias("message"), x["sentence_num"].alias("sentence_num")))
        passive = F.transform(r["passive_voice"], lambda x: F.struct(F.lit("PassiveVoice").alias("kind"), F.lit(None).cast("string").alias("severity"), x["text"].alias("message"), x["sentence_num"].alias("sentence_num")))
        return _items("grammar", F.concat(issues, passive), lambda x: x["message"], at("sentence_num"), lambda x: x["kind"], lambda x: x["severity"])

    def style(r: Column) -> Column:
        adverbs = F.when(r["adverb_count"] > 0, F.array(F.struct(F.lit("Adverbs").alias("kind"), F.lit(None).cast("string").alias("message"), r["adverb_count"].alias("count"))))
        hidden = F.transform(r["hidden_verbs"], lambda x: F.struct(F.lit("HiddenVerb").alias("kind"), F.format_string("%s: %s", x["noun"], x["verb"]).alias("message"), x["count"].alias("count")))
        none = F.array().cast("array<struct<kind:string,message:string,count:bigint>>")
        return _items("style", F.concat(F.coalesce(adverbs, none), hidden), lambda x: x["message"], None, lambda x: x["kind"], None, lambda x: x["count"])

    counted = lambda check, field, name: lambda r: _items(check, r[field], lambda x: x[name], amount=lambda x: x["count"])
    long_sentences = F.filter(sents, lambda s: F.size(s["words"]) > 20)
    words_of = lambda x: F.format_string("%d words", F.size(x["words"]))
    senses = lambda r: F.sort_array(F.transform(F.map_entries(r["by_sense"]), lambda e: F.struct(e["key"].alias("sense"), e["value"]["count"].alias("count"))))
    by = {
        "readability": lambda r: _items("readability", F.when(r["over_max"], F.array(r)), tell("grade %.1f is over the limit", "grade")),
        "grammar": grammar,
        "sticky": lambda r: _items("sticky", r["sticky_sentences"], lambda x: x["text"], at("sentence_num")),
        "pacing": lambda r: _items("pacing", F.when(r.isNotNull(), long_sentences), words_of, at("num")),
        "sentence_length": lambda r: _items("sentence_length", r["very_long"], tell("%d words", "word_count"), at("sentence_num")),
        "transitions": counted("transitions", "most_common", "transition"),
        "overused": counted("overused", "overused_words", "word"),
        "repeated": counted("repeated", "phrases", "phrase"),
        "echoes": lambda r: _items("echoes", r["echoes"], lambda x: x["word"], para("paragraph"), amount=lambda x: x["occurrences"]),
        "sensory": lambda r: _items("sensory", senses(r), lambda x: x["sense"], amount=lambda x: x["count"]),
        "diction": counted("diction", "most_common", "word"),
        "cliches": counted("cliches", "cliches", "cliche"),
        "consistency": lambda r: _items("consistency", r["issues"], lambda x: x),
        "acronyms": counted("acronyms", "acronym_list", "acronym"),
        "jargon": counted("jargon", "jargon_list", "jargon"),
        "complex_paragraphs": lambda r: _items("complex_paragraphs", r["complex_paragraphs"], tell("%.1f words a sentence, %.1f syllables a word", "avg_sentence_length", "avg_syllables"), para("paragraph_num")),
        "conjunction_starts": lambda r: _items("conjunction_starts", F.when(r.isNotNull(), S.conjunction_sentences(sents)), lambda x: F.lower(F.get(x["words"], F.lit(0))), at("num")),
        "style": style,
    }
    return [let(report, by[name]) for name, report in made.items()]


def findings(
    docs: DataFrame, checks=None, exclude=None, strip_md: bool = False, max_grade=None, passive_max=None, dialect=None, key: str = "doc_id", text: str = "text", dictionary=None, limit: int | None = MAX_BYTES, marker: str = "proselake"
) -> DataFrame:
    """(key, check, ordinal, line, kind, severity, message, amount): the findings of each row, one to a row; no exchange.

    What counts is what `analyze` reports with the same arguments, for each check in the report's order. Blank and too large texts
    have no findings. A sentence or paragraph beyond the lines of the raw text is on line 0. Rows with equal keys stay
    documents of their own.
    """
    names = check_names(checks, exclude)
    d = docs.select(F.col(key).alias("__key"), text_of(text).alias("__raw"))
    d = d.withColumn("__t", prose("__raw") if strip_md else F.col("__raw"))
    d = d.where((stripped(F.col("__t")) != "") & too_large("__t", limit).isNull())
    d = line_maps(prepared(d, names, dictionary=dictionary), "__raw", "__t", marker, bool({"echoes", "complex_paragraphs"} & set(names)))
    made = reports(names, max_grade, passive_max, dialect, dictionary, F.size(S.passives(F.col("__s"))) if "grammar" in names else None)
    # each report is a column of its own, and so are its findings
    d = d.select("__key", F.concat(*_of_reports(made)).alias("__all"))
    # an inner explode would ask for non-empty arrays first, and so have all findings computed twice
    return d.select("__key", F.explode_outer("__all").alias("__one")).where("__one IS NOT NULL").select(F.col("__key").alias(key), "__one.*")


def visible_findings(docs: DataFrame, key: str = "doc_id", text: str = "text", marker: str = "proselake", **options) -> DataFrame:
    """`findings` without those that a directive of their document hides: by their line, or for the whole file.

    Directives know sentences full of glue words by the check's name for a file and by the report's name for lines.
    """
    rules = suppressions(docs, key, text, marker)
    named = F.create_map(*(F.lit(x) for kv in _REGIONS.items() for x in kv))
    own = F.array(*(F.lit(v) for v in _REGIONS.values()))
    rules = rules.where(F.col("file_level") | ~F.array_contains(own, F.col("check"))).withColumn("check", F.coalesce(F.element_at(named, F.col("check")), F.col("check")))
    return unsuppressed(findings(docs, key=key, text=text, marker=marker, **options), rules, key)
