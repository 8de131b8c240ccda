"""Sentence analyses over an array of numbered sentences, and grammar findings; struct columns, no exchange."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from proselake.functions import lexicons as lex
from proselake.functions.exact import fused
from proselake.functions.text import bare_tokens, let, percent, round1, syllables, text_counts, text_of, tokens, words
from proselake.operators.words import counted, glue_index


def _words(s: Column) -> Column:
    return F.size(s["words"])


def readability(text: Column, sents: Column | None, max_grade: float | None = None, dictionary: dict[str, int] | None = None, within: bool = False) -> Column:
    """School grade, with a fused product as the published formula is computed; null without words or sentences.

    Without `sents` they are only counted, by the function that counts the syllables. `within` keeps the syllables in the plan, for
    plans that want them of few rows only: a worker would count those of all.
    """

    def report(n: Column, m: Column, syl: Column) -> Column:
        return F.when((n > 0) & (m > 0), let(fused(0.39, n / m, F.lit(11.8) * (syl / n)) - F.lit(15.59), lambda grade: graded(grade, n, m, syl)))

    def graded(grade: Column, n: Column, m: Column, syl: Column) -> Column:
        over = F.lit(False) if max_grade is None else grade > max_grade
        return F.struct(grade.alias("grade"), m.alias("sentences"), n.alias("words"), syl.alias("syllables"), F.lit(max_grade).cast("double").alias("max_grade"), over.alias("over_max"))

    if within:
        syl = F.aggregate(F.transform(bare_tokens(text), lambda w: syllables(w, dictionary)), F.lit(0), lambda a, x: a + x).cast("long")
        return let(F.struct(F.size(tokens(text)).cast("long").alias("n"), F.size(sents).cast("long").alias("m"), syl.alias("s")), lambda x: report(x["n"], x["m"], x["s"]))
    counts = text_counts(dictionary, sents is None)(text_of(text))
    # what Python counts stays outside of the functions over arrays
    m = F.lit(None) if sents is None else F.size(sents)
    return let(F.struct(counts.alias("c"), m.cast("long").alias("m")), lambda x: report(x["c"]["tokens"], x["c"]["sentences"] if sents is None else x["m"], x["c"]["syllables"]))


def sticky(text, sents: Column, w: Column | None = None) -> Column:
    share = lambda s: F.size(F.filter(s["words"], lambda w: w.isin(*lex.GLUE))) / _words(s) * 100
    # a character has up to four bytes, so one of four beginnings is whole; decoding one that is not would be an error
    begun = lambda t, k: F.substring(F.encode(t, "UTF-8"), 1, k).cast("string")
    whole = lambda t: F.coalesce(*(F.when(F.is_valid_utf8(begun(t, k)), begun(t, k)) for k in (100, 99, 98, 97)))
    short = lambda t: F.when(F.octet_length(t) <= 100, t).otherwise(F.concat(whole(t), F.lit("...")))
    rows = F.transform(F.filter(sents, lambda s: _words(s) > 0), lambda s: F.struct(s["num"].alias("sentence_num"), share(s).alias("p"), s["text"].alias("text")))
    return let(rows, lambda rated: _sticky(glue_index(text, w), rated, short))


def _sticky(index: Column, rated: Column, short) -> Column:
    high = F.transform(F.filter(rated, lambda x: x["p"] > 45), lambda x: F.struct(x["sentence_num"], round1(x["p"]).alias("glue_percentage"), short(x["text"]).alias("text")))
    semi = F.size(F.filter(rated, lambda x: (x["p"] > 35) & (x["p"] <= 45)))
    return F.struct(index.alias("overall_glue_index"), F.size(high).cast("long").alias("sticky_count"), semi.cast("long").alias("semi_sticky_count"), high.alias("sticky_sentences"))


def pacing(sents: Column) -> Column:
    n = F.size(sents)
    share = lambda ks, test: percent(F.size(F.filter(ks, test)), n)
    return let(F.transform(sents, _words), lambda ks: F.struct(share(ks, lambda k: k < 10).alias("fast_percentage"), share(ks, lambda k: (k >= 10) & (k <= 20)).alias("medium_percentage"), share(ks, lambda k: k > 20).alias("slow_percentage")))


def sentence_length(sents: Column, in_turn: bool = False) -> Column:
    """Mean, population deviation, variety, extremes and sentences of over 30 words; null without sentences.

    The deviation is exact up to its root; with `in_turn` a mean and a sum of squares move with each sentence in its turn, as in
    SQL's `stddev_pop`, which may put a half on its other side.
    """
    n = F.size(sents)

    def report(k: Column, mean: Column, sd: Column) -> Column:
        long = F.filter(F.transform(k, lambda x, i: F.struct((i + 1).alias("sentence_num"), x.cast("long").alias("word_count"))), lambda x: x["word_count"] > 30)
        return F.struct(round1(mean).alias("avg_length"), round1(sd).alias("std_deviation"), round1(F.least(sd / 2, F.lit(10.0))).alias("variety_score"), F.array_min(k).cast("long").alias("shortest"), F.array_max(k).cast("long").alias("longest"), long.alias("very_long"))

    def deviation(sums: Column) -> Column:
        # in whole numbers up to the root: a sum of rounded squares may fall on the wrong side of a half
        wide = lambda c: c.cast("decimal(19,0)")
        return F.sqrt((wide(n) * wide(sums["q"]) - wide(sums["s"]) * wide(sums["s"])).cast("double")) / n

    def moved(a: Column, x: Column) -> Column:
        mean = a["mean"] + (x - a["mean"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("mean"), (a["q"] + (x - mean) * (x - a["mean"])).alias("q"))

    def moving(k: Column) -> Column:
        none = F.struct(*(F.lit(0.0).alias(c) for c in ("n", "mean", "q")))
        return F.aggregate(k, none, moved, lambda a: F.sqrt(a["q"] / a["n"]))

    total = lambda k: F.aggregate(k, F.lit(0).cast("long"), lambda a, x: a + x)
    sums = lambda k: F.struct(total(k).alias("s"), total(F.transform(k, lambda x: x.cast("long") * x)).alias("q"))
    means = lambda k: let(sums(k), lambda v: let(moving(k) if in_turn else deviation(v), lambda sd: report(k, v["s"] / n, sd)))
    return F.when(n > 0, let(F.transform(sents, _words), means))


def transitions(sents: Column) -> Column:
    def found(s: Column) -> Column:
        low = F.lower(s["text"])
        single = F.array_intersect(F.array(*map(F.lit, lex.TRANSITION_WORDS)), bare_tokens(low))
        return F.concat(single, let(low, lambda x: F.filter(F.array(*map(F.lit, lex.TRANSITION_PHRASES)), lambda p: F.contains(x, p))))

    return let(F.transform(sents, found), lambda each: _transitions(sents, each))


def _transitions(sents: Column, each: Column) -> Column:
    return let(F.struct(counted(F.flatten(each), "transition").alias("items"), F.size(F.filter(each, lambda x: F.size(x) > 0)).alias("n")), lambda x: _transition_report(sents, each, x["items"], x["n"]))


def _transition_report(sents: Column, each: Column, items: Column, n: Column) -> Column:
    return F.struct(n.cast("long").alias("sentences_with_transitions"), percent(n, F.size(sents)).alias("transition_percentage"), F.size(F.flatten(each)).cast("long").alias("total_transitions"), F.size(items).cast("long").alias("unique_transitions"), items.alias("most_common"))


def conjunction_sentences(sents: Column) -> Column:
    """The sentences that begin with a conjunction."""
    # a token of marks alone is an empty one, and no conjunction
    first = lambda s: F.lower(F.regexp_extract(s["text"], r"(?U)^[^\p{IsAlphabetic}\s]*(\S*?)[^\p{IsAlphabetic}\s]*(?!\S)", 1))
    return F.filter(sents, lambda s: first(s).isin(*lex.CONJUNCTIONS))


def conjunction_starts(sents: Column) -> Column:
    n = F.size(conjunction_sentences(sents))
    return F.struct(n.cast("long").alias("count"), percent(n, F.size(sents)).alias("percentage"))


#: A complex paragraph has more words a sentence and more syllables a word than these.
COMPLEX = (20, 1.8)


def complex_paragraphs(paras: Column) -> Column:
    """`paras`: array of {num, sentences, words, syllables}; a paragraph whose sentences are null is not complex."""
    def rated(p: Column) -> Column:
        return F.struct(p["num"].alias("paragraph_num"), (p["words"] / p["sentences"]).alias("avg_sentence_length"), (p["syllables"] / p["words"]).alias("avg_syllables"))

    real = F.filter(paras, lambda p: (p["sentences"] > 0) & (p["words"] > 0))
    hit = F.filter(F.transform(real, rated), lambda x: (x["avg_sentence_length"] > COMPLEX[0]) & (x["avg_syllables"] > COMPLEX[1]))
    items = F.transform(hit, lambda x: F.struct(x["paragraph_num"], round1(x["avg_sentence_length"]).alias("avg_sentence_length"), round1(x["avg_syllables"]).alias("avg_syllables")))
    return F.struct(F.size(items).cast("long").alias("complex_count"), percent(F.size(items), F.size(paras)).alias("percentage"), items.alias("complex_paragraphs"))


def participle(w: Column) -> Column:
    return ~w.isin(*lex.ADJECTIVES) & (w.isin(*lex.IRREGULAR_PARTICIPLES) | w.rlike(r"(?U)\b\w+ed\b"))


def passives(sents: Column, least: float = 0.6) -> Column:
    """Auxiliary and participle pairs with at least this confidence; the terms are added in a fixed order."""
    def pairs(s: Column, w: Column) -> Column:
        def pair(aux: Column, i: Column) -> Column:
            part, prior = F.get(w, i + 1), F.get(w, i - 1)
            by = F.coalesce(F.array_join(F.slice(w, i + 2, 5), " ").rlike(lex.BY_PHRASE), F.lit(False))
            c = F.lit(0.5) + F.when(aux.isin("was", "were", "been", "being", "is", "are"), 0.2).otherwise(0.0)
            c = c + F.when(part.isin(*lex.IRREGULAR_PARTICIPLES), 0.2).otherwise(0.0) + F.when(by, 0.3).otherwise(0.0)
            c = c + F.when(prior.isin("the", "a", "an", "this", "that", "these", "those", "it"), 0.1).otherwise(0.0)
            found = aux.isin(*lex.AUXILIARIES) & participle(part)
            return F.when(found, F.struct(F.concat_ws(" ", aux, part).alias("text"), F.least(c, F.lit(1.0)).alias("confidence"), s["num"].alias("sentence_num"), aux.alias("auxiliary"), part.alias("participle"), by.alias("has_by_phrase")))

        return F.filter(F.array_compact(F.transform(w, pair)), lambda x: x["confidence"] >= least)

    return F.flatten(F.transform(sents, lambda s: pairs(s, s["words"])))


def _clause(part: Column) -> Column:
    """`part` is in lower case."""
    def clause(t: Column) -> Column:
        has = lambda terms: F.exists(t, lambda x: x.isin(*terms))
        return (F.size(t) >= 3) & has(lex.SUBJECTS) & has(lex.COMMON_VERBS)

    return let(tokens(part), clause)


def _any_in(text: Column, *parts: str) -> Column:
    """Whether any of these strings is in the text: a cheap test before a pattern that needs one of them."""
    out = text.contains(parts[0])
    for p in parts[1:]:
        out = out | text.contains(p)
    return out


def grammar_issues(sents: Column) -> Column:
    """Issues by sentence, in a fixed order within each."""
    def issues(s: Column, low: Column) -> Column:
        t = s["text"]
        issue = lambda test, kind, severity, message=None: F.when(test, F.struct(F.lit(kind).alias("issue_type"), F.lit(message or lex.ISSUES[kind]).alias("message"), s["num"].alias("sentence_num"), F.lit(severity).alias("severity")))
        agree = lambda p: _any_in(low, *re.search(r"\(([a-z|]+)\)\\b$", p)[1].split("|")) & low.rlike("(?U)" + p)
        return F.array_compact(F.array(
            issue(t.contains("  "), "DoubleSpace", "Low"),
            # a sentence has no white space at its ends and is never empty
            issue(~t.rlike("[.!?]$"), "MissingPunctuation", "Medium"),
            *(issue(agree(p), "SubjectVerbAgreement", "High", m) for p, m in lex.SUBJECT_VERB),
            issue(low.contains("n't") & low.rlike("(?U)" + lex.DOUBLE_NEGATIVE), "DoubleNegative", "High"),
            issue(low.contains(",") & low.rlike("(?U)" + lex.RUN_ON), "RunOnSentence", "Medium"),
            issue(t.contains(",") & (F.size(F.filter(F.split(low, ","), _clause)) >= 2), "CommaSplice", "Medium"),
        ))

    return F.flatten(F.transform(sents, lambda s: let(F.lower(s["text"]), lambda low: issues(s, low))))


def grammar(sents: Column, passive_max: float | None = None) -> Column:
    """The combined report; null without sentences."""
    n = F.size(sents)
    return F.when(n > 0, let(passives(sents), lambda found: _grammar(sents, n, found, passive_max)))


def _grammar(sents: Column, n: Column, found: Column, passive_max: float | None) -> Column:
    share = 100.0 * F.size(found) / n
    over = F.lit(False) if passive_max is None else share > passive_max
    return F.struct(grammar_issues(sents).alias("issues"), found.alias("passive_voice"), F.size(found).cast("long").alias("passive_count"), share.alias("passive_percentage"), n.cast("long").alias("sentence_count"), F.lit(passive_max).cast("double").alias("passive_max"), over.alias("over_max"))
