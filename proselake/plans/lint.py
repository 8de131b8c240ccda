"""The composite verdict: path rules choose checks and limits for each document, directives in it take findings away.

One narrow projection over the documents, without joins or exchanges. Documents that no rule configures give no row. Null
texts count as empty and give null reports. Rows with one path stay documents of their own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselake.functions.text import PARAGRAPH, let, text_of
from proselake.operators import sentences as S
from proselake.operators import words as W
from proselake.operators.documents import chosen_rules, completeness_report, headings, prose, suppressed, token_report
from proselake.plans.analyze import CHECKS, REPORTS, check_names, prepared, reports
from proselake.plans.findings import line_maps

#: Checks of a rule, and the settings that each may have.
SETTINGS = {"analyze": {"checks", "exclude", "style_min", "max_grade", "passive_max", "dialect"}, "readability": {"max_grade"}, "grammar": {"passive_max"}, "completeness": {"template"}, "tokens": {"budget"}}


def _encoded(rules: list[dict]) -> list[dict]:
    """The rules with settings as JSON; unknown checks and conflicting lists are errors before any plan is made."""
    out = []
    for rule in rules:
        checks = {}
        for name, given in rule["checks"].items():
            if name not in SETTINGS:
                raise ValueError(f"unknown check: {name}")
            if unknown := set(given) - SETTINGS[name]:
                raise ValueError(f"unknown settings of {name}: {', '.join(sorted(unknown))}")
            given = dict(given)
            if name == "analyze":
                listed = bool(given.get("checks") or given.get("exclude"))
                given["names"] = list(check_names(given.pop("checks", None), given.pop("exclude", None)))
                given["listed"] = listed
            checks[name] = json.dumps(given)
        out.append({"paths": rule["paths"], "checks": checks})
    return out


def _visible(findings: Column, check: str, lines: Column, ranges: Column, num: str = "sentence_num") -> Column:
    """Findings whose sentence's or paragraph's line is in no range of the check; one without a line is on line 0."""
    def hidden(x: Column) -> Column:
        line = F.coalesce(F.get(lines, x[num] - 1), F.lit(0))
        return F.exists(ranges, lambda r: (r["check"] == check) & (r["file_level"] | line.between(r["start"], r["end"])))

    return let(findings, lambda all_: F.when(F.size(ranges) == 0, all_).otherwise(F.filter(all_, lambda x: ~F.coalesce(hidden(x), F.lit(False)))))


def _regional_grammar(report: Column, limit: Column, lines: Column, ranges: Column) -> Column:
    def whole(r: Column) -> Column:
        return let(_visible(r["passive_voice"], "grammar", lines, ranges), lambda passive: again(r, passive, 100.0 * F.size(passive) / r["sentence_count"]))

    def again(r: Column, passive: Column, share: Column) -> Column:
        return F.when(r.isNotNull(), F.struct(
            _visible(r["issues"], "grammar", lines, ranges).alias("issues"), passive.alias("passive_voice"), F.size(passive).cast("long").alias("passive_count"),
            share.alias("passive_percentage"), r["sentence_count"].alias("sentence_count"), limit.alias("passive_max"), F.coalesce(share > limit, F.lit(False)).alias("over_max"),
        ))

    return let(report, whole)


def _limited(report: Column, limit: Column) -> Column:
    return let(report, lambda r: F.when(r.isNotNull(), r.withField("max_grade", limit).withField("over_max", F.coalesce(r["grade"] > limit, F.lit(False)))))


def _seen(report: Column, field: str, count: str, visible) -> Column:
    """`report` with what is visible of its list, and the list counted again."""
    def counted(r: Column) -> Column:
        return let(visible(r[field]), lambda items: r.withField(field, items).withField(count, F.size(items).cast("long")))

    return let(report, lambda r: F.when(r.isNotNull(), counted(r)))


def _analyses(lines: Column, paras: Column, ranges: Column, names: Column, listed: Column, setting, dialect: Column, dialects, needed) -> Column:
    """The reports of all checks that a rule asks for; the others are null and no part of the plan."""
    off = lambda n: listed & F.exists(ranges, lambda r: (r["check"] == n) & r["file_level"])
    wanted = lambda n: F.coalesce(F.array_contains(names, n) & ~off(n), F.lit(False))
    passives = F.when(wanted("grammar"), F.size(S.passives(F.col("__s")))).otherwise(0) if {"grammar", "style"} <= needed else None
    made = reports([n for n in CHECKS if n in needed], passive=passives)
    long = lambda r: r.withField("very_long", _visible(r["very_long"], "sentence_length", lines, ranges))
    # with directives the share is that of the paragraphs of the raw text, unrounded
    share = lambda r: r.withField("percentage", F.when(F.size(paras) > 0, r["complex_count"] / F.size(paras) * 100).otherwise(0.0))

    def paragraphs(made: Column) -> Column:
        own = _seen(made, "complex_paragraphs", "complex_count", lambda x: _visible(x, "complex_paragraphs", paras, ranges, "paragraph_num"))
        return let(own, lambda r: F.when(F.size(ranges) == 0, r).otherwise(share(r)))

    regional = {
        "readability": lambda r: _limited(r, setting("analyze", "max_grade", "max_grade")),
        "grammar": lambda r: _regional_grammar(r, setting("analyze", "passive_max", "passive_max_percent"), lines, ranges),
        "sticky": lambda r: _seen(r, "sticky_sentences", "sticky_count", lambda x: _visible(x, "sticky_sentences", lines, ranges)),
        "sentence_length": lambda made: let(made, lambda r: F.when(r.isNotNull(), long(r))),
        "echoes": lambda r: _seen(r, "echoes", "total_echoes", lambda x: _visible(x, "echoes", paras, ranges, "paragraph")),
        "consistency": lambda r: F.coalesce(*(F.when(dialect == d, W.consistency("__t", d)) for d in dialects), r),
        "complex_paragraphs": paragraphs,
    }
    whole = lambda n: regional[n](made[n]) if n in regional else made[n]
    return F.struct(*((F.when(wanted(n), whole(n)) if n in needed else F.lit(None).cast(REPORTS[n])).alias(n) for n in CHECKS))


def lint(docs: DataFrame, rules: list[dict], path: str = "path", text: str = "text", marker: str = "proselake", vocabulary: tuple[str, ...] = (), config: dict | None = None) -> DataFrame:
    """(path, analyze, readability, grammar, completeness, tokens, pass): a report per configured check, else null.

    `rules`: [{paths: [patterns], checks: {name: settings}}]. What a rule leaves open comes from `config`, as a `Loader`
    gives it, but for the budget of tokens. A check that a directive switches off for the whole file is null. Limits
    inside `analyze` are reported but only its least style score counts for ``pass``.
    """
    rules, config = _encoded(rules), config or {}
    d = docs.select(path, text_of(text).alias("__raw"), chosen_rules(F.col(path), rules).alias("__c")).where(F.size("__c") > 0)
    # functions outside of the JVM see a text only where its rule needs them; elsewhere they get a null
    d = d.withColumn("__set", F.map_from_entries(F.transform("__c", lambda x: F.struct(x["check"], x["settings"]))))
    d = d.withColumns({"__t": F.when(F.col(path).endswith(".md"), prose(F.when(F.col(path).endswith(".md"), F.col("__raw")))).otherwise(F.col("__raw")), "__r": suppressed("__raw", marker)})
    settings = [json.loads(r["checks"]["analyze"]) for r in rules if "analyze" in r["checks"]]
    needed = {n for g in settings for n in g["names"]}
    used = sorted({t for r in rules if (c := r["checks"].get("completeness")) and (t := json.loads(c).get("template"))})
    scored = F.exists("__c", lambda x: x["check"].isin("analyze", "readability", "grammar"))
    d = prepared(d.withColumn("__u", F.when(scored, F.col("__t"))), needed, "__u")
    if "__p" not in d.columns:
        d = d.withColumn("__p", F.lit(None).cast(f"array<{PARAGRAPH}>"))
    d = d.withColumn("__h", headings(F.when(F.col("__set")["completeness"].isNotNull(), F.col("__raw"))) if used else F.lit(None).cast("array<struct<level:int,text:string>>"))
    d = line_maps(d, "__raw", "__t", marker, bool({"echoes", "complex_paragraphs"} & needed))
    s, lines, paras, hidden = F.col("__s"), F.col("__l"), F.col("__k"), F.col("__r")
    raw = lambda check, name: F.get_json_object(F.col("__set")[check], f"$.{name}")
    setting = lambda check, name, general: F.coalesce(raw(check, name).cast("double"), F.lit(config.get(general)).cast("double"))
    on = lambda check: F.col("__set")[check].isNotNull() & ~F.exists(hidden, lambda r: (r["check"] == check) & r["file_level"])
    names = F.from_json(raw("analyze", "names"), "array<string>")
    some = F.size(s) > 0
    budget = raw("tokens", "budget").cast("long")
    tokens = token_report("__raw", list(vocabulary))
    dialect = F.coalesce(raw("analyze", "dialect"), F.lit(config.get("dialect")).cast("string"))
    dialects = sorted({x for x in (config.get("dialect"), *(g.get("dialect") for g in settings)) if x})
    custom = config.get("templates")
    complete = [F.when(on("completeness") & (raw("completeness", "template") == t), completeness_report("__raw", F.col("__h"), t, custom)) for t in used]
    missing = F.lit(None).cast("struct<template:string,sections:array<struct<name:string,status:string>>,pass:boolean>")
    # a check that no rule names is null and no part of the plan
    used_checks = {c for r in rules for c in r["checks"]}
    made = lambda check, report, kind: (report() if check in used_checks else F.lit(None).cast(kind)).alias(check)
    out = d.select(
        path,
        made("analyze", lambda: F.when(F.col("__set")["analyze"].isNotNull() & some, _analyses(lines, paras, hidden, names, raw("analyze", "listed") == "true", setting, dialect, dialects, needed)), f"struct<{','.join(f'{n}:{t}' for n, t in REPORTS.items())}>"),
        made("readability", lambda: F.when(on("readability"), _limited(S.readability(F.col("__t"), s, within=True), setting("readability", "max_grade", "max_grade"))), REPORTS["readability"]),
        made("grammar", lambda: F.when(on("grammar"), _regional_grammar(S.grammar(s), setting("grammar", "passive_max", "passive_max_percent"), lines, hidden)), REPORTS["grammar"]),
        F.coalesce(*complete, missing).alias("completeness"),
        made("tokens", lambda: F.when(on("tokens"), let(tokens, lambda r: r.withField("budget", budget).withField("over_budget", F.coalesce(r["count"] > budget, F.lit(False))))), "struct<count:bigint,budget:bigint,over_budget:boolean,tokenizer:string>"),
        setting("analyze", "style_min", "style_min_score").alias("__style_min"),
    )
    fails = [
        F.col("analyze.style.style_score") < F.col("__style_min"), F.col("readability.over_max"), F.col("grammar.over_max"),
        ~F.col("completeness.pass"), F.col("tokens.over_budget"),
    ]
    ok = F.lit(True)
    for x in fails:
        ok = ok & ~F.coalesce(x, F.lit(False))
    return out.select(path, "analyze", "readability", "grammar", "completeness", "tokens", ok.alias("pass"))
