"""Findings give the reports again, and ranges of lines are swept whatever their number."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from proselake.functions import lexicons as lex
from proselake.operators import documents as D
from proselake.operators.documents import unsuppressed
from proselake.plans.analyze import CHECKS, analyze
from proselake.plans.findings import findings, visible_findings

TEXTS = [
    "The report was written by the team.  It is what it is, and it was done. But nobody cared. " * 2 + "However, the very thing was really nice. NASA and ESA colour the color. " + " ".join(lex.CLICHES[:3]) + ". " + " ".join(lex.JARGON_PHRASES[:2]) + ".",
    "Considerable institutional accountability requires comprehensive organizational communication " * 5 + "immediately.\n\nThe lantern by the lantern was a lantern. We make a decision and an analysis of it quickly.",
    None, "", " \n ",
    "<!-- proselake disable grammar -->\nIt was painted by him.\n<!-- proselake enable grammar -->\nIt was painted by her.\n\nThe lamp and the lamp.",
]


def test_reports_from_findings(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    options = {"max_grade": 3.0, "dialect": "en-us"}
    got = Counter()
    for r in findings(d, **options).groupBy("doc_id", "check").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.max("ordinal").alias("last"), F.countDistinct("ordinal").alias("k")).collect():
        got[r["doc_id"], r["check"]] = (r["n"], r["amount"])
        assert r["last"] == r["n"] - 1 == r["k"] - 1
    for r in analyze(d, **options).collect():
        if r["error"]:
            assert not [k for k in got if k[0] == r["doc_id"]]
            continue
        sizes = {
            "readability": (int(r["readability"]["over_max"]),) * 2, "grammar": (len(r["grammar"]["issues"]) + r["grammar"]["passive_count"],) * 2, "sticky": (r["sticky"]["sticky_count"],) * 2,
            "sentence_length": (len(r["sentence_length"]["very_long"]),) * 2, "transitions": (r["transitions"]["unique_transitions"], r["transitions"]["total_transitions"]),
            "overused": (len(r["overused"]["overused_words"]), sum(x["count"] for x in r["overused"]["overused_words"])), "repeated": (r["repeated"]["total_repeated"], sum(x["count"] for x in r["repeated"]["phrases"])),
            "echoes": (r["echoes"]["total_echoes"], sum(x["occurrences"] for x in r["echoes"]["echoes"])), "sensory": (len(r["sensory"]["by_sense"]), r["sensory"]["sensory_count"]),
            "diction": (r["diction"]["unique_vague"], r["diction"]["total_vague"]), "cliches": (len(r["cliches"]["cliches"]), r["cliches"]["total_cliches"]), "consistency": (r["consistency"]["total_issues"],) * 2,
            "acronyms": (r["acronyms"]["unique_acronyms"], r["acronyms"]["total_acronyms"]), "jargon": (r["jargon"]["unique_jargon"], r["jargon"]["total_jargon"]), "complex_paragraphs": (r["complex_paragraphs"]["complex_count"],) * 2,
            "conjunction_starts": (r["conjunction_starts"]["count"],) * 2, "style": (len(r["style"]["hidden_verbs"]) + (r["style"]["adverb_count"] > 0), sum(x["count"] for x in r["style"]["hidden_verbs"]) + r["style"]["adverb_count"]),
        }
        assert set(sizes) == set(CHECKS) - {"pacing"}
        for check, want in sizes.items():
            assert got.get((r["doc_id"], check), (0, 0)) == want, (r["doc_id"], check)
    assert len({check for _, check in got}) == 18


def test_lines_and_directives(spark):
    d = spark.createDataFrame([(5, TEXTS[5]), (5, TEXTS[5])], "key int, text string")
    lines = lambda df: sorted(r["line"] for r in df.where("kind = 'PassiveVoice'").collect())
    # the directive's own line is part of the first sentence, which begins there in the text and after it in the lines
    assert lines(findings(d, ["grammar"], key="key")) == [2, 2, 4, 4]
    assert lines(visible_findings(d, "key", checks=["grammar"])) == [4, 4]


def test_ranges_against_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(D, "LINE_BLOCK", 8)
    rng = random.Random(2)
    key = lambda: rng.choice([1, 2, 3, None])
    rules = [(key(), rng.choice(["a", "b", None]), s, s + rng.randint(-2, 30), False) for s in (rng.randint(1, 60) for _ in range(40))] + [(2, "b", None, None, True)]
    found = [(key(), rng.choice(["a", "b", None]), rng.choice([None, 0, *range(1, 90)]), rng.randint(0, 3)) for _ in range(600)]
    hit = lambda f, r: f[0] == r[0] is not None and f[1] == r[1] is not None and (r[4] or (f[2] is not None and r[2] <= f[2] <= r[3]))
    want = [f for f in found if not any(hit(f, r) for r in rules)]
    got = unsuppressed(spark.createDataFrame(found, "doc_id int, check string, line int, found int"), spark.createDataFrame(rules, "doc_id int, check string, start int, end int, file_level boolean"))
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_many_ranges(spark):
    """A document with 100,000 ranges and as many findings takes seconds."""
    n = 100_000
    rules = spark.range(n).selectExpr("1 AS doc_id", "'a' AS check", "cast(id * 5 + 1 AS int) AS start", "cast(id * 5 + 3 AS int) AS end", "false AS file_level")
    found = spark.range(n).selectExpr("1 AS doc_id", "'a' AS check", "cast(id * 5 + id % 5 + 1 AS int) AS line")
    began = time.time()
    assert unsuppressed(found, rules).count() == n * 2 // 5
    assert time.time() - began < 60
