import json
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from proselake.functions import lexicons as lex
from proselake.functions.text import bare_tokens, paragraph_lines, sentences, split_sentences, syllables, tokens, words
from proselake.functions.globs import parsed
from proselake.operators import documents as D
from proselake.operators import sentences as S
from proselake.operators import words as W
from proselake.plans import queries as Q
from proselake.plans import sentence_sql as X
from proselake.plans.analyze import CHECKS, analyze, gate

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("text", "n"), [
    ("The ferry leaves at noon. Nobody waits.", 2), ("Prof. Lund sold the mill. Her sister kept the barn.", 2), ("A loaf costs 2.75 crowns. Cheese costs more.", 2),
    ("Where to? Up the hill! Then left.", 3), ("", 0), (" \n\t ", 0), ("We sat. They left.", 1), ("It weighs 4.20. Lift it.", 1), ("Well... then row.", 2), ("Pier C. Next stop.", 1),
    ("Why? he asked. Because.", 3), ('"Go." They went.', 2), ('They cried "Halt!"', 1), ('They cried "Halt!" Nobody did.', 1), ('It read "Halt!" "Turn back" and more.', 1), ('It read Halt! "Turn back" and more.', 2), ("There stood É. Behind it a wall.", 2),
    ("Ask at www.inn.example. Then go.", 1), ("Write to me@inn.example. Then go.", 1), ("Write to me@inn.e. Then go.", 2), ("Room 4. 5 beds.", 1), ("Room 4. Five beds.", 2), ("One\x1c. Two are here.", 2), ("a. b", 1), ("...", 0), ("É!", 1),
])
def test_sentences(text, n):
    assert len(split_sentences(text)) == n


@pytest.mark.parametrize("seed", [8, 31])
def test_sentences_against_sql(seed):
    rng = random.Random(seed)
    bits = ["Mill", "row", "Dr", "U.S", "A", "é", "É", "3", "4.5", "www.a.b", "https://x.y", "a@b.cd", "etc", "...", ".", "!", "?", '"', "'", " ", " ", " ", "\n", "\n\n", " ", ",", "(", ")", "-"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    got = con.sql(f"WITH RECURSIVE {X.sentences('t')} SELECT doc_id, num, text, line FROM s").fetchall()
    assert sorted(got) == sorted((i, k + 1, s, line) for i, t in enumerate(texts) for k, (s, line) in enumerate(split_sentences(t)))


@pytest.mark.parametrize(("lengths", "deviation", "variety"), [
    ((14, 3, 17, 20, 4, 15, 20, 16, 9, 13), 5.7, 2.9), ((14, 11, 7, 27, 20, 2, 24, 28, 1, 15), 9.3, 4.7), ((1, 1, 8, 8), 3.5, 1.8), ((4,), 0.0, 0.0),
])
def test_deviation_at_halves(spark, lengths, deviation, variety):
    text = " ".join(" ".join(["Row", *["row"] * (n - 1)]) + "." for n in lengths)
    r = one(spark, text, S.sentence_length)
    assert (r["std_deviation"], r["variety_score"], r["shortest"], r["longest"]) == (deviation, variety, min(lengths), max(lengths))


def test_deviation_of_reports_in_turn(spark, tmp_path):
    """The registered query moves its deviation with each sentence, as `stddev_pop` does over the sentences in their order."""
    # lengths without the sentences that the query adds by the document's id; all of these have halves
    own = {8: (1, 2, 5, 12), 6: (13, 20, 11, 2, 2, 13, 4), 2: (2, 8, 14, 12, 4, 10, 10, 17, 32, 16, 6, 6, 4, 3), 3: (4,)}
    added = {8: (5, 9, 5, 9), 6: (3, 8, 5), 2: (6, 6), 3: (4, 4)}
    rows = [(i, " ".join(" ".join(["Row", *["row"] * (n - 1)]) + "." for n in k), "en", "s") for i, k in own.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in Q.sentence_reports(spark, str(tmp_path)).collect()}
    for i, k in own.items():
        want = duckdb.sql(f"SELECT round(sd * 10) / 10, round(least(sd / 2, 10.0::DOUBLE) * 10) / 10 FROM (SELECT stddev_pop(n ORDER BY i) AS sd FROM (SELECT unnest(k) AS n, generate_subscripts(k, 1) AS i FROM (SELECT {[*k, *added[i]]} AS k)))").fetchall()[0]
        assert (got[i]["n_sentences"], got[i]["std_deviation"], got[i]["variety_score"]) == (len(k) + len(added[i]), *want)


def test_sentence_lines():
    assert [line for _, line in split_sentences("Rain fell.\n\nIt stopped on line three.\n\nLine five was dry.")] == [1, 3, 5]


def one(spark, text, make):
    d = spark.createDataFrame([(1, text)], "doc_id int, text string").withColumn("s", sentences("text"))
    return d.select(make(F.col("s")).alias("r")).first()["r"]


def test_words(spark):
    text = "..Well, (it's) - a  \"far-off\" ΑΣ, ΟΔΟΣ. 3rd! ' --x--  İ, …"
    assert one(spark, text, lambda s: words("text")) == ["well", "it's", "-", "a", "far-off", "ας", "οδος", "3rd", "'", "--x--", "i̇"]
    assert one(spark, "'Tis 4th-rate: x9, 77 é.", lambda s: bare_tokens("text")) == ["tis", "th-rate", "x", "é"]
    assert one(spark, None, lambda s: F.size(tokens("text"))) == 0
    assert one(spark, "a\n \nb\nc\n\n\nd", lambda s: paragraph_lines("text")) == [1, 3, 7]


def test_syllables(spark):
    big = {f"w{i}": i % 7 + 1 for i in range(3000)}
    got = one(spark, "w5 w2999 table jumped cave", lambda s: F.transform(words("text"), lambda w: syllables(w, big)))
    assert got == [big["w5"], big["w2999"], 3, 1, 1] and one(spark, "idea", lambda s: F.transform(words("text"), lambda w: syllables(w))) == [2]


def test_passive(spark):
    r = one(spark, "The barn was painted by the neighbours.", S.passives)
    assert [(x["auxiliary"], x["participle"], x["has_by_phrase"]) for x in r] == [("was", "painted", True)]
    assert one(spark, "They were tired of the rain.", S.passives) == []
    g = one(spark, "The mail was sent. Nobody answered. The door was shut.", S.grammar)
    assert 60 < g["passive_percentage"] < 70


@pytest.mark.parametrize("pad", range(4))
@pytest.mark.parametrize("tail", ["é", "€", "𝄞", "\ufffd"])
def test_long_sticky_sentences_end_with_a_whole_character(spark, pad, tail):
    text = "x" * pad + "the of and to in is it that " * 3 + "the of " + tail * 9 + "."
    (r,) = one(spark, text, lambda s: S.sticky("text", s))["sticky_sentences"]
    assert r["text"] == text.encode()[:100].decode(errors="ignore") + "..."


@pytest.mark.parametrize(("text", "kind"), [
    ("It were a long road.", "SubjectVerbAgreement"), ("They can't find nothing here.", "DoubleNegative"), ("Two  gaps stand here.", "DoubleSpace"), ("No end to this one", "MissingPunctuation"),
    ("She has a boat, they need a crew.", "CommaSplice"), ("It rained, and they went , but nobody minded.", "RunOnSentence"),
])
def test_grammar(spark, text, kind):
    assert kind in [i["issue_type"] for i in one(spark, text, S.grammar_issues)]


def test_reports(spark):
    assert one(spark, "bright loud mill stands", lambda s: W.sensory("text"))["sensory_percentage"] == 50.0
    cliche = lex.CLICHES[0]
    assert one(spark, f"They {cliche} now. Then they {cliche} once more.", lambda s: W.cliches("text"))["total_cliches"] == 2
    us, uk, _ = lex.SPELLINGS[0]
    assert one(spark, f"One sign says {us}, the other {uk}.", lambda s: W.consistency("text"))["total_issues"] == 1
    assert one(spark, f"Only {uk} here.", lambda s: W.consistency("text", "en-us"))["total_issues"] == 1
    a, b = lex.HYPHENS[0]
    assert one(spark, f"Send {a} or {b}.", lambda s: W.consistency("text"))["total_issues"] == 1


def test_counts_within_the_row(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["mill", "barn", "the", "ferry", "ox", "Lantern", "é"]) + rng.choice(["", "", ".", "\n\n"]) for _ in range(rng.randint(0, 120))) for _ in range(40)] + [None, ""]
    # rows with one id stay documents of their own
    d = spark.createDataFrame([(i % 7, i, t) for i, t in enumerate(texts)], "doc_id int, row int, text string")
    made = d.select("row", "text", words("text").alias("w"), W.overused_report().alias("o"), W.repeated_report().alias("r"), W.echoes_report().alias("e"))
    for x in made.collect():
        w, n = x["w"], Counter(x["w"])
        often = sorted(((-c, t) for t, c in n.items() if len(t.encode()) > 3 and t not in lex.GLUE and 100 * c / len(w) > 0.5))
        assert [(-u["count"], u["word"]) for u in x["o"]["overused_words"]] == often and x["o"]["total_unique_words"] == len(n)
        grams = Counter(" ".join(w[i : i + k]) for k in (2, 3, 4) for i in range(len(w) - k + 1))
        top = sorted((-c, g) for g, c in grams.items() if c > 1)[:50]
        assert [(-u["count"], u["phrase"]) for u in x["r"]["phrases"]] == top and x["r"]["total_repeated"] == len(top)
        found = []
        for k, p in enumerate([p for p in (x["text"] or "").split("\n\n") if p.strip()]):
            own = [t.strip(".").lower() for t in p.split()]
            last = {}
            for i, t in enumerate(own):
                if len(t.encode()) >= 4 and t not in lex.GLUE:
                    if t in last and i - last[t] < 20:
                        found.append((i - last[t], k + 1, t, i, own.count(t)))
                    last[t] = i
        assert [(u["distance"], u["paragraph"], u["word"], u["occurrences"]) for u in x["e"]["echoes"]] == [(a, b, c, e) for a, b, c, _, e in sorted(found)[:50]]


def test_plans_are_narrow(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = analyze(d, limit=None)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") <= 2
    for verb in (W.overused, W.repeated, W.echoes):
        assert "Exchange" not in verb(d)._jdf.queryExecution().executedPlan().toString()


def test_analyze_without_a_limit(spark, tmp_path):
    text = "x" * 5_242_881 + ". We made a decision."
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert analyze(d, checks=["transitions"]).first()["error"] is not None
    assert analyze(d, checks=["transitions"], limit=None).first()["transitions"] is not None
    d.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    assert Q.style(spark, str(tmp_path)).first()["style_score"] is not None


def test_analyze_handles_null_and_blank(spark):
    d = spark.createDataFrame([(1, None), (2, " \n"), (3, "Run fast. Stop now.")], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in gate(analyze(d, checks=["readability", "pacing", "overused"])).collect()}
    assert rows[1]["error"] and rows[1]["pacing"] is None and not rows[1]["pass"]
    assert rows[2]["error"] and rows[3]["pacing"]["fast_percentage"] == 100.0 and rows[3]["pass"]
    whole = analyze(d).where("doc_id = 3").first()
    assert whole["overused"]["total_unique_words"] == 4 and whole["echoes"]["echoes"] == [] and all(c in whole.asDict() for c in CHECKS)
    with pytest.raises(ValueError):
        analyze(d, checks=["readablity"])
    with pytest.raises(ValueError):
        analyze(d, checks=["pacing"], exclude=["style"])


def test_markdown():
    assert "loop" not in D.prose_of("Before.\n\n```python\nloop\n```\n\nAfter.")
    assert "draft" not in D.prose_of("---\nstate: draft\n---\n\nBody.")
    assert D.prose_of("See [the map](https://map.example) in *blue* or `grey`.").strip() == "See the map in blue or ."
    assert [(h["level"], h["text"]) for h in D.headings_of("# Top\n\n## Mid\n\n### Low\n\nBody.")] == [(1, "Top"), (2, "Mid"), (3, "Low")]


@pytest.mark.parametrize(("text", "want"), [
    ("One\ntwo.\n\nThree.", "One two. Three. "), ("- a\n- b\n  c\n\nEnd.", "ab cEnd. "), ("- a\n\n- b\n\nEnd.", "a b End. "), ("1. x\n2. y", "xy"), ("a\n\n    code\n\nb", "a b "), ("\tcode\n", ""),
    ("| p | q |\n|---|---|\n| r \\| s | *t* |\n\nu", "pqr | stu "), ("p | q\n--|--\nr | s", "pqrs"), ("a\n\n---\n\nb", "a b "), ("Two\nlines\n===\n\nc", "c "),
    ("See [a][x], [x] and [y].\n\n[x]: http://x.example 'T'", "See a, x and [y]. "), ("Fact[^1] and [^2].\n\n[^1]: Note here.", "Fact and [^2]. Note here. "),
    ("<div>\nhidden\n</div>\n\nseen <b>bold</b>", "seen bold "), ("<!-- x -->\nc\n<!-- y -->\nd", "c d "), ("<!-- no\n\nmore -->\n\nyes", "yes "), ("<https://x.example> &amp; &eacute; \\*not\\*", "https://x.example & é *not* "), ("> q1\n> q2\n\n***", "q1 q2 "),
    ("~~~\n# x\n~~~ \n~~gone~~ __so__ a_b_c", "gone so a_b_c "), ("![alt](i.png) **b *c* d**", "alt b c d "), ("", ""),
])
def test_prose(text, want):
    assert D.prose_of(text) == want


def test_headings():
    text = "    # code\n\nTwo\nlines\n---\n\n## `a*b` and *c* ##\n\n```\n# no\n```\n####### seven\n\n| a |\n|---|\n| # b |\n\n#\n\n- x\n---"
    assert [(h["level"], h["text"]) for h in D.headings_of(text)] == [(2, "Twolines"), (2, "a*b and c"), (1, "")]


def test_rules():
    assert [D.specificity(p) for p in ("**/*.txt", "notes/**/*.txt", "notes/old/*.txt", "TODO.txt")] == [0, 1, 2, 1]
    assert parsed("[open") is None


def longest_matches(text, vocabulary):
    data, known = text.encode(), {v.encode() for v in vocabulary}
    at = n = 0
    while at < len(data):
        at += next((k for k in range(len(data) - at, 0, -1) if data[at : at + k] in known), 1)
        n += 1
    return n


def test_tokens(spark):
    rng = random.Random(6)
    vocabulary = sorted({"".join(rng.choice("abé ") for _ in range(rng.randint(1, 5))) for _ in range(25)})
    texts = ["".join(rng.choice("abéc ") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    d = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    got = [r[0] for r in d.select(D.token_report("text", vocabulary, 2)["count"]).collect()]
    assert got == [longest_matches(t, vocabulary) for t in [*texts, ""]]
    assert one(spark, "é", lambda s: D.token_report("text", []))["count"] == 2
    table = "ab\n\n| ab |ab|\n|-|:-:|\n|a|b|\nrest|\n\nab|ab"
    assert one(spark, table, lambda s: D.token_report("text", ["ab", "b|", "|\n", "\n\n"]))["count"] == (1 + 1) + (3 + 4) + (3 + 4) + (3 + 2) + (1 + 4) + (1 + 1 + 1 + 1)
    assert D.table_ranges_of(table) == [{"start": 4, "end": 33}] and D.table_ranges_of("```\na|b\n-|-\n```\n\na|b\n-|-|-") == []


def test_suppressions(spark):
    mark = lambda s: f"<!-- proselake {s} -->"
    text = f"{mark('disable a')} {mark('disable b, c d')}\nx\n{mark('enable a')}{mark('disable a')}\n{mark('enable a')} {mark('enable zz')}\n{mark('disable-next-line b')}\n{mark('disable e')}{mark('enable e')}"
    d = spark.createDataFrame([(1, text), (1, "plain"), (2, None), (3, mark("enable q"))], "doc_id int, text string")
    got = sorted((r["doc_id"], r["check"], r["start"], r["end"], r["file_level"]) for r in D.suppressions(d).collect())
    assert got == sorted([(1, "a", 1, 3, False), (1, "a", 3, 4, False), (1, "b", None, None, True), (1, "c d", None, None, True), (1, "e", 6, 6, False)], key=str)


def test_custom_templates(spark):
    assert D.template_names({"mine": ("A",), "adr": ("B",)}) == [*lex.TEMPLATES, "mine"]
    d = spark.createDataFrame([(1, "## A\n\nx")], "doc_id int, text string")
    assert D.completeness(d, "adr", custom={"adr": ("A",)}).first()["pass"]
    with pytest.raises(ValueError):
        D.sections(d, "none")


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = Q.QUERIES[name](spark, SF)
    want = con.sql(Q.SQL[name])
    at = [want.columns.index(c) for c in got.columns]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(Q.SQL)


def test_json_reports_are_json(spark):
    assert json.loads(Q.json_reports(spark, SF).first()["report"])["n_words"] >= 0
