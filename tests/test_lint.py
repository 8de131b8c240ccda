import json

import pytest
from pyspark.sql import functions as F

from proselake.operators import documents
from proselake.operators.documents import unsuppressed
from proselake.plans.analyze import CHECKS, analyze
from proselake.plans.lint import lint
from proselake.sources.files import as_json, read_texts, write_json
from proselake.streaming.analyze import analyze_stream

PASSIVE = "The report was written by the team. We read it with care."
RULES = [
    {"paths": ["docs/**/*.md"], "checks": {"grammar": {"passive_max": 10}, "tokens": {"budget": 1000}}},
    {"paths": ["docs/notes/*.md"], "checks": {"grammar": {"passive_max": 90}, "analyze": {"checks": ["grammar", "style"], "style_min": 5}}},
    {"paths": ["handoff/*"], "checks": {"completeness": {"template": "handoff"}, "readability": {"max_grade": 30}}},
]


def verdicts(spark, rows, rules=RULES):
    return {r["path"]: r for r in lint(spark.createDataFrame(rows, "path string, text string"), rules).collect()}


def test_rules_choose_checks_and_limits(spark):
    got = verdicts(spark, [("docs/a/x.md", PASSIVE), ("docs/notes/y.md", PASSIVE), ("other.txt", PASSIVE), ("docs/a/null.md", None)])
    assert set(got) == {"docs/a/x.md", "docs/notes/y.md", "docs/a/null.md"}
    x, y = got["docs/a/x.md"], got["docs/notes/y.md"]
    assert not x["pass"] and x["grammar"]["over_max"] and x["analyze"] is None and x["tokens"]["count"] == len(PASSIVE)
    # one passive costs 2, and a glue index far over 25 the most that it can, 15
    assert y["pass"] and y["grammar"]["passive_max"] == 90.0 and y["analyze"]["style"]["style_score"] == 83
    assert y["analyze"]["pacing"] is None and got["docs/a/null.md"]["grammar"] is None and got["docs/a/null.md"]["pass"]


def test_directives_take_findings_away(spark):
    mark = "<!-- proselake {} grammar -->\n"
    got = verdicts(spark, [
        ("docs/a/region.md", f"{mark.format('disable')}The report was written by the team.\n{mark.format('enable')}We read it with care."),
        ("docs/a/next.md", f"We read it with care.\n{mark.format('disable-next-line')}The report was written by the team."),
        ("docs/a/file.md", f"{mark.format('disable')}{PASSIVE}"),
    ])
    assert got["docs/a/region.md"]["grammar"]["passive_count"] == 0 and got["docs/a/region.md"]["pass"]
    assert got["docs/a/next.md"]["grammar"]["passive_count"] == 0 and got["docs/a/next.md"]["grammar"]["sentence_count"] == 2
    assert got["docs/a/file.md"]["grammar"] is None and got["docs/a/file.md"]["pass"]


def test_sections(spark):
    whole = "\n\n".join(f"## {n}\n\nSome text stands here." for n in ("Where things stand", "Decisions made", "What's next", "Landmines"))
    got = verdicts(spark, [("handoff/a", whole), ("handoff/b", whole.replace("## Landmines", "## Mines"))])
    assert got["handoff/a"]["pass"] and not got["handoff/b"]["pass"]
    assert [s["status"] for s in got["handoff/b"]["completeness"]["sections"]] == ["present"] * 3 + ["missing"]


@pytest.mark.parametrize("checks", [{"spelling": {}}, {"tokens": {"limit": 1}}, {"analyze": {"checks": ["style"], "exclude": ["pacing"]}}])
def test_errors_of_configuration(spark, checks):
    with pytest.raises(ValueError):
        verdicts(spark, [("a", "b")], [{"paths": ["*"], "checks": checks}])


def test_empty_table(spark):
    assert verdicts(spark, []) == {}


def test_complex_paragraphs_are_numbered(spark):
    hard = "Considerable institutional accountability requires comprehensive organizational communication " * 4 + "immediately."
    d = spark.createDataFrame([(1, f"Short one.\n\n{hard}")], "doc_id int, text string")
    r = analyze(d, checks=["complex_paragraphs"]).first()["complex_paragraphs"]
    assert r["complex_count"] == 1 and r["percentage"] == 50.0 and r["complex_paragraphs"][0]["paragraph_num"] == 2


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.md", "Tea é.".encode()), ("b.md", b"\xff\xfe"), ("c.md", b"x" * 50), ("d.txt", b"no")):
        (tmp_path / "in" / name).write_bytes(data)
    got = {r["path"][-4:]: r for r in read_texts(spark, str(tmp_path / "in"), 20, "*.md").collect()}
    assert set(got) == {"a.md", "b.md", "c.md"} and got["a.md"]["text"] == "Tea é." and got["a.md"]["error"] is None
    assert got["b.md"]["text"] is None and "UTF-8" in got["b.md"]["error"] and "over the limit" in got["c.md"]["error"]
    reports = spark.createDataFrame([(1, None, 2)], "doc_id int, a string, b int")
    assert json.loads(as_json(reports).first()["report"]) == {"b": 2}
    write_json(reports, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).select(F.col("b")).first()["b"] == 2


def test_all_analyses_with_regions(spark):
    off = "<!-- proselake disable-next-line {} -->\n"
    echo = "The lantern hung by the lantern door."
    rules = [{"paths": ["**"], "checks": {"analyze": {}}}]
    texts = {"plain.txt": f"{echo}\n\nNothing more.", "quiet.txt": f"{off.format('echoes')}{echo}\n\nNothing more.", "style.txt": f"{off[:-1].format('x')}\n<!-- proselake disable style -->\n{echo}"}
    got = {p: r["analyze"] for p, r in verdicts(spark, list(texts.items()), rules).items()}
    assert all(got["plain.txt"][n] is not None for n in CHECKS)
    # the marker's paragraph is the first one of the raw text, and its line is blank in the line map
    assert [e["word"] for e in got["plain.txt"]["echoes"]["echoes"]] == ["lantern"] and got["plain.txt"]["echoes"]["total_echoes"] == 1
    assert got["quiet.txt"]["echoes"]["total_echoes"] == 0
    # without a list of checks no directive takes a whole check away
    assert got["style.txt"]["style"] is not None
    listed = [{"paths": ["**"], "checks": {"analyze": {"checks": ["style", "pacing"]}}}]
    one = verdicts(spark, [("style.txt", texts["style.txt"])], listed)["style.txt"]["analyze"]
    assert one["style"] is None and one["pacing"] is not None


def test_complex_paragraphs_with_regions(spark):
    hard = "Considerable institutional accountability requires comprehensive organizational communication " * 4 + "immediately."
    text = f"Short one.\n\n{hard}\n\n<!-- proselake disable complex_paragraphs -->\n{hard}\n<!-- proselake enable complex_paragraphs -->"
    r = verdicts(spark, [("a.txt", text)], [{"paths": ["**"], "checks": {"analyze": {"checks": ["complex_paragraphs"]}}}])["a.txt"]["analyze"]["complex_paragraphs"]
    assert r["complex_count"] == 1 and [p["paragraph_num"] for p in r["complex_paragraphs"]] == [2] and r["percentage"] == pytest.approx(100 / 3)


def test_settings_of_the_configuration(spark):
    rules = [{"paths": ["docs/*"], "checks": {"grammar": {}, "analyze": {"checks": ["consistency", "style"]}, "tokens": {}, "completeness": {"template": "memo"}}}, {"paths": ["docs/us"], "checks": {"analyze": {"checks": ["consistency"], "dialect": "en-us"}}}]
    config = {"passive_max_percent": 10, "dialect": "en-gb", "style_min_score": 101, "templates": {"memo": ["Aim"]}, "token_budget": 1}
    text = "## Aim\n\nThe colour was changed. Nobody saw the color."
    d = spark.createDataFrame([("docs/a", text), ("docs/us", text)], "path string, text string")
    got = {r["path"]: r for r in lint(d, rules, config=config).collect()}
    assert got["docs/a"]["grammar"]["over_max"] and got["docs/a"]["completeness"]["pass"] and not got["docs/a"]["tokens"]["over_budget"]
    assert got["docs/a"]["analyze"]["consistency"]["dialect"] == "en-gb" and got["docs/us"]["analyze"]["consistency"]["dialect"] == "en-us"
    assert not got["docs/a"]["pass"] and got["docs/us"]["analyze"]["style"] is None


def test_equal_paths_stay_apart(spark):
    got = lint(spark.createDataFrame([("a", "One."), ("a", "<!-- proselake disable grammar -->Two.")], "path string, text string"), [{"paths": ["*"], "checks": {"grammar": {}}}]).collect()
    assert sorted(r["grammar"] is None for r in got) == [False, True]


def test_stream(spark, tmp_path):
    d = spark.createDataFrame([(1, "The barn was painted by the crew. The lantern by the lantern."), (2, None)], "doc_id long, text string")
    d.write.parquet(str(tmp_path / "in"))
    out = analyze_stream(spark, str(tmp_path / "in"))
    run = out.writeStream.format("memory").queryName("reports").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    key = lambda r: r["doc_id"]
    assert sorted(spark.table("reports").collect(), key=key) == sorted(analyze(d).collect(), key=key)


def test_findings_out_of_ranges(spark):
    rules = spark.createDataFrame([(1, "a", 2, 4, False), (1, "b", None, None, True), (2, "a", 1, 1, False)], "doc_id int, check string, start int, end int, file_level boolean")
    found = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "a", 4), (1, "a", 5), (1, "b", 9), (1, "c", 3), (2, "a", 1), (3, "a", 1)], "doc_id int, check string, line int")
    assert sorted(map(tuple, unsuppressed(found, rules).collect())) == [(1, "a", 1), (1, "a", 5), (1, "c", 3), (3, "a", 1)]


def test_templates_by_row(spark, monkeypatch):
    text = "## Alpha\n\nHere.\n\n## Beta\n\nTBD"
    d = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, None, "x"), (3, text, None), (4, text, "z")], "doc_id int, text string, template string")
    templates = spark.createDataFrame([("x", 2, "Beta"), ("x", 1, "Alpha"), ("y", 1, "Alpha"), (None, 1, "Beta"), ("y", 2, None)], "template string, ord int, name string")
    for bound in (10_000, 1):
        monkeypatch.setattr(documents, "TEMPLATE_ROWS", bound)
        got = sorted((r["doc_id"], r["template"] or "", [tuple(s) for s in r["sections"] or ()], r["pass"], r["error"]) for r in documents.completeness_by(d, templates).collect())
        assert got == [(1, "x", [("Alpha", "present"), ("Beta", "empty")], False, None), (1, "y", [("Alpha", "present")], True, None), (2, "x", [("Alpha", "missing"), ("Beta", "missing")], False, None),
                       (3, "", [], None, "no such template: null"), (4, "z", [], None, "no such template: z")]
