"""Registered queries of the prose analyses over `documents`, with SQL of equal meaning.

The lexicon terms hardly occur in the corpus, so some queries append one by the document's id, alike in both forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.functions import lexicons as lex
from proselake.functions.sql import register
from proselake.functions.text import bare_tokens, batches, paragraph_lines, sentences, split_text, tokens, too_large, unrolled, words
from proselake.operators import documents as D
from proselake.operators import sentences as S
from proselake.operators import words as W
from proselake.operators.dictionary import readability_by
from proselake.plans import sentence_sql as X
from proselake.plans import woven
from proselake.plans.analyze import analyze
from proselake.plans.findings import findings as all_findings
from proselake.plans.findings import visible_findings
from proselake.plans.lint import lint as lint_plan
from proselake.plans.rollups import MEASURES, merged, partials, summary
from proselake.sources.files import as_json


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")


def _with_terms(d: DataFrame, terms) -> DataFrame:
    add = F.element_at(F.array(*map(F.lit, terms)), (F.col("doc_id") % len(terms) + 1).cast("int"))
    return d.withColumn("text", F.concat_ws(" ", "text", add, add))


def _q(terms) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in terms)


def _terms_sql(terms) -> str:
    return f"(SELECT doc_id, text || ' ' || ([{_q(terms)}])[CAST(doc_id % {len(terms)} + 1 AS INT)] || ' ' || ([{_q(terms)}])[CAST(doc_id % {len(terms)} + 1 AS INT)] AS text FROM documents)"


_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_WORDS = r"list_filter(list_transform(string_split_regex(text, '" + _SPACE + r"'), lambda w: lower(regexp_replace(w, '^[^\p{L}\p{N}''-]+|[^\p{L}\p{N}''-]+$', '', 'g'))), lambda w: w <> '')"


def overused_words(spark, sf_dir):
    return W.overused(_docs(spark, sf_dir))


def repeated_phrases(spark, sf_dir):
    return W.repeated(_docs(spark, sf_dir))


def echoes(spark, sf_dir):
    return W.echoes(_docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))


def word_totals(spark, sf_dir):
    made = _docs(spark, sf_dir).select("doc_id", W.overused_report().alias("o"), W.repeated_report().alias("r"), W.echoes_report().alias("e"))
    return made.select("doc_id", "o.total_unique_words", F.size("o.overused_words").cast("long").alias("n_overused"), "r.total_repeated", "e.total_echoes")


def word_counts(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("w", words("text"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(tokens("text")).cast("long").alias("n_tokens"), F.size(paragraph_lines("text")).cast("long").alias("n_paragraphs"), W.glue_index("text", F.col("w")).alias("glue_index"))


def sql_kernels(spark, sf_dir):
    """The kernels as SQL functions, called from SQL."""
    register(spark)
    return spark.sql("""SELECT doc_id, CAST(size(words(text)) AS BIGINT) AS n_words, CAST(size(paragraphs(replace(text, '\\n', '\\n\\n'))) AS BIGINT) AS n_paragraphs, CAST(size(sentences(text)) AS BIGINT) AS n_sentences,
        token_count(text) AS n_tokens, md5(try_element_at(words(text), -1)) AS last_md5 FROM {docs}""", docs=_docs(spark, sf_dir))


def sql_word_table(spark, sf_dir):
    """A table function joined to each document."""
    register(spark)
    return spark.sql("SELECT doc_id, count(*) AS n, sum(syllables(word)) AS syllables, CAST(max(pos) AS BIGINT) AS last FROM {docs}, LATERAL each_word(text) GROUP BY doc_id", docs=_docs(spark, sf_dir))


def _terms(name, terms, column, fields):
    def run(spark, sf_dir):
        d = _with_terms(_docs(spark, sf_dir), terms).select("doc_id", column("text").alias("r"))
        return d.select("doc_id", *(F.col("r")[f].alias(f) for f in fields))

    run.__name__ = name
    return run


diction = _terms("diction", (*lex.VAGUE_WORDS, *lex.VAGUE_PHRASES), W.diction, ("total_vague", "unique_vague"))
jargon = _terms("jargon", (*lex.JARGON_WORDS, *lex.JARGON_PHRASES), W.jargon, ("total_jargon", "unique_jargon"))
cliches = _terms("cliches", lex.CLICHES, W.cliches, ("total_cliches",))
_SENSES = tuple(w for v in lex.SENSES.values() for w in v)
_SPELLED = tuple(f"{a} {b}" for a, b, _ in lex.SPELLINGS) + tuple(f"{a} and {b}" for a, b in lex.HYPHENS)
#: Sentences that the prose of the corpus lacks, one added to each document by its id.
_CASES = (
    "The bridge was built by the town last spring.", "They is late, and the boat were gone.", "We don't want nothing from them.", "The lamp  was lit.",
    "She runs the shop, he makes the bread.", "He left early, and they sat , but nobody spoke.", "Is it broken? The gate was being painted",
    "However, the plan changed. For example, it rained.", "But the road is closed. And the river had been crossed by a ferry.", "The dogs has eaten, we was told.",
    "Dr. Hale paid 3.50 at www.inn.example. U.S. rules apply!", 'Then "Stop!" was heard. "Go on." É. was red.',
)


def sensory(spark, sf_dir):
    d = _with_terms(_docs(spark, sf_dir), _SENSES).select("doc_id", W.sensory().alias("r"))
    count = lambda k: F.coalesce(F.col("r")["by_sense"][k]["count"], F.lit(0)).alias(k)
    return d.select("doc_id", "r.sensory_count", "r.sensory_percentage", *map(count, lex.SENSES))


def _consistent(dialect):
    def run(spark, sf_dir):
        d = _with_terms(_docs(spark, sf_dir), _SPELLED).select("doc_id", W.consistency("text", dialect).alias("r"))
        return d.select("doc_id", "r.total_issues", F.array_join("r.issues", " | ").alias("issues"))

    return run


consistency, consistency_dialect = _consistent(None), _consistent("en-ca")
consistency.__name__, consistency_dialect.__name__ = "consistency", "consistency_dialect"


def acronyms(spark, sf_dir):
    return _long(_docs(spark, sf_dir), W.acronyms()["acronym_list"])


def _cases(spark, sf_dir):
    return _with_terms(_docs(spark, sf_dir), _CASES)


def _long(d, column):
    return unrolled(d, ["doc_id"], column)


def sentence_list(spark, sf_dir):
    return _long(_cases(spark, sf_dir), split_text("text"))


def sentence_reports(spark, sf_dir):
    d = _cases(spark, sf_dir).withColumn("s", sentences("text")).withColumn("w", words("text"))
    s = F.col("s")
    made = d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), S.pacing(s).alias("p"), S.sentence_length(s, in_turn=True).alias("l"), S.transitions(s).alias("t"), S.conjunction_starts(s).alias("c"), S.sticky("text", s, F.col("w")).alias("k"))
    return made.select(
        "doc_id", "n_sentences", "p.fast_percentage", "p.medium_percentage", "p.slow_percentage", "l.avg_length", "l.std_deviation", "l.variety_score", "l.shortest", "l.longest",
        F.size("l.very_long").cast("long").alias("n_very_long"), "t.sentences_with_transitions", "t.transition_percentage", "t.total_transitions", "t.unique_transitions",
        F.col("c.count").alias("conjunction_starts"), F.col("c.percentage").alias("conjunction_percentage"), "k.overall_glue_index", "k.sticky_count", "k.semi_sticky_count",
    )


def sticky_sentences(spark, sf_dir):
    d = _cases(spark, sf_dir).withColumn("s", sentences("text"))
    return _long(d, S.sticky("text", F.col("s"))["sticky_sentences"])


def transition_counts(spark, sf_dir):
    d = _cases(spark, sf_dir).withColumn("s", sentences("text"))
    return _long(d, S.transitions(F.col("s"))["most_common"])


def grammar(spark, sf_dir):
    d = _cases(spark, sf_dir).withColumn("s", sentences("text")).select("doc_id", S.grammar(F.col("s"), 10.0).alias("g"))
    return d.select("doc_id", F.size("g.issues").cast("long").alias("n_issues"), "g.passive_count", "g.passive_percentage", "g.sentence_count", "g.passive_max", "g.over_max")


def grammar_issues(spark, sf_dir):
    d = _cases(spark, sf_dir).withColumn("s", sentences("text")).select("doc_id", F.posexplode(S.grammar_issues(F.col("s"))).alias("ord", "f"))
    return d.select("doc_id", F.col("ord").cast("long").alias("ord"), "f.*")


def passive_voice(spark, sf_dir):
    return _long(_cases(spark, sf_dir).withColumn("s", sentences("text")), S.passives(F.col("s")))


def readability(spark, sf_dir):
    return _cases(spark, sf_dir).select("doc_id", S.readability(F.col("text"), None, 12.0).alias("r")).select("doc_id", "r.*")


#: Syllables of a few words, as a caller might state them.
_SYLLABLES = {w: 1 + len(w) % 5 for w in (*lex.GLUE, "le", "der", "und", "que", "el", "est", "pour", "nicht")}


def readability_with_dictionary(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.readability(F.col("text"), None, dictionary=_SYLLABLES).alias("r")).select("doc_id", "r.grade", "r.syllables")


def readability_dictionary_table(spark, sf_dir):
    """A dictionary that is a table, here of the benchmark's words; every distinct word of the corpus is looked up once."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(bare_tokens("text")).alias("word")).where("word <> ''").distinct()
    return readability_by(_cases(spark, sf_dir), items.selectExpr("word", "1 + length(word) % 5 AS syllables"))


def complex_paragraphs(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    made = analyze(d, checks=["complex_paragraphs"], limit=None).select("doc_id", "complex_paragraphs.*")
    return made.select("doc_id", "complex_count", "percentage", F.explode("complex_paragraphs").alias("f")).select("doc_id", "complex_count", "percentage", "f.*")


def style(spark, sf_dir):
    d = _with_terms(_cases(spark, sf_dir), tuple(lex.HIDDEN_VERBS))
    made = analyze(d, checks=["grammar", "style"], limit=None).select("doc_id", "style.*")
    hidden = F.array_join(F.transform("hidden_verbs", lambda x: F.concat_ws(":", x["noun"], x["verb"], x["count"])), ",")
    return made.select("doc_id", "adverb_count", hidden.alias("hidden_verbs"), "style_score")


def input_sizes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", too_large("text", 4000).alias("error"), too_large("text", None).alias("unlimited"))


def json_reports(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.size(words("text")).alias("n_words"), F.when(F.col("doc_id") % 2 == 0, F.size(tokens("text"))).alias("n_tokens"))
    return as_json(d)


def front_matter(spark, sf_dir):
    d = _docs(spark, sf_dir).selectExpr("doc_id", "concat(CASE doc_id % 4 WHEN 0 THEN '---\na: b\n---\n' WHEN 1 THEN ' \n---\nc: d\n---' WHEN 2 THEN '---\nopen\n' ELSE '' END, replace(text, '---', '==')) AS text")
    return d.select("doc_id", F.md5(D.strip_frontmatter("text")).alias("rest_md5"))


def markdown_headings(spark, sf_dir):
    return _long(_docs(spark, sf_dir).selectExpr("doc_id", f"{woven.MARKDOWN} AS text"), D.headings("text"))


def markdown_prose(spark, sf_dir):
    return _docs(spark, sf_dir).selectExpr("doc_id", f"{woven.MARKDOWN} AS text").select("doc_id", D.prose("text").alias("prose"))


def markdown_tables(spark, sf_dir):
    return _long(_docs(spark, sf_dir).selectExpr("doc_id", f"{woven.MARKDOWN} AS text"), D.table_ranges("text"))


#: Pieces of the caller's vocabulary; with longer ones first a pattern of them finds the longest at each place.
_PIECES = tuple(sorted(("the", "th", "an", "and", "tion", "on", " de", "der", "die ", "en", "ing", "que", "er", "es", " la", "é", "ch", "ing the", ". ", "###"), key=lambda x: (-len(x), x)))
_TABLE = "\n\n| the | and\n|---|---|\n| ing | que |\n\nthe end"


def token_counts(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 2 == 0, _TABLE).otherwise("")))
    return d.select("doc_id", D.token_report("text", list(_PIECES), 2000).alias("t")).select("doc_id", "t.count", "t.over_budget", "t.tokenizer")


def token_bytes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", D.token_report("text", [], 2000).alias("t")).select("doc_id", "t.count", "t.over_budget")


_SECTIONS = "concat('## Where things stand\n', CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' TBD \n' ELSE text END, '\n\n### Decisions made in ', lang, '\n', split_part(text, '\n', 2), '\n\n', CASE WHEN doc_id % 2 = 0 THEN '## What''s next\n\n' || left(text, 40) || '\n\n' ELSE '' END, '# Landmines\n\n## landmines\n\nN/A')"


def completeness(spark, sf_dir):
    return D.sections(_docs(spark, sf_dir).selectExpr("doc_id", f"{_SECTIONS} AS text"), "handoff").select("doc_id", "name", "status")


def completeness_pass(spark, sf_dir):
    d = _docs(spark, sf_dir).selectExpr("doc_id", f"{_SECTIONS} AS text")
    return D.completeness(d, "short", custom={"short": ("Where things stand", "Decisions made")}).select("doc_id", "template", "pass")


def completeness_templates(spark, sf_dir):
    """Each document by the template that its row names; every fourth one names none that there is."""
    d = _docs(spark, sf_dir).selectExpr("doc_id", f"{_SECTIONS} AS text", "element_at(array('adr', 'handoff', 'short', 'none'), cast(doc_id % 4 + 1 AS int)) AS template")
    made = D.completeness_by(d, D.templates_frame(spark, {"short": ("Where things stand", "Decisions made")}))
    return made.select("doc_id", "template", F.array_join(F.transform("sections", lambda x: F.concat_ws("=", x["name"], x["status"])), "; ").alias("sections"), "pass", "error")


_DIRECTED = "concat('<!-- proselake disable grammar, style -->\n', text, '\n<!-- proselake enable grammar --> <!-- proselake disable-next-line echoes, a b -->\n', text, CASE WHEN doc_id % 3 = 0 THEN '\n<!-- proselake disable echoes -->' ELSE '\n<!-- proselake enable style,none -->' END)"


def suppressions(spark, sf_dir):
    return D.suppressions(_docs(spark, sf_dir).selectExpr("doc_id", f"{_DIRECTED} AS text"))


def unsuppressed_lines(spark, sf_dir):
    d = _docs(spark, sf_dir).selectExpr("doc_id", f"{_DIRECTED} AS text")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s")).where(~D.is_directive(F.col("s")))
    found = lines.select("doc_id", (F.col("line") + 1).alias("line"), F.explode(F.array(F.lit("grammar"), F.lit("style"), F.lit("echoes"))).alias("check"))
    return D.unsuppressed(found, D.suppressions(d)).groupBy("doc_id", "check").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


#: Checks whose findings have lines.
_PLACED = ("grammar", "sticky", "pacing", "sentence_length", "conjunction_starts")
_HINTED = "concat('<!-- proselake disable-next-line pacing, sentence_length -->\n', text, CASE doc_id % 7 WHEN 0 THEN '\n<!-- proselake disable sticky -->' WHEN 1 THEN '\n<!-- proselake disable sticky_sentences -->' WHEN 2 THEN '\n<!-- proselake disable-next-line sticky -->' ELSE '' END)"


def findings(spark, sf_dir):
    return all_findings(_cases(spark, sf_dir).selectExpr("doc_id", f"{_HINTED} AS text"), _PLACED, limit=None)


def findings_unsuppressed(spark, sf_dir):
    return visible_findings(_cases(spark, sf_dir).selectExpr("doc_id", f"{_HINTED} AS text"), checks=_PLACED, limit=None)


def path_rules(spark, sf_dir):
    paths = _docs(spark, sf_dir).selectExpr("concat('docs/', source, '/', lang, '/', doc_id, '.md') AS path")
    rules = [{"paths": ["docs/**/*.md"], "checks": {"readability": 8, "tokens": 100}}, {"paths": ["docs/src1/*.md"], "checks": {"readability": 12}}, {"paths": ["[invalid", "docs/src1/en/*.md"], "checks": {"tokens": 7}}, {"paths": ["**/??/[1-4]*{5,6}.md"], "checks": {"grammar": 1}}]
    return D.resolve_rules(paths, rules)


def _many_rules(i: int) -> dict:
    pattern = f"docs/*/{{en,d?,{{f,x}}r}}/*{i // 2 % 100}[{i % 7}-{i % 7 + 2}].md" if i % 2 else f"docs/**/[!3]*{i}.md"
    return {"paths": [pattern, "[open"], "checks": {("readability", "tokens", "grammar")[i % 3]: i}}


def path_rules_table(spark, sf_dir):
    """A thousand rules as a table, over the path of each document."""
    paths = _docs(spark, sf_dir).selectExpr("concat('docs/', source, '/', lang, '/', doc_id, '.md') AS path")
    return D.resolve_rules(paths, D.rules_frame(spark, [_many_rules(i) for i in range(1000)]))


def lint(spark, sf_dir):
    d = _cases(spark, sf_dir).selectExpr("doc_id", "concat('docs/', lang, '/', doc_id, '.txt') AS path", f"concat('<!-- proselake disable-next-line sentence_length -->\n', text, CASE WHEN doc_id % 7 = 0 THEN '\n<!-- proselake disable tokens -->' ELSE '' END) AS text")
    rules = [{"paths": ["docs/**"], "checks": {"readability": {"max_grade": 14}, "tokens": {"budget": 3000}}}, {"paths": ["docs/en/*"], "checks": {"tokens": {"budget": 900}, "analyze": {"checks": ["pacing", "sentence_length"]}}}]
    out = lint_plan(d, rules)
    return out.select("path", F.col("readability.grade").alias("grade"), F.col("readability.over_max").alias("too_hard"), F.col("tokens.count").alias("count"), F.col("tokens.over_budget").alias("over_budget"),
                      F.col("analyze.pacing.slow_percentage").alias("slow_percentage"), F.size("analyze.sentence_length.very_long").cast("long").alias("n_very_long"), "pass")


def corpus_rollup(spark, sf_dir):
    """Every subset of language and source: sums in whole numbers, then means, deviations and shares."""
    return summary(partials(_cases(spark, sf_dir), ["lang", "source"]), ["lang", "source"])


def corpus_sums(spark, sf_dir):
    """Sums of three loads merged, for three groupings."""
    d, by = _cases(spark, sf_dir), ["lang", "source"]
    loads = [partials(d.where(F.col("doc_id") % 3 == k), by, sets=[["lang"], ["source"], []]) for k in range(3)]
    return merged(loads, by).select("lang", "source", "grouping", *(F.col(m).cast("long").alias(m) for m in MEASURES))


def phrase_table(spark, sf_dir):
    """Phrases of a table, taken from the benchmark, in every text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("explode(array(left(lower(text), 4), substr(lower(text), 3, 6))) AS phrase")
    return W.phrases(_docs(spark, sf_dir).withColumn("text", F.lower("text")), items)


def passive_voice_strict(spark, sf_dir):
    """Passives with a least confidence of the caller's."""
    return _long(_cases(spark, sf_dir).withColumn("s", sentences("text")), S.passives(F.col("s"), 0.8))


#: A quarter each: Markdown, sections, text with regions switched off, and documents that no rule names.
_LINTED = f"CASE doc_id % 4 WHEN 0 THEN {woven.MARKDOWN} WHEN 1 THEN {_SECTIONS} ELSE concat('<!-- proselake disable-next-line grammar, sticky_sentences -->\n', text, CASE doc_id % 5 WHEN 0 THEN '\n<!-- proselake disable style -->' WHEN 1 THEN '\n<!-- proselake disable grammar -->' ELSE '' END) END"
_FOLDERS = "concat(CASE doc_id % 4 WHEN 0 THEN 'notes/' WHEN 1 THEN 'handoff/' WHEN 2 THEN 'docs/' ELSE 'other/' END, doc_id, CASE doc_id % 4 WHEN 0 THEN '.md' ELSE '.txt' END)"


def lint_composite(spark, sf_dir):
    """Prose of Markdown, sections, regions of grammar and glue words, whole checks off, the style score, skipped documents."""
    d = _cases(spark, sf_dir).selectExpr(f"{_FOLDERS} AS path", f"{_LINTED} AS text")
    rules = [{"paths": ["notes/*.{md,markdown}"], "checks": {"readability": {"max_grade": 14}, "grammar": {"passive_max": 5}}}, {"paths": ["handoff/*", "[open"], "checks": {"completeness": {"template": "handoff"}}},
             {"paths": ["docs/*"], "checks": {"grammar": {"passive_max": 5}, "analyze": {"checks": ["grammar", "sticky", "style"], "style_min": 60}}}]
    out = lint_plan(d, rules)
    return out.select("path", F.col("readability.grade").alias("grade"), F.col("grammar.sentence_count").alias("n_sentences"), F.size("grammar.issues").cast("long").alias("n_issues"), F.col("grammar.passive_count").alias("n_passives"), F.col("grammar.over_max").alias("too_passive"),
                      F.col("completeness.pass").alias("complete"), F.col("analyze.sticky.sticky_count").alias("n_sticky"), F.col("analyze.style.style_score").alias("style_score"), "pass")


QUERIES = {f.__name__: f for f in (
    sql_kernels, sql_word_table, overused_words, repeated_phrases, echoes, word_totals, word_counts, diction, jargon, cliches, sensory, consistency, consistency_dialect, acronyms, sentence_list, sentence_reports, sticky_sentences, transition_counts,
    grammar, grammar_issues, passive_voice, readability, readability_with_dictionary, readability_dictionary_table, complex_paragraphs, style, input_sizes, json_reports, front_matter, markdown_headings, markdown_prose, markdown_tables, token_counts,
    token_bytes, completeness, completeness_pass, completeness_templates, suppressions, unsuppressed_lines, findings, findings_unsuppressed, path_rules, path_rules_table, lint, lint_composite, passive_voice_strict, phrase_table, corpus_rollup, corpus_sums,
)}

_COUNTED = f"w AS (SELECT doc_id, {_WORDS} AS w FROM documents)"


def _listed_sql(terms, singles, phrases, total, unique) -> str:
    ph = " + ".join(f"(length(l) - length(replace(l, '{p}', ''))) // {len(p)}" for p in phrases)
    kinds = " + ".join(f"CAST(contains(l, '{p}') AS INT)" for p in phrases)
    return f"WITH t AS (SELECT doc_id, lower(text) AS l, {_WORDS} AS w FROM {_terms_sql(terms)}), f AS (SELECT doc_id, l, list_filter(w, lambda x: x IN ({_q(singles)})) AS f FROM t) SELECT doc_id, CAST(len(f) + {ph} AS BIGINT) AS {total}, CAST(len(list_distinct(f)) + {kinds} AS BIGINT) AS {unique} FROM f"


SQL = {
    "overused_words": f"WITH {_COUNTED}, x AS (SELECT doc_id, len(w) AS total, unnest(w) AS word FROM w) SELECT doc_id, word, count(*) AS count, round(100.0::DOUBLE * count(*) / max(total) * 10) / 10 AS frequency FROM x WHERE strlen(word) > 3 AND word NOT IN ({_q(lex.GLUE)}) GROUP BY doc_id, word HAVING 100.0::DOUBLE * count(*) / max(total) > 0.5",
    "repeated_phrases": f"WITH {_COUNTED}, x AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (2), (3), (4)) n(k) WHERE len(w) >= k), g AS (SELECT doc_id, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM x) SELECT doc_id, phrase, count(*) AS count FROM g GROUP BY doc_id, phrase HAVING count(*) > 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, phrase) <= 50",
    "word_counts": f"WITH w AS (SELECT doc_id, text, {_WORDS} AS w FROM documents) SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_filter(string_split_regex(text, '{_SPACE}'), lambda x: x <> '')) AS BIGINT) AS n_tokens, (SELECT count(*) FROM (SELECT unnest(list_transform(string_split(text, chr(10)), lambda s: CAST(trim(s) = '' AS INT))) AS b, generate_subscripts(string_split(text, chr(10)), 1) AS i) q WHERE b = 0 AND (i = 1 OR trim(string_split(text, chr(10))[i - 1]) = '')) AS n_paragraphs, CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: x IN ({_q(lex.GLUE)}))) / len(w) * 100 * 10) / 10 ELSE 0.0 END AS glue_index FROM w",
    "diction": _listed_sql((*lex.VAGUE_WORDS, *lex.VAGUE_PHRASES), lex.VAGUE_WORDS, lex.VAGUE_PHRASES, "total_vague", "unique_vague"),
    "jargon": _listed_sql((*lex.JARGON_WORDS, *lex.JARGON_PHRASES), lex.JARGON_WORDS, lex.JARGON_PHRASES, "total_jargon", "unique_jargon"),
    "cliches": f"SELECT doc_id, CAST({' + '.join(f'(length(l) - length(replace(l, {_q([p])}, {_q([''])}))) // {len(p)}' for p in lex.CLICHES)} AS BIGINT) AS total_cliches FROM (SELECT doc_id, lower(text) AS l FROM {_terms_sql(lex.CLICHES)})",
    "token_bytes": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS count, strlen(text) > 2000 AS over_budget FROM documents",
}


def _add() -> None:
    """SQL that is longer than a line or shares relations."""
    cases, rec = _terms_sql(_CASES), "WITH RECURSIVE "
    langed = f"(SELECT c.doc_id, c.text, d.lang, d.source FROM {cases} c JOIN documents d USING (doc_id))"
    sents = X.sentences(cases)
    lined = "(SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)"
    glue = f"({_q(lex.GLUE)})"
    para = lambda docs: rf"par AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS paragraph FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '^[{X.W}]+|[{X.W}]+$', '', 'g')), lambda p: p <> '') AS l FROM {docs}))"
    echo = f"""ew AS (SELECT doc_id, paragraph, {X.words('text')} AS w FROM par), ep AS (SELECT doc_id, paragraph, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM ew),
ed AS (SELECT *, pos - lag(pos) OVER (PARTITION BY doc_id, paragraph, word ORDER BY pos) AS distance, count(*) OVER (PARTITION BY doc_id, paragraph, word) AS occurrences FROM ep WHERE strlen(word) >= 4 AND word NOT IN {glue}),
ee AS (SELECT * FROM ed WHERE distance < 20 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, paragraph, word, pos) <= 50)"""
    SQL["echoes"] = f"WITH {para(lined)}, {echo} SELECT doc_id, word, CAST(paragraph AS INT) AS paragraph, CAST(distance AS INT) AS distance, occurrences FROM ee"
    SQL["word_totals"] = f"""WITH {para('documents')}, {echo}, o AS ({SQL['overused_words']}), r AS ({SQL['repeated_phrases']}), w AS (SELECT doc_id, {X.words('text')} AS w FROM documents)
SELECT doc_id, CAST(len(list_distinct(w)) AS BIGINT) AS total_unique_words, (SELECT count(*) FROM o WHERE o.doc_id = w.doc_id) AS n_overused, (SELECT count(*) FROM r WHERE r.doc_id = w.doc_id) AS total_repeated, (SELECT count(*) FROM ee WHERE ee.doc_id = w.doc_id) AS total_echoes FROM w"""
    senses = {k: [w for w in v if not any(w in u for j, u in lex.SENSES.items() if list(lex.SENSES).index(j) < list(lex.SENSES).index(k))] for k, v in lex.SENSES.items()}
    each = ", ".join(f"CAST(len(list_filter(w, lambda x: x IN ({_q(v)}))) AS BIGINT) AS {k}" for k, v in senses.items())
    SQL["sensory"] = f"WITH t AS (SELECT doc_id, {X.words('text')} AS w FROM {_terms_sql(_SENSES)}), f AS (SELECT doc_id, len(w) AS n, {each} FROM t) SELECT doc_id, {' + '.join(senses)} AS sensory_count, {X.percent('(' + ' + '.join(senses) + ')', 'n')} AS sensory_percentage, {', '.join(senses)} FROM f"
    SQL["acronyms"] = r"SELECT doc_id, acronym, count(*) AS count FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')) AS acronym FROM documents) WHERE regexp_matches(acronym, '^[A-Z]{2,}$') GROUP BY ALL"
    for name, dialect in (("consistency", None), ("consistency_dialect", "en-ca")):
        has = lambda w: f"regexp_matches(l, '(^|[^a-zA-Z]){w}([^a-zA-Z]|$)')"
        found = []
        for us, uk, pattern in lex.SPELLINGS:
            if dialect:
                # this dialect takes two patterns from one side and the others from the other
                good, bad = (us, uk) if pattern in ("IzeIse", "AmAmme") else (uk, us)
                found.append(f"CASE WHEN {has(bad)} THEN 'Wrong dialect: \"{bad}\" found, expected \"{good}\" ({dialect})' END")
            found.append(f"CASE WHEN {has(us)} AND {has(uk)} THEN 'Mixed US/UK spelling: both \"{us}\" and \"{uk}\" found' END")
        found += [f"CASE WHEN contains(l, '{a}') AND contains(l, '{b}') THEN 'Inconsistent hyphenation: both \"{a}\" and \"{b}\" found' END" for a, b in lex.HYPHENS]
        SQL[name] = f"WITH f AS (SELECT doc_id, list_filter([{', '.join(found)}], lambda x: x IS NOT NULL) AS f FROM (SELECT doc_id, lower(text) AS l FROM {_terms_sql(_SPELLED)})) SELECT doc_id, CAST(len(f) AS BIGINT) AS total_issues, coalesce(array_to_string(f, ' | '), '') AS issues FROM f"
    SQL["sentence_list"] = f"{rec}{sents} SELECT * FROM s"
    hits = f"list_filter([{_q(lex.TRANSITION_WORDS)}], lambda x: list_contains({X.bare('text')}, x)) || list_filter([{_q(lex.TRANSITION_PHRASES)}], lambda x: contains(lower(text), x))"
    first = rf"regexp_replace(lower({X.tokens('text')}[1]), '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g')"
    stats = f"sw AS (SELECT *, len(w) AS n, len(list_filter(w, lambda x: x IN {glue})) AS glue FROM (SELECT doc_id, num, text, {X.words('text')} AS w, {hits} AS hits, {first} AS first FROM s))"
    SQL["sentence_reports"] = f"""{rec}{sents}, {stats},
agg AS (SELECT doc_id, count(*) AS m, count_if(n < 10) AS fast, count_if(n BETWEEN 10 AND 20) AS medium, count_if(n > 20) AS slow, avg(n) AS mean, stddev_pop(n) AS sd, min(n) AS shortest, max(n) AS longest, count_if(n > 30) AS very_long,
  count_if(len(hits) > 0) AS with_t, sum(len(hits)) AS total_t, len(list_distinct(flatten(list(hits)))) AS unique_t, count_if(first IN ({_q(lex.CONJUNCTIONS)})) AS conj,
  count_if(n > 0 AND glue / n * 100 > 45) AS sticky, count_if(n > 0 AND glue / n * 100 > 35 AND glue / n * 100 <= 45) AS semi_ FROM sw GROUP BY doc_id),
dw AS (SELECT doc_id, {X.words('text')} AS w FROM {cases})
SELECT dw.doc_id, coalesce(m, 0) AS n_sentences, {X.percent('fast', 'm')} AS fast_percentage, {X.percent('medium', 'm')} AS medium_percentage, {X.percent('slow', 'm')} AS slow_percentage,
  round(mean * 10) / 10 AS avg_length, round(sd * 10) / 10 AS std_deviation, round(least(sd / 2, 10.0::DOUBLE) * 10) / 10 AS variety_score, shortest, longest, CAST(very_long AS BIGINT) AS n_very_long,
  CAST(coalesce(with_t, 0) AS BIGINT) AS sentences_with_transitions, {X.percent('with_t', 'm')} AS transition_percentage, CAST(coalesce(total_t, 0) AS BIGINT) AS total_transitions, CAST(coalesce(unique_t, 0) AS BIGINT) AS unique_transitions,
  CAST(coalesce(conj, 0) AS BIGINT) AS conjunction_starts, {X.percent('conj', 'm')} AS conjunction_percentage, {X.percent(f'len(list_filter(w, lambda x: x IN {glue}))', 'len(w)')} AS overall_glue_index, CAST(coalesce(sticky, 0) AS BIGINT) AS sticky_count, CAST(coalesce(semi_, 0) AS BIGINT) AS semi_sticky_count
FROM dw LEFT JOIN agg USING (doc_id)"""
    # the longest beginning of at most 100 bytes, by whole characters
    cut = "CASE WHEN strlen(text) <= 100 THEN text ELSE left(text, list_max(list_filter(range(1, 101), lambda k: strlen(left(text, k)) <= 100))) || '...' END"
    SQL["sticky_sentences"] = f"{rec}{sents}, {stats} SELECT doc_id, num AS sentence_num, round(glue / n * 100 * 10) / 10 AS glue_percentage, {cut} AS text FROM sw WHERE n > 0 AND glue / n * 100 > 45"
    SQL["transition_counts"] = f"{rec}{sents}, {stats} SELECT doc_id, transition, count(*) AS count FROM (SELECT doc_id, unnest(hits) AS transition FROM sw) GROUP BY ALL"
    SQL["passive_voice"] = f"{rec}{sents}, {X.passives('s')} SELECT doc_id, text, confidence, sentence_num, auxiliary, participle, has_by_phrase FROM pv"
    SQL["grammar_issues"] = f"{rec}{sents}, {X.issues('s')} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_num, ord) - 1 AS ord, issue_type, message, sentence_num, severity FROM gi"
    SQL["grammar"] = f"""{rec}{sents}, {X.passives('s')}, {X.issues('s')}, m AS (SELECT doc_id, count(*) AS m FROM s GROUP BY doc_id), i AS (SELECT doc_id, count(*) AS i FROM gi GROUP BY doc_id), v AS (SELECT doc_id, count(*) AS v FROM pv GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN m > 0 THEN coalesce(i, 0) END AS n_issues, CASE WHEN m > 0 THEN coalesce(v, 0) END AS passive_count, 100.0::DOUBLE * coalesce(v, 0) / m AS passive_percentage, m AS sentence_count, CASE WHEN m > 0 THEN 10.0::DOUBLE END AS passive_max, 100.0::DOUBLE * coalesce(v, 0) / m > 10 AS over_max
FROM documents d LEFT JOIN m USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN v USING (doc_id)"""
    score = lambda docs, syl: f"""m AS (SELECT doc_id, count(*) AS m FROM s GROUP BY doc_id), r AS (SELECT doc_id, n, m, CAST(y AS BIGINT) AS y FROM (SELECT doc_id, len({X.tokens('text')}) AS n, coalesce(list_sum(list_transform({X.bare('text')}, lambda w: {syl})), 0) AS y FROM {docs}) JOIN m USING (doc_id) WHERE n > 0), {X.graded('r')}"""
    SQL["readability"] = f"{rec}{sents}, {score(cases, X.syllables('w'))} SELECT d.doc_id, grade, m AS sentences, n AS words, y AS syllables, CASE WHEN m > 0 THEN 12.0::DOUBLE END AS max_grade, grade > 12 AS over_max FROM documents d LEFT JOIN g USING (doc_id)"
    known = "CASE " + " ".join(f"WHEN w IN ({_q([x for x, k in _SYLLABLES.items() if k == n])}) THEN {n}" for n in sorted(set(_SYLLABLES.values())))
    SQL["readability_with_dictionary"] = f"{rec}{X.sentences('documents')}, {score('documents', f'{known} ELSE ' + X.syllables('w') + ' END')} SELECT d.doc_id, grade, y AS syllables FROM documents d LEFT JOIN g USING (doc_id)"
    listed = f"(SELECT DISTINCT w FROM (SELECT unnest({X.bare('text')}) AS w FROM benchmark) WHERE w <> '')"
    SQL["readability_dictionary_table"] = f"""{rec}{sents}, dict AS {listed}, m AS (SELECT doc_id, count(*) AS m FROM s GROUP BY doc_id), tk AS (SELECT doc_id, len({X.tokens('text')}) AS n FROM {cases}),
sy AS (SELECT doc_id, CAST(sum(CASE WHEN dict.w IS NOT NULL THEN 1 + length(t.w) % 5 ELSE {X.syllables('t.w')} END) AS BIGINT) AS y FROM (SELECT doc_id, unnest({X.bare('text')}) AS w FROM {cases}) t LEFT JOIN dict ON dict.w = t.w WHERE t.w <> '' GROUP BY doc_id),
al AS (SELECT doc_id, n, coalesce(m, 0) AS m, coalesce(y, 0) AS y FROM tk LEFT JOIN m USING (doc_id) LEFT JOIN sy USING (doc_id)), r AS (SELECT * FROM al WHERE n > 0 AND m > 0), {X.graded('r')}
SELECT al.doc_id, grade, al.m AS sentences, al.n AS words, al.y AS syllables FROM al LEFT JOIN g USING (doc_id)"""
    SQL["complex_paragraphs"] = f"""{rec}{para(lined)}, pk AS (SELECT doc_id * 100000 + paragraph AS doc_id, text FROM par), {X.sentences('pk')}, m AS (SELECT doc_id, count(*) AS m FROM s GROUP BY doc_id),
r AS (SELECT doc_id // 100000 AS doc, doc_id % 100000 AS paragraph, len(w) / m AS a, list_sum(list_transform(w, lambda w: {X.syllables('w')})) / len(w) AS b FROM (SELECT doc_id, {X.words('text')} AS w FROM pk) JOIN m USING (doc_id) WHERE len(w) > 0),
h AS (SELECT *, count(*) OVER (PARTITION BY doc) AS c FROM r WHERE a > 20 AND b > 1.8::DOUBLE), k AS (SELECT doc_id, count(*) AS k FROM par GROUP BY doc_id)
SELECT doc_id, c AS complex_count, round(c / k * 100 * 10) / 10 AS percentage, CAST(paragraph AS INT) AS paragraph_num, round(a * 10) / 10 AS avg_sentence_length, round(b * 10) / 10 AS avg_syllables FROM h JOIN k ON k.doc_id = h.doc"""
    styled = f"(SELECT doc_id, text || ' ' || t || ' ' || t AS text FROM (SELECT doc_id, text, ([{_q(lex.HIDDEN_VERBS)}])[CAST(doc_id % {len(lex.HIDDEN_VERBS)} + 1 AS INT)] AS t FROM {cases}))"
    verb = "CASE noun " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in lex.HIDDEN_VERBS.items()) + " END"
    phrases = " + ".join(f"(length(l) - length(replace(l, '{p}', ''))) // {len(p)}" for p in lex.VAGUE_PHRASES)
    def scored(docs: str, off: str = "false") -> str:
        """Relations ending in sc(doc_id, adverb_count, hidden_verbs, style_score) over a relation of documents and its sentences `s`;
        where `off` holds, passives do not count."""
        return rf"""{X.passives('s')}, v AS (SELECT doc_id, count(*) AS v FROM pv GROUP BY doc_id),
hn AS (SELECT doc_id, noun, count(*) AS c FROM (SELECT doc_id, unnest({X.words('text')}) AS noun FROM {docs}) WHERE noun IN ({_q(lex.HIDDEN_VERBS)}) GROUP BY ALL), hv AS (SELECT doc_id, count(*) AS h, string_agg(noun || ':' || {verb} || ':' || c, ',' ORDER BY noun) AS l FROM hn GROUP BY doc_id),
k AS (SELECT doc_id, l, len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: regexp_matches(x, '[\p{{L}}\p{{M}}\p{{N}}_]ly$'))) AS a, {X.percent(f'len(list_filter(w, lambda x: x IN {glue}))', 'len(w)')} AS g, len(list_filter(w, lambda x: x IN ({_q(lex.VAGUE_WORDS)}))) + {phrases} AS u FROM (SELECT doc_id, text, lower(text) AS l, {X.words('text')} AS w FROM {docs})),
sc AS (SELECT k.doc_id, CAST(a AS BIGINT) AS adverb_count, coalesce(hv.l, '') AS hidden_verbs, CAST(trunc(greatest(100.0::DOUBLE - least(CASE WHEN {off} THEN 0 ELSE coalesce(v, 0) END * 2.0::DOUBLE, 20) - least(a * 0.5::DOUBLE, 15) - least(coalesce(h, 0) * 2.0::DOUBLE, 10) - CASE WHEN g > 25 THEN least(g - 25, 15) ELSE 0 END - least(u * 0.5::DOUBLE, 10), 0)) AS INT) AS style_score
FROM k LEFT JOIN v USING (doc_id) LEFT JOIN hv USING (doc_id))"""

    SQL["style"] = f"{rec}st AS {styled}, {X.sentences('st')}, {scored('st')} SELECT * FROM sc"
    SQL["sql_kernels"] = f"""{rec}{X.sentences('documents')}, k AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_filter(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '')) AS BIGINT) AS n_paragraphs,
  coalesce(k, 0) AS n_sentences, CAST(strlen(text) AS BIGINT) AS n_tokens, md5(w[-1]) AS last_md5 FROM (SELECT doc_id, text, {X.words('text')} AS w FROM documents) d LEFT JOIN k USING (doc_id)"""
    SQL["sql_word_table"] = f"SELECT doc_id, count(*) AS n, CAST(sum({X.syllables('w')}) AS BIGINT) AS syllables, CAST(count(*) - 1 AS BIGINT) AS last FROM (SELECT doc_id, unnest({X.words('text')}) AS w FROM documents) GROUP BY doc_id"
    SQL["input_sizes"] = "SELECT doc_id, CASE WHEN strlen(text) > 4000 THEN 'input of ' || strlen(text) || ' bytes is over the limit of 4000' END AS error, CAST(NULL AS VARCHAR) AS unlimited FROM documents"
    SQL["json_reports"] = f"""SELECT doc_id, '{{"n_words":' || len({X.words('text')}) || CASE WHEN doc_id % 2 = 0 THEN ',"n_tokens":' || len({X.tokens('text')}) ELSE '' END || '}}' AS report FROM documents"""
    body = "replace(text, '---', '==')"
    SQL["front_matter"] = f"SELECT doc_id, md5(CASE WHEN doc_id % 4 < 2 THEN {body} WHEN doc_id % 4 = 2 THEN '---' || chr(10) || 'open' || chr(10) || {body} ELSE {body} END) AS rest_md5 FROM documents"
    SQL["markdown_headings"], SQL["markdown_prose"], SQL["markdown_tables"] = woven.HEADINGS_SQL, woven.PROSE_SQL, woven.TABLES_SQL
    pattern = "|".join(x.replace("'", "''").replace(".", "[.]") for x in _PIECES)
    # the table and the line after it: 7, 9 and 9 tokens, then 5
    n = f"strlen(t) - list_sum(list_transform(regexp_extract_all(t || '#the', '{pattern}'), lambda x: strlen(x) - 1)) + 2"
    SQL["token_counts"] = f"""WITH k AS (SELECT doc_id, {n} + CASE WHEN doc_id % 2 = 0 THEN 30 ELSE 0 END AS count FROM (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) ELSE '' END AS t FROM documents)) SELECT doc_id, CAST(count AS BIGINT) AS count, count > 2000 AS over_budget, 'greedy' AS tokenizer FROM k"""
    SQL["completeness"] = _sections_sql(("Where things stand", "Decisions made", "What's next", "Landmines")) + " SELECT doc_id, name, status FROM st"
    SQL["completeness_pass"] = _sections_sql(("Where things stand", "Decisions made")) + " SELECT doc_id, 'short' AS template, bool_and(status = 'present') AS pass FROM st GROUP BY doc_id"
    lines = "CAST(length(text) - length(replace(text, chr(10), '')) AS INT)"
    rules = f"""n AS (SELECT doc_id, {lines} + 3 AS k, 2 * {lines} + 4 AS z FROM documents), sup AS (
  SELECT doc_id, 'grammar' AS "check", 1 AS start, k AS "end", false AS file_level FROM n
  UNION ALL SELECT doc_id, 'style', CASE WHEN doc_id % 3 > 0 THEN 1 END, CASE WHEN doc_id % 3 > 0 THEN z + 1 END, doc_id % 3 = 0 FROM n
  UNION ALL SELECT doc_id, 'echoes', CASE WHEN doc_id % 3 > 0 THEN k + 1 END, CASE WHEN doc_id % 3 > 0 THEN k + 1 END, doc_id % 3 = 0 FROM n
  UNION ALL SELECT doc_id, 'a b', k + 1, k + 1, false FROM n)"""
    SQL["suppressions"] = f'WITH {rules} SELECT * FROM sup'
    SQL["unsuppressed_lines"] = f"""WITH {rules}, l AS (SELECT doc_id, unnest(range(2, z + 1)) AS line, k FROM n), f AS (SELECT doc_id, line, c AS "check" FROM l, (VALUES ('grammar'), ('style'), ('echoes')) v(c) WHERE line <> k)
SELECT doc_id, "check", count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM f WHERE NOT EXISTS (SELECT 1 FROM sup WHERE sup.doc_id = f.doc_id AND sup."check" = f."check" AND (file_level OR line BETWEEN start AND "end")) GROUP BY ALL"""
    hinted = f"(SELECT doc_id, {_HINTED} AS text FROM {cases})"
    bare_lines = "(SELECT doc_id, regexp_replace(text, '<!-- proselake [^\n]*', '', 'g') AS text FROM hi)"
    found = f"""{rec}hi AS {hinted}, {X.sentences('hi')}, {X.sentences(bare_lines, 'b')}, {stats}, {X.passives('s')}, {X.issues('s')},
u AS (SELECT doc_id, 'grammar' AS "check", 0 AS part, sentence_num AS num, ord AS k, issue_type AS kind, severity, message FROM gi
  UNION ALL SELECT doc_id, 'grammar', 1, sentence_num, i, 'PassiveVoice', NULL, text FROM pv
  UNION ALL SELECT doc_id, 'sticky', 0, num, 0, NULL, NULL, {cut} FROM sw WHERE n > 0 AND glue / n * 100 > 45
  UNION ALL SELECT doc_id, 'pacing', 0, num, 0, NULL, NULL, n || ' words' FROM sw WHERE n > 20
  UNION ALL SELECT doc_id, 'sentence_length', 0, num, 0, NULL, NULL, n || ' words' FROM sw WHERE n > 30
  UNION ALL SELECT doc_id, 'conjunction_starts', 0, num, 0, NULL, NULL, w[1] FROM sw WHERE first IN ({_q(lex.CONJUNCTIONS)})),
f AS (SELECT u.doc_id, "check", CAST(row_number() OVER (PARTITION BY u.doc_id, "check" ORDER BY part, u.num, k) - 1 AS INT) AS ordinal, coalesce(b.line, 0) AS line, kind, severity, message, CAST(1 AS BIGINT) AS amount
  FROM u LEFT JOIN b ON b.doc_id = u.doc_id AND b.num = u.num)"""
    chosen = {1: lex.TEMPLATES["handoff"], 0: lex.TEMPLATES["adr"], 2: ("Where things stand", "Decisions made")}
    each = " UNION ALL ".join(f"SELECT doc_id, string_agg(name || '=' || status, '; ' ORDER BY list_position([{_q(names)}], name)) AS sections, bool_and(status = 'present') AS pass FROM ({_sections_sql(names)} SELECT * FROM st) WHERE doc_id % 4 = {k} GROUP BY doc_id" for k, names in chosen.items())
    SQL["completeness_templates"] = f"SELECT d.doc_id, (['adr', 'handoff', 'short', 'none'])[CAST(d.doc_id % 4 + 1 AS INT)] AS template, sections, pass, CASE WHEN d.doc_id % 4 = 3 THEN 'no such template: none' END AS error FROM documents d LEFT JOIN ({each}) e USING (doc_id)"
    SQL["findings"] = f"{found} SELECT * FROM f"
    per_doc = f"""{rec}ld AS {langed}, {X.sentences('ld')}, {stats}, {X.passives('s')}, {X.issues('s')},
ds AS (SELECT doc_id, count(*) AS sentences, sum(n) AS lengths, sum(n * n) AS length_squares, count_if(n > 30) AS long_sentences FROM sw GROUP BY doc_id),
dp AS (SELECT doc_id, count(*) AS passives FROM pv GROUP BY doc_id), di AS (SELECT doc_id, count(*) AS issues FROM gi GROUP BY doc_id),
dm AS (SELECT lang, source, 1 AS documents, len({X.tokens('text')}) AS tokens, len({X.words('text')}) AS words, coalesce(list_sum(list_transform({X.bare('text')}, lambda w: {X.syllables('w')})), 0) AS syllables, coalesce(sentences, 0) AS sentences,
  coalesce(lengths, 0) AS lengths, coalesce(length_squares, 0) AS length_squares, coalesce(passives, 0) AS passives, coalesce(issues, 0) AS issues, len(list_filter({X.words('text')}, lambda x: x IN {glue})) AS glue_words, coalesce(long_sentences, 0) AS long_sentences
  FROM ld LEFT JOIN ds USING (doc_id) LEFT JOIN dp USING (doc_id) LEFT JOIN di USING (doc_id))"""
    sums = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in MEASURES)
    SQL["corpus_sums"] = f"{per_doc} SELECT lang, source, CAST(grouping(lang, source) AS BIGINT) AS grouping, {sums} FROM dm GROUP BY GROUPING SETS ((lang), (source), ())"
    SQL["corpus_rollup"] = f"""{per_doc}, cu AS (SELECT lang, source, CAST(grouping(lang, source) AS BIGINT) AS grouping, {sums} FROM dm GROUP BY CUBE (lang, source)), cg AS (SELECT *, tokens AS n, sentences AS m, syllables AS y FROM cu), {X.graded('cg', 'gg')}
SELECT lang, source, grouping, documents, words, round(lengths::DOUBLE / sentences * 10) / 10 AS mean_length, round(sqrt((sentences::HUGEINT * length_squares - lengths::HUGEINT * lengths)::DOUBLE) / sentences * 10) / 10 AS deviation, round(grade * 10) / 10 AS grade,
  round(passives::DOUBLE / sentences * 100 * 10) / 10 AS passive_percentage, round(glue_words::DOUBLE / words * 100 * 10) / 10 AS glue_index, round(issues::DOUBLE / sentences * 100 * 10) / 10 AS issues_per_100 FROM gg"""
    SQL["phrase_table"] = """WITH p AS (SELECT DISTINCT unnest([left(lower(text), 4), substr(lower(text), 3, 6)]) AS phrase FROM benchmark)
SELECT doc_id, phrase, CAST((length(lower(text)) - length(replace(lower(text), phrase, ''))) // length(phrase) AS BIGINT) AS count FROM documents, p WHERE phrase <> '' AND contains(lower(text), phrase)"""
    SQL["passive_voice_strict"] = SQL["passive_voice"] + " WHERE confidence >= 0.8::DOUBLE"
    linted_all = f"""{rec}{woven.WOVEN_SQL.replace('FROM documents', f'FROM {cases}')}, wv AS (SELECT doc_id, coalesce(string_agg(piece, '' ORDER BY i), '') AS raw, coalesce(string_agg(prose, '' ORDER BY i), '') AS prose FROM (SELECT doc_id FROM {cases}) LEFT JOIN woven USING (doc_id) GROUP BY doc_id),
lp AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN prose ELSE concat('<!-- proselake disable-next-line grammar, sticky_sentences -->\n', text, CASE doc_id % 5 WHEN 0 THEN '\n<!-- proselake disable style -->' WHEN 1 THEN '\n<!-- proselake disable grammar -->' ELSE '' END) END AS text FROM {cases} JOIN wv USING (doc_id) WHERE doc_id % 4 IN (0, 2)),
lb AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN raw ELSE regexp_replace(text, '<!-- proselake [^\n]*', '', 'g') END AS text FROM lp JOIN wv USING (doc_id)),
{X.sentences('lp')}, {X.sentences('lb', 'b')}, {score('lp', X.syllables('w'))}, {stats}, {scored('lp', 'doc_id % 5 = 1')}, {X.issues('s')},
seen AS (SELECT s.doc_id, s.num, s.doc_id % 4 = 0 OR coalesce(b.line, 0) <> 2 AS seen FROM s LEFT JOIN b ON b.doc_id = s.doc_id AND b.num = s.num),
ns AS (SELECT doc_id, count(*) AS ns FROM s GROUP BY doc_id),
ni AS (SELECT gi.doc_id, count(*) AS ni FROM gi JOIN seen ON seen.doc_id = gi.doc_id AND seen.num = gi.sentence_num WHERE seen GROUP BY gi.doc_id),
np AS (SELECT pv.doc_id, count(*) AS np FROM pv JOIN seen ON seen.doc_id = pv.doc_id AND seen.num = pv.sentence_num WHERE seen GROUP BY pv.doc_id),
nt AS (SELECT sw.doc_id, count(*) AS nt FROM sw JOIN seen USING (doc_id, num) WHERE seen AND n > 0 AND glue / n * 100 > 45 GROUP BY sw.doc_id),
-- a whole check that is off leaves the list, and its passives the score
g2 AS (SELECT doc_id, ns, doc_id % 4 = 2 AND doc_id % 5 = 1 AS no_grammar, coalesce(ni, 0) AS ni, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt, grade,
    CASE WHEN doc_id % 5 > 0 THEN style_score END AS score FROM ns LEFT JOIN ni USING (doc_id) LEFT JOIN np USING (doc_id) LEFT JOIN nt USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN sc USING (doc_id))"""
    SQL["lint_composite"] = f"""{linted_all}, fin AS (
SELECT {_FOLDERS} AS path, CASE doc_id % 4 WHEN 0 THEN grade END AS grade, CASE WHEN NOT no_grammar THEN ns END AS n_sentences, CASE WHEN NOT no_grammar THEN ni END AS n_issues, CASE WHEN NOT no_grammar THEN np END AS n_passives,
  CASE WHEN NOT no_grammar THEN 100.0::DOUBLE * np / ns > 5 END AS too_passive, NULL::BOOLEAN AS complete, CASE doc_id % 4 WHEN 2 THEN nt END AS n_sticky, CASE doc_id % 4 WHEN 2 THEN score END AS style_score FROM g2
UNION ALL SELECT {_FOLDERS}, NULL, NULL, NULL, NULL, NULL, complete, NULL, NULL FROM (SELECT doc_id, bool_and(status = 'present') AS complete FROM ({_sections_sql(lex.TEMPLATES['handoff'], langed)} SELECT * FROM st) GROUP BY doc_id) WHERE doc_id % 4 = 1)
SELECT *, NOT coalesce(grade > 14, false) AND NOT coalesce(too_passive, false) AND coalesce(complete, true) AND NOT coalesce(style_score < 60, false) AS pass FROM fin"""
    SQL["findings_unsuppressed"] = f"""{found} SELECT * FROM f WHERE NOT ("check" IN ('pacing', 'sentence_length') AND line = 2) AND NOT ("check" = 'sticky' AND doc_id % 7 < 2)"""
    SQL["path_rules"] = r"""WITH p AS (SELECT DISTINCT 'docs/' || source || '/' || lang || '/' || doc_id || '.md' AS path FROM documents),
r(rule_idx, pattern, specificity, "check", settings) AS (VALUES (0, '^docs/(.*/)?[^/]*\.md$', 1, 'readability', '8'), (0, '^docs/(.*/)?[^/]*\.md$', 1, 'tokens', '100'), (1, '^docs/src1/.*\.md$', 2, 'readability', '12'), (2, '^docs/src1/en/.*\.md$', 3, 'tokens', '7'), (3, '^(.*/)?../[1-4].*(5|6)\.md$', 0, 'grammar', '1'))
SELECT path, "check", rule_idx, settings FROM p JOIN r ON regexp_matches(path, pattern) QUALIFY row_number() OVER (PARTITION BY path, "check" ORDER BY specificity DESC, rule_idx) = 1"""
    SQL["path_rules_table"] = r"""WITH p AS (SELECT 'docs/' || source || '/' || lang || '/' || doc_id || '.md' AS path FROM documents),
r AS (SELECT CAST(i AS INT) AS rule_idx, CASE i % 3 WHEN 0 THEN 'readability' WHEN 1 THEN 'tokens' ELSE 'grammar' END AS "check", CAST(i AS VARCHAR) AS settings, 1 AS specificity,
  CASE WHEN i % 2 = 1 THEN '^docs/.*/(en|d.|(f|x)r)/.*' || (i // 2 % 100) || '[' || (i % 7) || '-' || (i % 7 + 2) || ']\.md$' ELSE '^docs/(.*/)?[^3].*' || i || '\.md$' END AS pattern FROM range(1000) t(i))
SELECT path, "check", rule_idx, settings FROM p JOIN r ON regexp_matches(path, pattern) QUALIFY row_number() OVER (PARTITION BY path, "check" ORDER BY specificity DESC, rule_idx) = 1"""
    linted = f"(SELECT doc_id, lang, '<!-- proselake disable-next-line sentence_length -->' || chr(10) || text || CASE WHEN doc_id % 7 = 0 THEN chr(10) || '<!-- proselake disable tokens -->' ELSE '' END AS text FROM {cases} JOIN (SELECT doc_id, lang FROM documents) USING (doc_id))"
    blank = "(SELECT doc_id, regexp_replace(text, '<!-- proselake [^\n]*', '', 'g') AS text FROM li)"
    SQL["lint"] = f"""{rec}li AS {linted}, {X.sentences('li')}, {X.sentences(blank, 'b')}, {score('li', X.syllables('w'))}, sw AS (SELECT doc_id, num, len({X.words('text')}) AS n FROM s),
a AS (SELECT sw.doc_id, {X.percent('count_if(n > 20)', 'count(*)')} AS slow, CAST(count_if(n > 30 AND coalesce(b.line, 0) <> 2) AS BIGINT) AS long FROM sw LEFT JOIN b ON b.doc_id = sw.doc_id AND b.num = sw.num GROUP BY sw.doc_id),
t AS (SELECT li.doc_id, lang, grade, CASE WHEN doc_id % 7 > 0 THEN strlen(text) END AS count, CASE WHEN lang = 'en' THEN slow END AS slow, CASE WHEN lang = 'en' THEN long END AS long FROM li LEFT JOIN g USING (doc_id) LEFT JOIN a USING (doc_id))
SELECT 'docs/' || lang || '/' || doc_id || '.txt' AS path, grade, grade > 14 AS too_hard, count, count > CASE WHEN lang = 'en' THEN 900 ELSE 3000 END AS over_budget, slow AS slow_percentage, long AS n_very_long,
  NOT coalesce(grade > 14, false) AND NOT coalesce(count > CASE WHEN lang = 'en' THEN 900 ELSE 3000 END, false) AS pass FROM t"""


def _sections_sql(names, docs: str = "documents") -> str:
    """Relation `st` (doc_id, name, status) from the lines of the built texts over (doc_id, text, lang)."""
    space = f"[{X.W}]+"
    return rf"""WITH d AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM (SELECT doc_id, {_SECTIONS} AS t FROM {docs})),
ln AS (SELECT doc_id, regexp_replace(x, '^{space}|{space}$', '', 'g') AS x, x AS raw, i FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM d)),
hd AS (SELECT doc_id, i, length(regexp_extract(raw, '^ {{0,3}}(#+)', 1)) AS level, regexp_extract(raw, '^ {{0,3}}#+[ 	]+(.*?)[ 	]*$', 1) AS text FROM ln WHERE regexp_matches(raw, '^ {{0,3}}#{{1,6}}[ 	]')),
pk AS (SELECT doc_id, name, level, text FROM hd, (VALUES {', '.join("('" + n.replace("'", "''") + "')" for n in names)}) v(name) WHERE level IN (2, 3) AND contains(lower(text), lower(name)) QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY i) = 1),
fr AS (SELECT pk.doc_id, name, level, min(i) AS a FROM pk JOIN ln ON ln.doc_id = pk.doc_id AND x LIKE '#%' AND contains(x, text) GROUP BY ALL),
till AS (SELECT fr.doc_id, name, a, min(i) AS b FROM fr LEFT JOIN ln ON ln.doc_id = fr.doc_id AND i > a AND x LIKE '#%' AND length(regexp_extract(x, '^(#+)')) <= level GROUP BY ALL),
bd AS (SELECT till.doc_id, name, lower(regexp_replace(coalesce(string_agg(x, chr(10) ORDER BY i), ''), '^{space}|{space}$', '', 'g')) AS body FROM till LEFT JOIN ln ON ln.doc_id = till.doc_id AND i > a AND (b IS NULL OR i < b) GROUP BY ALL),
st AS (SELECT d.doc_id, v.name, CASE WHEN body IS NULL THEN 'missing' WHEN body = '' OR body IN ({_q(lex.PLACEHOLDERS)}) THEN 'empty' ELSE 'present' END AS status FROM d CROSS JOIN (VALUES {', '.join("('" + n.replace("'", "''") + "')" for n in names)}) v(name) LEFT JOIN bd ON bd.doc_id = d.doc_id AND bd.name = v.name)"""


_add()
