"""Document gates: front matter, sections, token budgets, inline suppressions and path rules."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions import lexicons as lex
from proselake.functions.globs import PatternSet, specificity
from proselake.functions.kept import kept
from proselake.functions.markdown import headings_of, prose_of, table_ranges_of, table_spans
from proselake.functions.text import let, stripped, text_of, unrolled


def strip_frontmatter(c) -> Column:
    """Drop a leading block between lines of three dashes, white space before it too; without a closing line nothing changes."""
    t = text_of(c)
    return F.when(t.rlike(r"(?sU)^\s*---.*?\n---"), F.regexp_replace(t, r"(?sU)^\s*---.*?\n---\n?", "")).otherwise(t)


def _each(f, kind: str, made: pa.DataType):
    """`f` of each text of a batch; a null text counts as empty."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([f(t.as_py() or "") for t in texts], made)

    return F.arrow_udf(run, kind)


def prose_function():
    """Markdown without its markup, as `functions.markdown` reads it; no expression parses it."""
    return _each(prose_of, "string", pa.string())


def headings_function():
    return _each(headings_of, "array<struct<level:int,text:string>>", pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())])))


def prose(c) -> Column:
    return prose_function()(c)


def headings(c) -> Column:
    return headings_function()(c)


def template_names(custom: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """The names of all templates: those built in, then the caller's own."""
    return list(dict.fromkeys([*lex.TEMPLATES, *(custom or {})]))


def template_sections(template: str, custom: dict[str, tuple[str, ...]] | None = None) -> tuple[str, ...]:
    """The sections that a template asks for; the caller's own templates go first."""
    names = (custom or {}).get(template) or lex.TEMPLATES.get(template)
    if names is None:
        raise ValueError(f"no such template: {template}")
    return tuple(names)


def section_report(text, heads: Column, names) -> Column:
    """[{name, status}]: present, empty or missing for each section; `heads` is the column of `headings`. Within the row.

    `names` is a list, or a column of arrays where each row has a list of its own.
    """
    marks = F.transform(F.split(text_of(text), "\n"), lambda x, i: F.struct(i.alias("i"), stripped(x).alias("t")))
    level = lambda t: F.length(F.regexp_extract(t, "^(#+)", 1))
    first = lambda found: F.get(found, F.lit(0))

    def body(lines: Column, head: Column) -> Column:
        title = lambda x: x["t"].startswith("#")
        start = first(F.filter(lines, lambda x: title(x) & F.contains(x["t"], head["text"])))["i"]
        after = lambda s: F.slice(lines, s + 2, F.size(lines))
        stop = lambda s: first(F.filter(after(s), lambda x: title(x) & (level(x["t"]) <= head["level"])))["i"]
        inside = lambda s: let(F.coalesce(stop(s), F.size(lines)), lambda e: F.filter(after(s), lambda x: x["i"] < e))
        return let(start, lambda s: F.when(s.isNotNull(), F.array_join(F.transform(inside(s), lambda x: x["t"]), "\n")))

    def status(lines: Column, head: Column) -> Column:
        told = lambda t: F.when((t == "") | t.isin(*lex.PLACEHOLDERS), "empty").otherwise("present")
        return F.when(head.isNull(), "missing").otherwise(let(F.lower(stripped(F.coalesce(body(lines, head), F.lit("")))), told))

    def result(lines: Column, name: Column) -> Column:
        head = first(F.filter(heads, lambda h: h["level"].isin(2, 3) & F.contains(F.lower(h["text"]), F.lower(name))))
        return F.struct(name.alias("name"), let(head, lambda h: status(lines, h)).alias("status"))

    asked = names if isinstance(names, Column) else F.array(*map(F.lit, names))
    return let(marks, lambda lines: F.transform(asked, lambda n: result(lines, n)))


def completeness_report(text, heads: Column, template: str, custom=None) -> Column:
    """{template, sections, pass}: a document passes if all sections are present."""
    found = section_report(text, heads, template_sections(template, custom))
    whole = lambda s: F.struct(F.lit(template).alias("template"), s.alias("sections"), F.forall(s, lambda x: x["status"] == "present").alias("pass"))
    return let(found, whole)


#: Sections of templates that may be sent to all tasks; a longer table of templates meets the documents in an exchange.
TEMPLATE_ROWS = 10_000


def templates_frame(spark: SparkSession, custom: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """All templates, the caller's own in place of those built in, as a table (template, ord, name)."""
    rows = [(t, i, n) for t in template_names(custom) for i, n in enumerate(template_sections(t, custom))]
    return spark.createDataFrame(rows, "template string, ord int, name string")


def completeness_by(docs: DataFrame, templates: DataFrame, template: str = "template", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, template, sections, pass, error) of each row by the template that its own column names.

    `templates` is a table (template, ord, name); sections of one template are asked for in the order of ord, of equal ones by
    name. A null or unknown template gives an error and nulls. Templates are small beside documents: up to `TEMPLATE_ROWS`
    rows of them are sent to the tasks, so no text moves; with more, documents and templates meet by the name.
    """
    lists = templates.where("template IS NOT NULL AND name IS NOT NULL").groupBy(F.col("template").alias("__of")).agg(F.sort_array(F.collect_list(F.struct("ord", "name"))).alias("__l"))
    lists = lists.select("__of", F.transform("__l", lambda x: x["name"]).alias("__names"))
    small = templates.limit(TEMPLATE_ROWS + 1).count() <= TEMPLATE_ROWS
    d = docs.select(F.col(key).alias("__key"), F.col(template).alias("__of"), F.col(text).alias("__t"))
    d = d.join(F.broadcast(lists) if small else lists, "__of", "left")
    d = d.withColumn("__h", headings(F.when(F.col("__names").isNotNull(), F.col("__t"))))
    found = F.when(F.col("__names").isNotNull(), section_report("__t", F.col("__h"), F.col("__names")))
    d = d.withColumn("__s", found)
    error = F.when(F.col("__names").isNull(), F.concat(F.lit("no such template: "), F.coalesce("__of", F.lit("null"))))
    return d.select(F.col("__key").alias(key), F.col("__of").alias("template"), F.col("__s").alias("sections"), F.forall("__s", lambda x: x["status"] == "present").alias("pass"), error.alias("error"))


def sections(docs: DataFrame, template: str, key: str = "doc_id", text: str = "text", custom=None) -> DataFrame:
    """(key, ord, name, status) of each row's sections, one to a row."""
    names = template_sections(template, custom)
    d = docs.select(key, F.col(text).alias("__t"), headings(text).alias("__h"))
    return d.select(key, F.posexplode(section_report("__t", F.col("__h"), names)).alias("ord", "__s")).select(key, "ord", "__s.*")


def completeness(docs: DataFrame, template: str, key: str = "doc_id", text: str = "text", custom=None) -> DataFrame:
    """(key, template, sections, pass) of each row."""
    d = docs.select(key, F.col(text).alias("__t"), headings(text).alias("__h"))
    return d.select(key, completeness_report("__t", F.col("__h"), template, custom).alias("__c")).select(key, "__c.*")


def table_ranges(c) -> Column:
    return _each(table_ranges_of, "array<struct<start:long,end:long>>", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))(text_of(c))


class _Greedy:
    """An automaton over the bytes of a vocabulary, which finds the leftmost longest pieces of a text in one pass."""

    def __init__(self, known: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for v in known:
            self.automaton.add_word(v, len(v))
        self.automaton.make_automaton()

    def tokens(self, text: str) -> int:
        data = text.encode().decode("latin-1")
        return len(data) - sum(n - 1 for _, n in self.automaton.iter_long(data))


def greedy_count(vocabulary: list[str]):
    """Tokens by the leftmost longest match of a vocabulary; each byte without a match is one token.

    A worker makes the automaton once, whatever the number of its tasks and however large the vocabulary. Tables count
    cell by cell: each bar is a token, the line ends inside cost nothing.
    """
    known = sorted({v.encode().decode("latin-1") for v in vocabulary if v})
    key = ("vocabulary", hashlib.sha256("\0".join(known).encode()).hexdigest())

    def raw(text: str) -> int:
        return kept(key, lambda: _Greedy(known)).tokens(text)

    def count(text: str) -> int:
        if not known:
            return len(text.encode())
        if "|" not in text:
            return raw(text)
        total, at = 0, 0
        for start, end in table_spans(text):
            table = text[start:end]
            total += raw(text[at:start]) + table.count("|") + sum(raw(cell) for line in table.split("\n") for cell in line.split("|") if cell)
            # the end of the last row's line costs nothing either
            at = end + text.startswith("\n", end)
        return total + raw(text[at:])

    return _each(count, "long", pa.int64())


def token_report(c, vocabulary: list[str], budget: int | None = None) -> Column:
    """Count, budget and verdict; the vocabulary is the caller's, an empty one counts bytes."""
    n = F.octet_length(text_of(c)).cast("long") if not vocabulary else greedy_count(vocabulary)(c)
    over = F.lit(False) if budget is None else n > budget
    return F.struct(n.alias("count"), F.lit(budget).cast("long").alias("budget"), over.alias("over_budget"), F.lit("greedy" if vocabulary else "bytes").alias("tokenizer"))


def _directive(marker: str) -> str:
    return rf"(?U)<!--\s*{re.escape(marker)}\s+(disable-next-line|disable|enable)\s+([\w,\s]+?)\s*-->"


def is_directive(line: Column, marker: str = "proselake") -> Column:
    return line.contains("<!--") & line.rlike(_directive(marker))


def directives_blanked(text: Column, marker: str) -> Column:
    """The text with each line that holds a directive emptied, so that lines keep their numbers."""
    blanked = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(is_directive(x, marker), F.lit("")).otherwise(x)), "\n")
    return F.when(text.contains("<!--"), blanked).otherwise(text)


def suppressed(text, marker: str = "proselake") -> Column:
    """[{check, start, end, file_level}]: line ranges switched off by directives in comments, by check and line.

    A line may hold several directives, and each several checks, parted by commas. A range runs from the last `disable`
    to the next `enable`, both lines included; one that is still open at the end switches the check off for the whole
    file, and its other ranges with it. Within the row; a text without directives gives an empty array.
    """
    t, pattern = text_of(text), F.lit(_directive(marker))

    def acts(x: Column, i: Column) -> Column:
        found = F.arrays_zip(F.regexp_extract_all(x, pattern, F.lit(1)).alias("act"), F.regexp_extract_all(x, pattern, F.lit(2)).alias("names"))
        each = F.transform(found, lambda d: F.transform(F.split(d["names"], ","), lambda n: F.struct((i + 1).alias("line"), d["act"].alias("act"), stripped(n).alias("check"))))
        return F.filter(F.flatten(each), lambda a: a["check"] != "")

    lines = F.transform(F.split(t, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    some = F.filter(lines, lambda y: is_directive(y["x"], marker))
    spot = lambda check, start, end: F.struct(check.alias("check"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(False).alias("file_level"))

    def of_check(all_: Column, check: Column) -> Column:
        own = F.filter(all_, lambda a: a["check"] == check)
        return let(F.filter(own, lambda a: a["act"] != "disable-next-line"), lambda block: ranges(own, block, check))

    def ranges(own: Column, block: Column, check: Column) -> Column:
        prior = lambda i: F.get(block, i - 1)
        closed = F.transform(block, lambda a, i: F.when((a["act"] == "enable") & (prior(i)["act"] == "disable"), spot(check, prior(i)["line"], a["line"])))
        nexts = F.transform(F.filter(own, lambda a: a["act"] == "disable-next-line"), lambda a: spot(check, a["line"] + 1, a["line"] + 1))
        none = F.lit(None).cast("int")
        whole = F.array(F.struct(check.alias("check"), none.alias("start"), none.alias("end"), F.lit(True).alias("file_level")))
        return F.when(F.get(block, F.size(block) - 1)["act"] == "disable", whole).otherwise(F.concat(F.array_compact(closed), nexts))

    checks = lambda all_: F.sort_array(F.array_distinct(F.transform(all_, lambda a: a["check"])))
    found = let(F.flatten(F.transform(some, lambda y: acts(y["x"], y["i"]))), lambda all_: F.flatten(F.transform(checks(all_), lambda c: of_check(all_, c))))
    return F.when(t.contains("<!--"), found).otherwise(F.array().cast("array<struct<check:string,start:int,end:int,file_level:boolean>>"))


def suppressions(docs: DataFrame, key: str = "doc_id", text: str = "text", marker: str = "proselake") -> DataFrame:
    """(key, check, start, end, file_level): the ranges of each row, one to a row."""
    return unrolled(docs, [key], suppressed(text, marker))


#: Lines of a document that meet in one group when findings are compared with ranges.
LINE_BLOCK = 4096


def unsuppressed(findings: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings (key, check, line, ...) that no suppression covers.

    Ranges of a key and check are merged first, then cut at blocks of lines. In each block findings and ranges are swept together:
    a finding is covered if the furthest end of the ranges that begin at or before it reaches it. So the work is that of
    sorting both, however many ranges a document has, and a document of many lines is spread over tasks. A null key, check
    or line is in no range, a null key or check in no file; repeated findings stay each.
    """
    names = [f"c_{i}" for i in range(len(findings.columns))]
    place = {c: names[findings.columns.index(c)] for c in (key, "check", "line")}
    f = findings.toDF(*names)
    known = rules.select(F.col(key).alias(place[key]), F.col("check").alias(place["check"]), "start", "end", "file_level").where(F.col(place[key]).isNotNull() & F.col(place["check"]).isNotNull())
    by = [place[key], place["check"]]
    f = f.join(known.where("file_level").select(*by).distinct(), by, "left_anti")
    spans = known.where(~F.coalesce("file_level", F.lit(False)) & (F.col("end") >= F.col("start"))).select(*by, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    # a range begins a new run if no earlier one reaches it
    earlier = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    runs = spans.withColumn("new", F.coalesce(F.max("end").over(earlier) < F.col("start") - 1, F.lit(True)).cast("long"))
    runs = runs.withColumn("run", F.sum("new").over(Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*by, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    block = lambda c: F.floor(c / LINE_BLOCK)
    cut = runs.select(*by, "start", "end", F.explode(F.sequence(block(F.col("start")), block(F.col("end")))).alias("block"))
    cut = cut.select(*by, "block", F.greatest("start", F.col("block") * LINE_BLOCK).alias("at"), F.col("end").alias("reach"))
    line = F.col(place["line"]).cast("long")
    # what no range can cover is spread over groups of its own
    placed = F.col(place[key]).isNotNull() & F.col(place["check"]).isNotNull() & line.isNotNull()
    alone = -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1024))
    both = f.withColumns({"block": F.when(placed, block(line)).otherwise(alone), "at": F.when(placed, line), "reach": F.lit(None).cast("long"), "found": F.lit(True)}).unionByName(cut.withColumn("found", F.lit(False)), allowMissingColumns=True)
    # at one line ranges come first
    reached = F.max("reach").over(Window.partitionBy(*by, "block").orderBy("at", "found").rowsBetween(Window.unboundedPreceding, 0))
    swept = both.withColumn("covered", F.coalesce(reached >= F.col("at"), F.lit(False)))
    return swept.where(F.col("found") & ~F.col("covered")).select(*names).toDF(*findings.columns)


#: Bytes of patterns in one automaton; more rules are resolved in blocks, which meet within the row.
RULE_BYTES = 1 << 18
_CHOICE = "array<struct<check:string,rule_idx:int,settings:string>>"
_RANKED = "array<struct<check:string,rule_idx:int,settings:string,specificity:int>>"


class _Chooser:
    """Of a block of options (rule_idx, pattern, check, settings) those that a path gets: for each check the most specific."""

    def __init__(self, options: list[tuple[int, str, str, str]]):
        self.patterns = sorted({o[1] for o in options})
        number = {p: k for k, p in enumerate(self.patterns)}
        self.set, self.rank = PatternSet(self.patterns), [specificity(p) for p in self.patterns]
        self.of: list[list[tuple[int, str, str]]] = [[] for _ in self.patterns]
        for rule, pattern, check, settings in options:
            self.of[number[pattern]].append((rule, check, settings))
        self.chosen: dict[tuple[int, ...], int] = {}
        self.results: list[list[dict]] = []

    def result(self, path: str | None) -> int:
        """The number of the result for a path. It follows from the patterns that fit, so there are few."""
        fits = () if path is None else self.set.matches(path)
        if fits not in self.chosen:
            best: dict[str, tuple] = {}
            for k in fits:
                for rule, check, settings in self.of[k]:
                    mine = (-self.rank[k], rule, settings)
                    best[check] = min(best.get(check, mine), mine)
            self.chosen[fits] = len(self.results)
            self.results.append([{"check": c, "rule_idx": r, "settings": s, "specificity": -rank} for c, (rank, r, s) in sorted(best.items())])
        return self.chosen[fits]


def _choosing(options: list[tuple[int, str, str, str]]):
    """A function of a path column for one block of options; a worker makes the automaton once."""
    kind = pa.list_(pa.struct([("check", pa.string()), ("rule_idx", pa.int32()), ("settings", pa.string()), ("specificity", pa.int32())]))
    key = ("rules", hashlib.sha256(repr(options).encode()).hexdigest())

    def run(paths: pa.Array) -> pa.Array:
        chooser = kept(key, lambda: _Chooser(options))
        at = [chooser.result(p) for p in paths.to_pylist()]
        return pa.array(chooser.results, kind).take(pa.array(at, pa.int64()))

    return F.arrow_udf(run, _RANKED)


def _blocks_of(options: list[tuple]) -> list[list[tuple]]:
    out, used = [], RULE_BYTES
    for o in options:
        size = len(o[1]) + len(o[2]) + len(o[3])
        if used + size > RULE_BYTES:
            out, used = [*out, []], 0
        out[-1].append(o)
        used += size
    return out


def _ranked(path: Column, options: list[tuple]) -> Column:
    """The results of all blocks together; of each check the most specific counts, of equal ones the earlier rule."""
    found = [_choosing(block)(path) for block in _blocks_of(options)]
    if not found:
        return F.array().cast(_CHOICE)
    bare = lambda all_: F.transform(all_, lambda x: F.struct(x["check"].alias("check"), x["rule_idx"].alias("rule_idx"), x["settings"].alias("settings")))
    if len(found) == 1:
        return bare(found[0])
    better = lambda x, y: (y["check"] == x["check"]) & ((y["specificity"] > x["specificity"]) | ((y["specificity"] == x["specificity"]) & (y["rule_idx"] < x["rule_idx"])))
    best = lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: better(x, y)))
    # an option may stand in several blocks by several patterns of one rule
    return let(F.concat(*found), lambda all_: F.array_distinct(bare(best(all_))))


def chosen_rules(path: Column, rules: list[dict]) -> Column:
    """[{check, rule_idx, settings}]: for each check type the rule with the most specific pattern that fits the path.

    `rules`: [{paths: [...], checks: {name: settings as text}}]; of equal ones the earlier wins, and invalid patterns fit
    nothing. A null path gets none.
    """
    return _ranked(path, [(i, p, check, str(settings)) for i, rule in enumerate(rules) for p in rule["paths"] for check, settings in rule["checks"].items()])


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """A configuration's rules as a table (rule_idx, pattern, check, settings), a row for each pattern and check."""
    rows = [(i, p, check, str(settings)) for i, rule in enumerate(rules) for p in rule["paths"] for check, settings in rule["checks"].items()]
    return spark.createDataFrame(rows, "rule_idx int, pattern string, check string, settings string")


def resolve_rules(paths: DataFrame, rules: list[dict] | DataFrame, path: str = "path") -> DataFrame:
    """(path, check, rule_idx, settings) of each row's path, one row for each check.

    `rules` is a list or a table as `rules_frame` makes it. A table comes to the driver row by row and goes to the workers
    in blocks of at most `RULE_BYTES`, each an automaton; rows of it with a null are left out. No exchange, and no
    comparison of each path with each rule.
    """
    if isinstance(rules, DataFrame):
        stated = rules.select(F.col("rule_idx").cast("int"), "pattern", "check", "settings").where("rule_idx IS NOT NULL AND pattern IS NOT NULL AND check IS NOT NULL AND settings IS NOT NULL")
        chosen = _ranked(F.col(path), [tuple(r) for r in stated.distinct().orderBy("pattern", "rule_idx", "check", "settings").toLocalIterator()])
    else:
        chosen = chosen_rules(F.col(path), rules)
    return unrolled(paths, [path], chosen)
