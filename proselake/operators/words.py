"""Word and phrase analyses. Each verb gives one struct column, or long findings by exploding one.

All are narrow: functions over the words of a row, no exchange; so rows with one key stay documents of their own. What sorts or
counts words is a small Arrow function, as sorted arrays of strings cost a plan several times as much.
`w` is a column of words where a plan has it already. Ties are broken by term, so results are a definite refinement of an
order that is otherwise arbitrary. Null and empty texts give zeros and empty lists.
"""

from __future__ import annotations

from collections import Counter
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselake.functions import lexicons as lex
from proselake.functions.phrases import phrase_counts, phrase_hits
from proselake.functions.text import batches, counts_type, let, listed_counts, paragraphs, percent, pieces, round1, text_of, unrolled, word_text, words

TOP = 50
#: Characters of phrases in one automaton.
PHRASE_BYTES = 1 << 20


def _in(w: Column, terms) -> Column:
    return w.isin(*terms)


def counted(terms: Column, name: str) -> Column:
    """[{name, count}] of an array, most frequent first, then by term."""
    return _ranked(let(F.sort_array(terms), lambda s: _runs(s, name)), name)


def _starts(s: Column) -> Column:
    """Where runs of equal terms start in a sorted array."""
    return F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)))


def _runs(s: Column, name: str) -> Column:
    # the length of a run is the distance to the next start
    return let(_starts(s), lambda at: F.transform(at, lambda p, i: F.struct(F.get(s, p).alias(name), (F.coalesce(F.get(at, i + 1), F.size(s)) - p).cast("long").alias("count"))))


#: The phrases of all lists, which one pass over a text counts, and where each list begins among them.
PHRASES = (*lex.CLICHES, *lex.VAGUE_PHRASES, *lex.JARGON_PHRASES)
_CLICHES, _VAGUE, _JARGON = (0, len(lex.CLICHES)), (len(lex.CLICHES), len(lex.VAGUE_PHRASES)), (len(lex.CLICHES) + len(lex.VAGUE_PHRASES), len(lex.JARGON_PHRASES))


def phrase_column(text="text") -> Column:
    """The counts of all `PHRASES` in the text in lower case; plans that need several of the lists share one such column."""
    return phrase_counts(PHRASES)(F.lower(text_of(text)))


def _phrases(text, counts: Column | None, where: tuple[int, int], name: str) -> Column:
    first, n = where
    listed = F.slice(phrase_column(text) if counts is None else counts, first + 1, n)
    each = F.zip_with(F.array(*map(F.lit, PHRASES[first : first + n])), listed, lambda p, c: F.struct(p.alias(name), c.alias("count")))
    return F.filter(each, lambda x: x["count"] > 0)


def phrases(docs: DataFrame, listed: list[str] | DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, phrase, count) of the caller's phrases that occur in each row's text, as they are written; no exchange.

    A phrase counts without word boundaries and without overlaps of its own, whatever other phrases overlap it. A list in a table
    (column ``phrase``) comes to the driver row by row; automata hold `PHRASE_BYTES` of phrases at most, so a long list takes
    several passes over the texts. A worker keeps 16 automata; a list that needs more should be given in parts. Repeated, empty and null phrases count once or not at all; a null text has none.
    """
    if isinstance(listed, DataFrame):
        stated = (r[0] for r in listed.select("phrase").where("phrase <> ''").distinct().orderBy("phrase").toLocalIterator())
    else:
        stated = iter(sorted({p for p in listed if p}))
    found, block, used = [], [], 0
    for p in stated:
        if block and used + len(p) > PHRASE_BYTES:
            found, block, used = [*found, phrase_hits(block)(F.col(text))], [], 0
        block.append(p)
        used += len(p)
    found.append(phrase_hits(block)(F.col(text)))
    return unrolled(docs, [key], F.concat(*found))


def _ranked(items: Column, name: str) -> Column:
    """The items by falling count, then by name: sorted by natural order of (-count, name)."""
    keyed = F.sort_array(F.transform(items, lambda x: F.struct((-x["count"]).alias("c"), x[name].alias("t"))))
    return F.transform(keyed, lambda x: F.struct(x["t"].alias(name), (-x["c"]).alias("count")))


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x["count"])


def _words(text, w: Column | None) -> Column:
    return words(text) if w is None else w


@F.arrow_udf(counts_type("word"))
def ranked_words(texts: pa.Array) -> pa.Array:
    """The distinct words of a `word_text` with their counts, most frequent first, then by word."""
    return listed_counts([sorted(Counter(pieces(t.as_py() or "")).items(), key=lambda x: (-x[1], x[0])) for t in texts], "word")


def _as_text(text, w: Column | None) -> Column:
    """Words as one text, which goes to Python at a fraction of an array's cost."""
    return word_text(text) if w is None else F.array_join(w, " ")


def overused_report(text="text", threshold: float = 0.5, w: Column | None = None) -> Column:
    """Words over three bytes, no glue, above `threshold` percent of the words; and the distinct words of all kinds."""
    def report(n: Column, ranked: Column) -> Column:
        often = F.filter(ranked, lambda x: (100.0 * x["count"] / n > threshold) & (F.octet_length(x["word"]) > 3) & ~_in(x["word"], lex.GLUE))
        rows = F.transform(often, lambda x: F.struct(x["word"], x["count"], round1(100.0 * x["count"] / n).alias("frequency")))
        return F.struct(rows.alias("overused_words"), F.size(ranked).cast("long").alias("total_unique_words"))

    return let(ranked_words(_as_text(text, w)), lambda ranked: let(_total(ranked), lambda n: report(n, ranked)))


def repeated_runs(w: list[str]) -> list[tuple[str, int]]:
    """The `TOP` most frequent runs of 2 to 4 words that occur twice or more, then by phrase."""
    pairs = list(zip(w, w[1:], strict=False))
    counts = Counter(pairs)
    again = [counts[p] > 1 for p in pairs]
    found = [(-n, " ".join(p)) for p, n in counts.items() if n > 1]
    for k in (3, 4):
        # a run occurs twice only where all of its pairs do
        runs = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1) if again[i] and all(again[i + 1 : i + k - 1]))
        found += [(-n, " ".join(p)) for p, n in runs.items() if n > 1]
    return [(p, -n) for n, p in nsmallest(TOP, found)]


@F.arrow_udf(counts_type("phrase"))
def _repeated(texts: pa.Array) -> pa.Array:
    return listed_counts([repeated_runs(pieces(t.as_py() or "")) for t in texts], "phrase")


def repeated_report(text="text", w: Column | None = None) -> Column:
    """The 50 most frequent repeated runs of 2 to 4 words; their number is that of the listed ones."""
    return let(_repeated(_as_text(text, w)), lambda items: F.struct(F.size(items).cast("long").alias("total_repeated"), items.alias("phrases")))


def echoed(paras: list[str], near: int) -> list[tuple[str, int, int, int]]:
    """(word, paragraph, distance, occurrences) of the `TOP` nearest repetitions; each of `paras` is a `word_text`."""
    found = []
    for k, p in enumerate(paras):
        last: dict[str, int] = {}
        counts: Counter = Counter()
        own = []
        for i, x in enumerate(pieces(p)):
            if len(x.encode()) >= 4 and x not in _GLUE:
                counts[x] += 1
                if x in last and i - last[x] < near:
                    own.append((i - last[x], k + 1, x, i))
                last[x] = i
        found += [(*e, counts[e[2]]) for e in own]
    return [(x, k, distance, n) for distance, k, x, _, n in nsmallest(TOP, found)]


_GLUE = frozenset(lex.GLUE)
_ECHO = pa.struct([("word", pa.string()), ("paragraph", pa.int32()), ("distance", pa.int32()), ("occurrences", pa.int64())])


def echo_rows(near: int):
    """A function of an array of paragraphs, each a `word_text`."""
    def run(lists: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("word", "paragraph", "distance", "occurrences"), e, strict=True)) for e in echoed(paras.as_py() or (), near)] for paras in lists], pa.list_(_ECHO))

    return F.arrow_udf(run, "array<struct<word:string,paragraph:int,distance:int,occurrences:bigint>>")


def echoes_report(text="text", near: int = 20) -> Column:
    """The 50 nearest repetitions of a word within a paragraph, by distance, paragraph, word and place."""
    found = echo_rows(near)(F.transform(paragraphs(text), word_text))
    return let(found, lambda items: F.struct(F.size(items).cast("long").alias("total_echoes"), items.alias("echoes")))


def _long(docs: DataFrame, key: str, report: Column, field: str) -> DataFrame:
    batches(docs.sparkSession)
    return unrolled(docs, [key], report[field])


def overused(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, word, count, frequency) of each row's overused words."""
    return _long(docs, key, overused_report(text, threshold), "overused_words")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, phrase, count) of each row's repeated phrases."""
    return _long(docs, key, repeated_report(text), "phrases")


def echoes(docs: DataFrame, key: str = "doc_id", text: str = "text", near: int = 20) -> DataFrame:
    """(key, word, paragraph, distance, occurrences) of each row's echoes."""
    return _long(docs, key, echoes_report(text, near), "echoes")


def sensory(text="text", w: Column | None = None) -> Column:
    return let(_words(text, w), _sensory)


def _sensory(w: Column) -> Column:
    sense = lambda x: F.coalesce(*(F.when(_in(x, v), F.lit(k)) for k, v in lex.SENSES.items()))
    return let(F.array_compact(F.transform(w, sense)), lambda found: _senses(found, w))


def _senses(found: Column, w: Column) -> Column:
    n = F.size(found).cast("long")
    by = F.transform(counted(found, "sense"), lambda x: F.struct(x["sense"], F.struct(x["count"].alias("count"), percent(x["count"], n).alias("percentage"))))
    return F.struct(n.alias("sensory_count"), percent(n, F.size(w)).alias("sensory_percentage"), F.map_from_entries(by).alias("by_sense"))


def _listed(text, singles, where: tuple[int, int], name: str, w: Column | None, counts: Column | None) -> Column:
    found = counted(F.filter(_words(text, w), lambda x: _in(x, singles)), name)
    return _ranked(F.concat(found, _phrases(text, counts, where, name)), name)


def diction(text="text", w: Column | None = None, counts: Column | None = None) -> Column:
    """`counts` is a `phrase_column` where a plan has it already, here and below."""
    found = _listed(text, lex.VAGUE_WORDS, _VAGUE, "word", w, counts)
    return let(found, lambda items: F.struct(_total(items).alias("total_vague"), F.size(items).cast("long").alias("unique_vague"), items.alias("most_common")))


def jargon(text="text", w: Column | None = None, counts: Column | None = None) -> Column:
    found = _listed(text, lex.JARGON_WORDS, _JARGON, "jargon", w, counts)
    return let(found, lambda items: F.struct(_total(items).alias("total_jargon"), F.size(items).cast("long").alias("unique_jargon"), items.alias("jargon_list")))


def cliches(text: str = "text", counts: Column | None = None) -> Column:
    found = _ranked(_phrases(text, counts, _CLICHES, "cliche"), "cliche")
    return let(found, lambda items: F.struct(_total(items).alias("total_cliches"), items.alias("cliches")))


def acronyms(text: str = "text") -> Column:
    found = counted(F.regexp_extract_all(text_of(text), F.lit(r"(?U)\b[A-Z]{2,}\b"), F.lit(0)), "acronym")
    return let(found, lambda items: F.struct(_total(items).alias("total_acronyms"), F.size(items).cast("long").alias("unique_acronyms"), items.alias("acronym_list")))


def prefers_us(dialect: str, pattern: str) -> bool:
    return dialect == "en-us" or (dialect == "en-ca" and pattern in ("IzeIse", "AmAmme"))


#: What is looked for in a text: the spellings, then both sides of each hyphenation.
_SPELLED = (*(x for us, uk, _ in lex.SPELLINGS for x in (us, uk)), *(x for pair in lex.HYPHENS for x in pair))


def consistency(text="text", dialect: str | None = None) -> Column:
    """Mixed or wrong spellings, then mixed hyphenation, in the order of the lists."""
    # one pass finds what a text holds at all; few hold any of it, and only those are searched for the edges of words
    lower = F.lower(text_of(text))
    return let(F.struct(lower.alias("t"), phrase_hits(_SPELLED)(lower)["phrase"].alias("held")), lambda x: _consistency(x["t"], x["held"], dialect))


def _consistency(lower: Column, held: Column, dialect: str | None) -> Column:
    holds = lambda w: F.array_contains(held, w)
    has = lambda w: holds(w) & lower.rlike(f"(?<![a-zA-Z]){w}(?![a-zA-Z])")
    issues = []
    for us, uk, pattern in lex.SPELLINGS:
        if dialect:
            bad, good = (uk, us) if prefers_us(dialect, pattern) else (us, uk)
            issues.append(F.when(has(bad), F.lit(lex.SPELLING_MESSAGES["wrong"].format(bad=bad, good=good, dialect=dialect))))
        issues.append(F.when(holds(us) & holds(uk) & has(us) & has(uk), F.lit(lex.SPELLING_MESSAGES["mixed"].format(us=us, uk=uk))))
    for a, b in lex.HYPHENS:
        issues.append(F.when(holds(a) & holds(b), F.lit(lex.SPELLING_MESSAGES["hyphens"].format(a=a, b=b))))
    none = F.array().cast("array<string>")
    return F.when(F.size(held) == 0, _inconsistent(none, dialect)).otherwise(_inconsistent(F.array_compact(F.array(*issues)), dialect))


def _inconsistent(issues: Column, dialect: str | None) -> Column:
    return let(issues, lambda found: F.struct(F.lit(dialect).cast("string").alias("dialect"), F.size(found).cast("long").alias("total_issues"), found.alias("issues")))


def style(text="text", passives: Column | None = None, w: Column | None = None, counts: Column | None = None) -> Column:
    """Adverbs, hidden verbs and the composite score from 0 to 100."""
    vague = F.slice(phrase_column(text) if counts is None else counts, _VAGUE[0] + 1, _VAGUE[1])
    # what Python counts stays outside of the functions over arrays
    return let(F.struct(_words(text, w).alias("w"), F.aggregate(vague, F.lit(0).cast("long"), lambda a, x: a + x).alias("v")), lambda s: _style(text, passives, s["w"], s["v"]))


def _style(text, passives: Column | None, w: Column, vague_phrases: Column) -> Column:
    adverbs = F.size(F.regexp_extract_all(text_of(text), F.lit(r"(?U)\b\w+ly\b"), F.lit(0))).cast("long")
    hidden = counted(F.filter(w, lambda x: _in(x, lex.HIDDEN_VERBS)), "noun")
    verb = F.create_map(*(F.lit(x) for kv in lex.HIDDEN_VERBS.items() for x in kv))
    hidden = F.sort_array(F.transform(hidden, lambda x: F.struct(x["noun"].alias("noun"), F.element_at(verb, x["noun"]).alias("verb"), x["count"].alias("count"))))
    glue, vague = glue_index(text, w), F.size(F.filter(w, lambda x: _in(x, lex.VAGUE_WORDS))) + vague_phrases
    passives = F.lit(0) if passives is None else passives
    least = lambda x, top: F.least(x, F.lit(float(top)))
    score = 100.0 - least(passives * 2.0, 20) - least(adverbs * 0.5, 15) - least(F.size(hidden) * 2.0, 10) - F.when(glue > 25, least(glue - 25, 15)).otherwise(0.0) - least(vague * 0.5, 10)
    return F.struct(adverbs.alias("adverb_count"), hidden.alias("hidden_verbs"), F.greatest(score, F.lit(0.0)).cast("int").alias("style_score"))


def glue_index(text="text", w: Column | None = None) -> Column:
    return let(_words(text, w), lambda w: percent(F.size(F.filter(w, lambda x: _in(x, lex.GLUE))), F.size(w)))
