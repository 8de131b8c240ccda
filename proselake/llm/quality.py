"""Quality rules: a table of thresholds compiled into Spark column expressions, with no user functions.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. Defined results: null and empty texts have no words, so every
count is 0 and the base rule rejects them; repeated rows and null ids pass through as they are. Extra columns of the
input stay, but for those that bear a name of `quality`'s results, which give way; `passing` keeps columns of any name. Every
intermediate column has a reserved ``__q_`` name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.llm.shared import table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in that is was for on with by at from as it be are this an or which not have "
    "le la les de des et un une du en que qui pour par dans sur au il elle est "
    "der die das und nicht auf ist ein eine mit von zu sich den dem fur als "
    "el los las y con para no se su por lo como"
).split()

#: Minimum number of words, and the largest share of words in repeated three-word windows, in percent.
BASE_MIN_WORDS, BASE_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Rule:
    """Reject a document whose `measure` is below `low` or above `high`."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are per word, but for lines, which are per line with a word.
RULES = (
    Rule("word_length", "mean_word_chars", low=2.5, high=12.0),
    Rule("symbols", "symbol_ratio", high=0.2),
    Rule("shouting", "exclaim_ratio", high=0.4),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.4),
    Rule("bullets", "bullet_line_ratio", high=0.9),
    Rule("ellipses", "ellipsis_line_ratio", high=0.5),
)


def _count_chars(text: Column, chars: str) -> Column:
    """How often any of these characters occurs: the parts between them, less one."""
    return (F.size(F.split(text, "[" + re.escape(chars) + "]")) - 1).cast("long")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with the struct column ``__q_m``: all counts and ratios that the rules may use.

    Repeated windows are found per document by sorting the 64-bit hashes of its windows; words are compared where hashes
    of neighbours meet. So the work is n log n in its words and needs no shuffle, however long or repetitive the text is.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    w, n = F.col("__q_w"), F.size("__q_w")
    windows = F.transform(
        F.slice(w, 1, F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
    )
    s = F.col("__q_s")

    def equal(x: Column, y: Column) -> Column:
        words_meet = F.get(w, x["p"]) == F.get(w, y["p"])
        for k in (1, 2):
            words_meet = words_meet & (F.get(w, x["p"] + k) == F.get(w, y["p"] + k))
        return (x["h"] == y["h"]) & words_meet

    twice = F.array_compact(F.transform(s, lambda x, i: F.when(equal(x, F.get(s, i + 1)) | equal(x, F.get(s, i - 1)), x["p"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(p, p + 1, p + 2)))))
    n_words, n_lines = n.cast("long"), F.size("__q_l").cast("long")
    per_word = lambda c: F.when(n_words > 0, c / n_words).otherwise(0.0)
    per_line = lambda c: F.when(n_lines > 0, c / n_lines).otherwise(0.0)
    out = df.withColumns({"__q_w": words, "__q_l": lines}).withColumn("__q_s", F.sort_array(windows))
    line_share = lambda pattern: per_line(F.size(F.filter("__q_l", lambda x: x.rlike(pattern))))
    chars = F.length(F.array_join("__q_w", "")).cast("long")
    dups = (F.size("__q_l") - F.size(F.array_distinct("__q_l"))).cast("long")
    return out.withColumn(
        "__q_m",
        F.struct(
            n_words.alias("n_words"),
            chars.alias("word_chars"),
            _count_chars(t, SYMBOLS).alias("n_symbols"),
            dups.alias("n_dup_lines"),
            covered.cast("long").alias("n_repeat_words"),
            per_word(chars).alias("mean_word_chars"),
            per_word(_count_chars(t, SYMBOLS)).alias("symbol_ratio"),
            per_word(_count_chars(t, "!")).alias("exclaim_ratio"),
            per_word(F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS, *(a.capitalize() for a in STOP_WORDS))))).alias("stop_ratio"),
            per_line(dups).alias("dup_line_ratio"),
            line_share(r"^[\x20\x09-\x0D]*[-*•]").alias("bullet_line_ratio"),
            line_share(r"(\.\.\.|…)[\x20\x09-\x0D]*$").alias("ellipsis_line_ratio"),
        ),
    ).drop("__q_w", "__q_l", "__q_s")


def failures(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a measured document breaks, compiled from the table."""
    broken = []
    for r in rules:
        x = F.col("__q_g")[r.measure]
        tests = [x < r.low] * (r.low is not None) + [x > r.high] * (r.high is not None)
        broken += [F.when(c, F.lit(r.name)) for c in tests]
    return F.array_compact(F.array(*broken))


def quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`df` with the base counts, ``base_failed``, ``failed_rules`` and ``kept``. Narrow: one pass, no exchange."""
    g = F.col("__q_g")
    base = (g["n_words"] < BASE_MIN_WORDS) | (100 * g["n_repeat_words"] > BASE_REPEAT_PERCENT * g["n_words"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kept = [c for c in df.columns if c not in {*names, "base_failed", "failed_rules", "kept"}]
    # a filter on the verdict stays above this generator of one row, so the counts are computed once
    m = measured(df, text).select(*kept, F.explode(F.array("__q_m")).alias("__q_g"))
    return m.select(
        *kept, *(g[n].alias(n) for n in names), base.alias("base_failed"), failures(rules).alias("failed_rules")
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def passing(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `df` that no rule rejects, with all their columns, whatever these are called."""
    names = [f"c_{i}" for i in range(len(df.columns))]
    return quality(df.toDF(*names), names[df.columns.index(text)], rules).where("kept").select(*names).toDF(*df.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql_list(words) -> str:
    return ", ".join(f"'{x}'" for x in words)


#: The counts and verdict as DuckDB relations ending in ``judged(row_id, doc_id, ..., kept)`` over a relation `docs`.
JUDGED_SQL = f"""
q_docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM {{docs}}),
q_words AS (SELECT row_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM q_docs),
q_pos AS (SELECT row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM q_words)),
q_twice AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS c FROM q_pos) WHERE c > 1),
q_covered AS (SELECT row_id, count(DISTINCT p) AS c FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS p FROM q_twice) GROUP BY row_id),
q_base AS (SELECT d.row_id, d.doc_id, len(w) AS n_words,
  length(regexp_replace(d.t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(d.t) - length(translate(d.t, '{SYMBOLS}', '')) AS n_symbols,
  length(d.t) - length(replace(d.t, '!', '')) AS n_exclaim,
  len(list_filter(w, lambda x: x IN ({_sql_list([*STOP_WORDS, *(a.capitalize() for a in STOP_WORDS)])}))) AS n_stop,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*\\x{{{{2022}}}}]'))) AS n_bullets,
  len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|\\x{{{{2026}}}})[\\x20\\x09-\\x0D]*$'))) AS n_ellipses,
  coalesce(c.c, 0) AS n_repeat_words
  FROM q_docs d JOIN q_words USING (row_id) LEFT JOIN q_covered c USING (row_id)),
judged AS (SELECT row_id, doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words
    OR word_chars / n_words < 2.5::DOUBLE OR word_chars / n_words > 12.0::DOUBLE OR n_symbols / n_words > 0.2::DOUBLE
    OR n_exclaim / n_words > 0.4::DOUBLE OR n_stop / n_words < 0.02::DOUBLE OR n_dup_lines / n_lines > 0.4::DOUBLE
    OR n_bullets / n_lines > 0.9::DOUBLE OR n_ellipses / n_lines > 0.5::DOUBLE) AS kept
  FROM q_base)"""

OP7_SQL = f"""WITH {JUDGED_SQL.format(docs="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""
