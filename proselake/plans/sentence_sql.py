"""SQL of the sentence rule and of what stands on it, written on its own so that it can judge the Spark plans.

A text is cut after each terminator. Most cuts are decided by what stands around them; whether a decimal number or an
address belongs to the current sentence depends on where that begins, so those cuts are decided one after the other: `room`
lists the lengths up to 50 at which the end of the current sentence holds one.
"""

from __future__ import annotations

from proselake.functions import lexicons as lex

W = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
A = r"\p{L}\p{N}"
#: A mail address begins and ends at an edge of a word, of which accented letters are a part: before its first character, or
#: within the run before the sign, where a sign meets a letter. The pattern states these edges by the characters beside them.
_ADDRESS = rf"(https?://|www\.)[^{W}]|((^|[^{A}_])[A-Za-z0-9_]|[{A}_][.%+-])[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}($|[^{A}_])"


def q(terms) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in terms)


def words(text: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({text}, '[{W}]+'), lambda w: lower(regexp_replace(w, '^[^{A}''-]+|[^{A}''-]+$', '', 'g'))), lambda w: w <> '')"


def tokens(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '[{W}]+'), lambda w: w <> '')"


def bare(text: str) -> str:
    """Lower-cased tokens without all that is no letter at their edges; those without letters are gone."""
    return rf"list_filter(list_transform(string_split_regex({text}, '[{W}]+'), lambda w: lower(regexp_replace(w, '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g'))), lambda w: w <> '')"


def syllables(w: str) -> str:
    """The estimate for one word."""
    groups = f"len(regexp_extract_all({w}, '[aeiouy]+'))"
    n = f"({groups} - CASE WHEN {w} LIKE '%e' AND {groups} > 1 AND NOT regexp_matches({w}, '[ldtn]e$') THEN 1 ELSE 0 END + CASE WHEN regexp_matches({w}, '[^aeiouy]le$') THEN 1 ELSE 0 END)"
    return f"CASE WHEN {w} = '' THEN 0 ELSE greatest({n} - CASE WHEN {w} LIKE '%ed' AND {n} > 1 AND NOT regexp_matches({w}, '[td]ed$') THEN 1 ELSE 0 END, 1) END"


def sentences(docs: str, name: str = "s") -> str:
    """Relations ending in `name` (doc_id, num, text, line) over a relation or subquery of (doc_id, text)."""
    p = name + "_"
    return rf"""
{p}d AS (SELECT doc_id, text, length(text) AS n FROM {docs}),
{p}raw AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$') AS l FROM {p}d),
{p}cut AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS k FROM {p}raw),
{p}at AS (SELECT doc_id, right(piece, 1) AS t, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS p FROM {p}cut),
{p}near AS (SELECT a.doc_id, a.t, a.p, d.n, substr(d.text, greatest(a.p - 200, 1), least(200, a.p - 1)) AS pre, substr(d.text, a.p + 1, 300) AS post,
  right(substr(d.text, greatest(a.p - 49, 1), least(50, a.p)), 50) AS tail FROM {p}at a JOIN {p}d d USING (doc_id) WHERE a.t IN ('.', '!', '?')),
{p}seen AS (SELECT *, regexp_replace(regexp_extract(pre, '([{A}.]*)[.{W}]*$', 1), '[.{W}]+$', '') AS w, regexp_extract(post, '^[{W}]*([^{W}])', 1) AS x, regexp_extract(post, '(?s)^[{W}]*[^{W}](.)', 1) AS y FROM {p}near),
{p}told AS (SELECT doc_id, p, CASE WHEN p = n THEN true
    WHEN t <> '.' THEN x NOT IN ('"', '''') OR regexp_matches(y, '^\p{{Lu}}$')
    ELSE NOT (lower(w) IN ({q(lex.ABBREVIATIONS)}) OR regexp_matches(w, '^[A-Z]$') OR regexp_matches(w, '(^|\.)[A-Z]\.') OR (regexp_matches(x, '^[0-9]$') AND regexp_matches(w, '[0-9]$')) OR regexp_matches(x, '^\p{{Ll}}$')) END AS yes,
  CASE WHEN p < n AND t = '.' AND (regexp_matches(right(tail, 10), '[0-9]+\.[0-9]+') OR right(tail, 3) = '...' OR regexp_matches(tail, '@|https?://|www\.')) THEN
    nullif(list_filter(range(1, 51), lambda k: regexp_matches(right(tail, least(k, 10)), '[0-9]+\.[0-9]+') OR (k >= 3 AND right(tail, 3) = '...') OR regexp_matches(right(tail, k), '{_ADDRESS}')), []) END AS room FROM {p}seen),
{p}open AS (SELECT *, coalesce(max(CASE WHEN yes AND room IS NULL THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last_sure FROM {p}told),
{p}unsure AS (SELECT doc_id, p, room, last_sure, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS j FROM {p}open WHERE yes AND room IS NOT NULL),
{p}walk AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS last FROM {p}unsure
  UNION ALL SELECT u.doc_id, u.j, CASE WHEN list_contains(u.room, least(50, u.p - greatest(u.last_sure, v.last))) THEN v.last ELSE u.p END FROM {p}walk v JOIN {p}unsure u ON u.doc_id = v.doc_id AND u.j = v.j + 1),
{p}ends AS (SELECT doc_id, p FROM {p}open WHERE yes AND room IS NULL UNION SELECT doc_id, last FROM {p}walk WHERE last > 0 UNION SELECT doc_id, n FROM {p}d WHERE n > 0),
{p}span AS (SELECT doc_id, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), 0) + 1 AS a, p AS b FROM {p}ends),
{p}text AS (SELECT doc_id, a, substr(d.text, a, b - a + 1) AS raw, d.text AS whole FROM {p}span JOIN {p}d d USING (doc_id)),
{p}bare AS (SELECT doc_id, a, regexp_replace(raw, '^[{W}]+|[{W}]+$', '', 'g') AS text, left(whole, a - 1) || regexp_extract(raw, '^[{W}]*') AS before FROM {p}text),
{name} AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) AS INT) AS num, text, CAST(1 + length(before) - length(replace(before, chr(10), '')) AS INT) AS line FROM {p}bare WHERE strlen(text) >= 3)"""


def graded(counts: str, name: str = "g") -> str:
    """Relations ending in `name` (all of `counts` with grade) over a relation with words n, sentences m and syllables y.

    0.39 * (n / m) + 11.8 * (y / n) is taken with its product exact: as a whole number over a power of two, rounded once to 53
    bits, halves to even.
    """
    return f"""
{name}_1 AS (SELECT *, n / m AS a, 11.8::DOUBLE * (y / n) AS c FROM {counts}),
{name}_2 AS (SELECT *, 53 - CAST(floor(log2(a)) AS INT) AS k FROM {name}_1),
{name}_3 AS (SELECT *, CAST(0.39::DOUBLE * pow(2.0, 54) AS HUGEINT) * CAST(a * pow(2.0, k) AS HUGEINT) + CAST(c * pow(2.0, 54 + k) AS HUGEINT) AS v FROM {name}_2),
{name}_4 AS (SELECT *, CAST(floor(log2(v::DOUBLE)) AS INT) - 52 AS t FROM {name}_3),
{name}_5 AS (SELECT *, CASE WHEN (v >> (t + 52)) = 0 THEN t - 1 ELSE t END AS s FROM {name}_4),
{name}_6 AS (SELECT *, v >> s AS q, v - ((v >> s) << s) AS rest, 1::HUGEINT << (s - 1) AS half FROM {name}_5),
{name} AS (SELECT * EXCLUDE (a, c, k, v, t, s, q, rest, half), (q + CASE WHEN rest > half OR (rest = half AND q % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE * pow(2.0, s - 54 - k) - 15.59::DOUBLE AS grade FROM {name}_6)"""


def percent(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round({part} / {whole} * 100 * 10) / 10 ELSE 0.0 END"


def passives(sents: str) -> str:
    """Relation `pv` over a relation of sentences."""
    big = q(("was", "were", "been", "being", "is", "are"))
    return rf"""
pv_w AS (SELECT doc_id, num, {words('text')} AS w FROM {sents}),
pv_i AS (SELECT doc_id, num, w, unnest(range(1, len(w))) AS i FROM pv_w WHERE len(w) > 1),
pv_p AS (SELECT doc_id, num, i, w[i] AS auxiliary, w[i + 1] AS participle, CASE WHEN i > 1 THEN w[i - 1] END AS prior, regexp_matches(array_to_string(w[i + 1 : i + 5], ' '), '{lex.BY_PHRASE}') AS has_by_phrase FROM pv_i WHERE w[i] IN ({q(lex.AUXILIARIES)})),
pv AS (SELECT doc_id, num AS sentence_num, i, auxiliary || ' ' || participle AS text, auxiliary, participle, has_by_phrase,
  least(0.5::DOUBLE + CASE WHEN auxiliary IN ({big}) THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN participle IN ({q(lex.IRREGULAR_PARTICIPLES)}) THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN has_by_phrase THEN 0.3::DOUBLE ELSE 0 END
    + CASE WHEN prior IN ({q(('the', 'a', 'an', 'this', 'that', 'these', 'those', 'it'))}) THEN 0.1::DOUBLE ELSE 0 END, 1.0::DOUBLE) AS confidence
  FROM pv_p WHERE participle NOT IN ({q(lex.ADJECTIVES)}) AND (participle IN ({q(lex.IRREGULAR_PARTICIPLES)}) OR regexp_matches(participle, '[{A}_]+ed([^{A}\p{{M}}_]|$)')) AND confidence >= 0.6::DOUBLE)"""


def issues(sents: str) -> str:
    """Relation `gi` (doc_id, sentence_num, ord, issue_type, message, severity)."""
    wide = lambda p: p.replace(r"\s", f"[{W}]").replace(r"\w", f"[{A}\\p{{M}}_]").replace(r"\b", "")
    edge = lambda p: f"(^|[^{A}\\p{{M}}_]){wide(p)}($|[^{A}\\p{{M}}_])"
    sql = lambda s: s.replace("'", "''")
    tests = [("DoubleSpace", "Low", "contains(text, '  ')", None), ("MissingPunctuation", "Medium", "right(text, 1) NOT IN ('.', '!', '?')", None)]
    tests += [("SubjectVerbAgreement", "High", f"regexp_matches(low, '{sql(edge(p))}')", m) for p, m in lex.SUBJECT_VERB]
    tests += [("DoubleNegative", "High", f"regexp_matches(low, '{sql(edge(lex.DOUBLE_NEGATIVE))}')", None), ("RunOnSentence", "Medium", f"regexp_matches(low, '{sql(wide(lex.RUN_ON))}')", None)]
    clause = f"len({tokens('c')}) >= 3 AND list_has_any({tokens('c')}, [{q(lex.SUBJECTS)}]) AND list_has_any({tokens('c')}, [{q(lex.COMMON_VERBS)}])"
    tests += [("CommaSplice", "Medium", f"len(list_filter(string_split(low, ','), lambda c: {clause})) >= 2", None)]
    each = " UNION ALL ".join(f"SELECT doc_id, num AS sentence_num, {i} AS ord, '{kind}' AS issue_type, '{sql(m or lex.ISSUES[kind])}' AS message, '{severity}' AS severity FROM gi_l WHERE {test}" for i, (kind, severity, test, m) in enumerate(tests))
    return f"\ngi_l AS (SELECT doc_id, num, text, lower(text) AS low FROM {sents}),\ngi AS ({each})"
