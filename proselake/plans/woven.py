"""Markdown woven from the lines of real texts, and SQL for what is left of it, in words that Spark and DuckDB both read.

Each line that is not blank, without the marks of Markdown, stands in one of nine kinds of blocks in turn. What a reader of
Markdown makes of it follows from the kind, so SQL can judge it on whole texts.
"""

from __future__ import annotations

#: Marks that leave the lines, so that only those woven in count.
_MARKS = "\t\r*_`[]<>&\\~|#+-=!"

#: By kind: the block of a line `l` with number `i`, its prose, and its heading (of level 2) if it is one.
_KINDS = (
    ("'p ' || l || '\n\n'", "'p ' || l || ' '"),
    ("'> q ' || l || '\nlazy\n\n'", "'q ' || l || ' lazy '"),
    ("'- a ' || l || '\n- **b**\n  - c\n\n'", "'a ' || l || 'bc'"),
    ("'## ' || l || ' ##\n\n'", "''"),
    ("'~~~ x\n' || l || '\n# no\n~~~\n\n'", "''"),
    ("'*e ' || l || ' z* [link ' || i || '](http://x.example \"t\") `code`\n\n'", "'e ' || l || ' z link ' || i || '  '"),
    ("'| h ' || l || ' | k |\n|---|:-:|\n| ' || l || ' | v |\n\n'", "'h ' || l || 'k' || l || 'v'"),
    ("'> 1. n ' || l || '\n>    on\nstill\n>\n> 2. _m_\n\n'", "'n ' || l || ' on still m '"),
    ("'s ' || l || '\n---\n\n'", "''"),
)
HEADED = {3: "l", 8: "'s ' || l"}
TABLE = 6


def _case(part: int) -> str:
    return "CASE i % 9 " + " ".join(f"WHEN {k} THEN {kind[part]}" for k, kind in enumerate(_KINDS)) + " END"


#: The text of a document as Markdown, for Spark.
_quoted = _MARKS.replace("\\", "\\\\").replace("\t", "\\t").replace("\r", "\\r")
MARKDOWN = f"array_join(transform(filter(transform(split(translate(text, '{_quoted}', ''), '\\n'), x -> trim(x)), x -> x <> ''), (l, i) -> {_case(0)}), '')"

#: For DuckDB: relations ending in woven(doc_id, i, l, piece, prose), a row for each line; `docs` is a relation.
WOVEN_SQL = f"""lines AS (SELECT doc_id, list_filter(list_transform(string_split(translate(text, '{_MARKS}', ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS i FROM lines),
woven AS (SELECT doc_id, i, l, {_case(0)} AS piece, {_case(1)} AS prose FROM line)"""

HEADINGS_SQL = f"WITH {WOVEN_SQL} SELECT doc_id, CAST(2 AS INT) AS level, CASE i % 9 {' '.join(f'WHEN {k} THEN {h}' for k, h in HEADED.items())} END AS text FROM woven WHERE i % 9 IN ({', '.join(map(str, HEADED))})"
PROSE_SQL = f"WITH {WOVEN_SQL} SELECT d.doc_id, coalesce(string_agg(prose, '' ORDER BY i), '') AS prose FROM documents d LEFT JOIN woven USING (doc_id) GROUP BY d.doc_id"
TABLES_SQL = (
    f"WITH {WOVEN_SQL}, placed AS (SELECT doc_id, i, strlen(piece) AS n, sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM woven) "
    f'SELECT doc_id, CAST(upto - n AS BIGINT) AS start, CAST(upto - 2 AS BIGINT) AS "end" FROM placed WHERE i % 9 = {TABLE}'
)
