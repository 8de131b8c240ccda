"""Benchmark decontamination: one Aho-Corasick automaton over windows of test items, one scan of each text.

Both sides are normalised alike, byte for byte: A-Z to lower case, each run of separators to one blank. A match in the
normalised text ends at a word whose index, and so whose place in the original text, follows from the blanks before it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.llm.shared import batches, held, table

WINDOW = 10
#: Bytes of window text in one automaton. A larger set of items is scanned in blocks, each a stage of the same job.
BLOCK_BYTES = 16 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The normalised words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def windows(text: str | None, size: int = WINDOW) -> set[bytes]:
    """All runs of `size` words, or the whole item if it is shorter; none for an item without words."""
    w = words(text)
    return {b" %b " % b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def item_blocks(items: Iterable[tuple[object, str]], size: int = WINDOW, bound: int = BLOCK_BYTES) -> Iterator[dict[bytes, list]]:
    """Windows with the items that hold them, in blocks of bounded size, made one at a time; one block at least."""
    block: dict[bytes, list] = {}
    used = 0
    for item, text in items:
        for w in windows(text, size):
            if used > bound:
                yield block
                block, used = {}, 0
            used += len(w)
            block.setdefault(w, []).append(item)
    yield block


class _Automaton:
    def __init__(self, block: dict[bytes, list]):
        import ahocorasick

        self.a = ahocorasick.Automaton()
        for w, items in block.items():
            self.a.add_word(w.decode("latin-1"), (len(w), w.count(b" ") - 1, items))
        self.any = bool(block)
        if self.any:
            self.a.make_automaton()

    def scan(self, text: bytes) -> list[tuple[int, int, list]]:
        """(first word, one past the last word, items) of each occurrence in normalised text with outer blanks."""
        found = list(self.a.iter(text.decode("latin-1"))) if self.any else []
        if not found:
            return []
        blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        last = np.searchsorted(blanks, [end for end, _ in found])
        return [(int(k) - n, int(k), items) for k, (_, (_, n, items)) in zip(last, found, strict=True)]


def _automaton(token: str, block) -> _Automaton:
    """One automaton per broadcast block, kept by a worker from task to task."""
    return held(("automaton", token), lambda: _Automaton(block.value), room=2)


def _scanner(block, token: str, first: bool):
    def run(it):
        auto = _automaton(token, block)
        for batch in it:
            hits, seen, n_words = [], [], []
            old = None if first else (batch.column("__d_hits").to_pylist(), batch.column("__d_items").to_pylist())
            for i, t in enumerate(batch.column("__d_text")):
                w = words(t.as_py())
                found = auto.scan(b" %b " % b" ".join(w)) if w else []
                spans = {(a, b) for a, b, _ in found} | ({(x["a"], x["b"]) for x in old[0][i]} if old else set())
                hits.append([{"a": a, "b": b} for a, b in sorted(spans)])
                seen.append(sorted({str(x) for *_, items in found for x in items} | set(old[1][i] if old else ())))
                n_words.append(len(w))
            keep = [n for n in batch.schema.names if first or n not in ("__d_hits", "__d_items", "__d_words")]
            cols = [batch.column(n) for n in keep]
            cols += [pa.array(hits, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(seen, pa.list_(pa.string())), pa.array(n_words, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "__d_hits", "__d_items", "__d_words"])

    return run


def _merged(hits):
    """Maximal word runs of sorted spans."""
    out: list[list[int]] = []
    for x in hits:
        if out and x["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["b"])
        else:
            out.append([x["a"], x["b"]])
    return out


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", size: int = WINDOW) -> DataFrame:
    """`docs` with ``__d_hits`` (word spans), ``__d_items`` (item ids as sorted strings) and ``__d_words``.

    Narrow: each row stays where it is, so hot sources or copies do not matter. Items come to the driver, as a
    benchmark is a stated, small set; what is broadcast at once is bounded by `BLOCK_BYTES`. Null texts have no words.
    A null item id counts as the string "None"; repeated items count once for each id. Repeated rows give a row each, an
    empty table none; without items nothing is hit. Texts count whole, however long. Columns of the input that bear a
    result's name give way; all others stay.
    """
    spark = docs.sparkSession
    batches(spark)
    docs = docs.drop("__d_text", "__d_hits", "__d_items", "__d_words")
    stated = ((r[0], r[1]) for r in items.select(item_id, "text").toLocalIterator())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.withColumn("__d_text", F.col(text))
    schema += ", __d_text string, __d_hits array<struct<a:bigint,b:bigint>>, __d_items array<string>, __d_words bigint"
    for i, block in enumerate(item_blocks(stated, size)):
        sent = spark.sparkContext.broadcast(block)
        out = out.mapInArrow(_scanner(sent, uuid.uuid4().hex, i == 0), schema)
    return out.drop("__d_text")


def _digest(it):
    for batch in it:
        hits, items = batch.column("__d_hits").to_pylist(), batch.column("__d_items").to_pylist()
        n_hit = [sum(b - a for a, b in _merged(h)) for h in hits]
        names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        cols = [pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([n > 0 for n in n_hit])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__d_words"), *cols], names)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a window of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scan(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "__d_hits", "__d_items", "__d_words")
    return found.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _cut(it):
    """Take the hit words out of the text, and the separators between them; the rest stays byte for byte."""
    for batch in it:
        texts = []
        for t, hits in zip(batch.column("text").to_pylist(), batch.column("__d_hits").to_pylist(), strict=True):
            if not hits:
                texts.append(t)
                continue
            raw = t.encode()
            is_word = np.concatenate(([False], np.frombuffer(raw.translate(_FOLD), np.uint8) != 32, [False]))
            edges = np.diff(is_word.astype(np.int8))
            starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            parts, at = [], 0
            for a, b in _merged(hits):
                parts.append(raw[at : starts[a]])
                at = int(ends[b - 1])
            texts.append(b"".join([*parts, raw[at:]]).decode())
        cols = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names if n[:4] != "__d_"]
        yield pa.RecordBatch.from_arrays(cols, [n for n in batch.schema.names if n[:4] != "__d_"])


def _scanned(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, list[str]]:
    """`docs` scanned under names that cannot clash, and these names in order; ``text`` keeps its own."""
    names = [c if c == "text" else f"c_{i}" for i, c in enumerate(docs.columns)]
    return scan(docs.toDF(*names), items), names


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`docs` with all words of benchmark windows taken out of ``text``; all other rows and columns stay as they are.

    Null texts stay null. Cases are as in `scan`, but no column gives way.
    """
    found, names = _scanned(docs, items)
    schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    return found.mapInArrow(_cut, schema).toDF(*docs.columns)


def uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` without any window of an item, with all their columns. Null texts have no words and stay."""
    found, names = _scanned(docs, items)
    return found.where(F.size("__d_hits") == 0).select(*names).toDF(*docs.columns)


OP5_SQL = """WITH
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'None') AS item, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, i, dw.n, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM hit GROUP BY r)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)"""
