"""Ranked lexical search: an inverted index in shards of documents, searched by Block-Max WAND.

A shard's postings stand in blocks of `BLOCK`, compressed byte by byte, each with its last document and its largest impact.
A query moves shallow pointers over these: the maxima of the blocks that a document lies in bound its score. Only documents
whose bound reaches the k-th best score so far are pivots, and only blocks with a pivot are decompressed; each decompressed
list turns bounds into scores and leaves fewer pivots for the next one. Within a shard documents are numbered by length, so that
the impacts of a block are alike. All pivots of a shard move together in arrays, which keeps the work out of Python loops.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.llm.decontaminate import _FOLD
from proselake.llm.shared import batches, settle, split_count, table, temporary

K, BLOCK = 10, 64
#: Documents and postings after which a shard is full; a document stays whole.
SHARD_DOCS, SHARD_POSTINGS = 8192, 2_000_000
#: Bytes of text that are split into words at a time, and bytes of query text that are searched for at a time.
CHUNK, QUERY_BYTES = 1 << 20, 4 << 20

#: A row is the postings of a term in a shard; the empty term has the shard's documents: ids, which of them are null, and m.
INDEX = "shard long, term string, df long, last binary, top binary, code binary, data binary, ids array<{id}>"


def term_counts(text: str | None) -> Counter:
    """Terms of a text as UTF-8, A-Z in lower case, with their occurrences; none for null."""
    out = Counter()
    for part in _chunks(text):
        out.update(part.split())
    return out


def _lengths(it):
    for b in it:
        n = [sum(len(p.split()) for p in _chunks(t.as_py())) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], ["n", "l"])


def _chunks(text: str | None) -> Iterator[bytes]:
    folded, at = (text or "").encode().translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + CHUNK)
        end = len(folded) if end < 0 else end
        yield folded[at:end]
        at = end


def impact(tf, m):
    """What an occurrence count is worth in a document of normalised length m, before the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Shard:
    def __init__(self, n_docs: int, n_terms: int):
        self.total, self.vocabulary = (n_docs, n_terms), defaultdict(count().__next__)
        self.ids, self.n, self.terms, self.tf, self.postings = [], [], [], [], 0

    def add(self, doc_id, text: str | None):
        c = term_counts(text)
        if c:
            self.ids.append(doc_id)
            self.terms.append(np.fromiter(map(self.vocabulary.__getitem__, c), np.int32, len(c)))
            self.tf.append(np.fromiter(c.values(), np.int64, len(c)))
            self.n.append(int(self.tf[-1].sum()))
            self.postings += len(c)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def rows(self, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        """The shard's rows of `INDEX`, the empty term's first, the others in the order of their terms' numbers."""
        n_docs, n_terms = self.total
        order = np.argsort(np.array(self.n), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # m in Python's integers, as 75 n N may exceed 64 bits
        m = np.array([25 + 75 * self.n[i] * n_docs // n_terms for i in order.tolist()], np.int64)
        doc = np.repeat(place, [len(t) for t in self.terms])
        term, tf = np.concatenate(self.terms).astype(np.int64), np.concatenate(self.tf)
        by = np.argsort(term << 32 | doc)
        term, doc, tf = term[by], doc[by], tf[by]
        parts = _packed(term, doc, tf, impact(tf, m[doc]))
        df, at_block, at_byte, last, top, code, data = parts
        words = pa.array(self.vocabulary.keys(), pa.binary()).cast(pa.string())
        cut = lambda at, width, raw: pa.concat_arrays([pa.array([None], pa.binary()), pa.Array.from_buffers(pa.binary(), len(df), [None, pa.py_buffer((at * width).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])])
        first = pa.array([[self.ids[i] for i in order.tolist()]], pa.list_(id_type))
        cols = [pa.array(np.full(len(df) + 1, number), pa.int64()), pa.concat_arrays([pa.array([""]), words]), pa.concat_arrays([pa.array([len(order)], pa.int64()), pa.array(df, pa.int64())]),
                cut(at_block, 4, last), cut(at_block, 4, top), cut(at_block, 1, code),
                pa.concat_arrays([pa.array([m.tobytes()], pa.binary()), pa.Array.from_buffers(pa.binary(), len(df), [None, pa.py_buffer(at_byte.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])]),
                pa.concat_arrays([first, pa.nulls(len(df), pa.list_(id_type))])]
        return pa.RecordBatch.from_arrays(cols, ["shard", "term", "df", "last", "top", "code", "data", "ids"])


def _packed(term, doc, tf, worth):
    """Postings in the order of (term, document) as blocks: gaps to the document before, less one, then counts less one, each
    in as many bytes as the block needs. Gives, by term, df, first block and first byte (with one more for the end), by block the
    last document, the largest impact and the widths, and all bytes.
    """
    n = len(term)
    starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    df = np.diff(np.append(starts, n))
    within = np.arange(n) - np.repeat(starts, df)
    block = np.flatnonzero(within % BLOCK == 0)
    size = np.diff(np.append(block, n))
    before = np.concatenate(([-1], doc[:-1]))
    before[starts] = -1
    gap, more = doc - before - 1, tf - 1
    width = lambda x: (lambda top: np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, np.where(top < 1 << 32, 4, 8))))(np.maximum.reduceat(x, block))
    gw, tw = width(gap), width(more)
    at = np.concatenate(([0], np.cumsum(size * (gw + tw))))
    data = np.zeros(at[-1], np.uint8)
    j = np.arange(n) - np.repeat(block, size)
    for value, w, start in ((gap, gw, at[:-1]), (more, tw, at[:-1] + size * gw)):
        wide, where = np.repeat(w, size), np.repeat(start, size) + j * np.repeat(w, size)
        for byte in range(int(w.max())):
            rows = wide > byte
            data[where[rows] + byte] = (value[rows] >> (8 * byte)) & 255
    at_block = np.append(np.searchsorted(block, starts), len(block))
    return df, at_block, at[at_block], doc[block + size - 1].astype(np.int32), np.maximum.reduceat(worth, block).astype(np.int32), (gw * 16 + tw).astype(np.uint8), data


def _indexed(n_docs: int, n_terms: int):
    def run(it):
        shard, made, kind = _Shard(n_docs, n_terms), 0, None
        number = lambda: (TaskContext.get().partitionId() << 32) | made
        for b in it:
            kind = b.column(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard.add(doc_id, text.as_py())
                if shard.full():
                    yield shard.rows(number(), kind)
                    shard, made = _Shard(n_docs, n_terms), made + 1
        if shard.ids:
            yield shard.rows(number(), kind)

    return run


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """An index of all terms of `docs` in rows of `INDEX`, settled in files, and the number of documents with a term.

    Narrow: shards follow the tasks that read the documents, so hot sources and copies do not matter; a shard is bounded but for
    a document that is larger by itself. Whole texts count. Null and empty texts have no terms and stand in no shard.
    """
    batches(docs.sparkSession)
    n_docs, n_terms = docs.select(text).mapInArrow(_lengths, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(doc_id, text).mapInArrow(_indexed(n_docs or 0, n_terms or 0), INDEX.format(id=id_type))
    return settle(rows, "index"), n_docs or 0


class _List:
    """A term's postings in a shard: shallow pointers over all blocks, documents and impacts of those that were asked for."""

    def __init__(self, last: bytes, top: bytes, code: bytes, data: bytes, df: int, m: np.ndarray):
        self.last, self.top, self.data, self.m = np.frombuffer(last, np.int32), np.frombuffer(top, np.int32), data, m
        code = np.frombuffer(code, np.uint8)
        self.gw, self.tw = (code >> 4).astype(np.int64), (code & 15).astype(np.int64)
        self.size = np.full(len(code), BLOCK)
        self.size[-1] = df - BLOCK * (len(code) - 1)
        self.at = np.concatenate(([0], np.cumsum(self.size * (self.gw + self.tw))))
        # where each block's documents begin: past the last one of the block before
        self.first = np.concatenate(([0], self.last[:-1] + 1))
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def decompress(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b not in self.open:
            a, n, gw, tw = self.at[b], int(self.size[b]), int(self.gw[b]), int(self.tw[b])
            gap = np.frombuffer(self.data, f"<u{gw}", n, a).astype(np.int64) + 1
            tf = np.frombuffer(self.data, f"<u{tw}", n, a + n * gw).astype(np.int64) + 1
            doc = gap.cumsum() + (int(self.first[b]) - 1)
            self.open[b] = doc, impact(tf, self.m[doc])
        return self.open[b]

    def bounds(self, out: np.ndarray, w: int):
        """Add the largest impact of each document's block, times the weight."""
        end = int(self.last[-1]) + 1
        out[:end] += np.repeat(self.top.astype(np.int64) * w, np.diff(np.append(self.first, end)))


def search_shard(lists: list[tuple[int, _List]], n: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents of a shard of `n` with the scores of those that may belong to the k best, all not below `least`.

    Also the number of blocks decompressed. A document equal to the k-th best stays, as ties are for the ids to break.
    """
    bound = np.zeros(n, np.int64)
    for w, x in lists:
        x.bounds(bound, w)
    order = sorted(lists, key=lambda p: (len(p[1].last), -p[0] * int(p[1].top.max())))

    def scored(docs: np.ndarray, least: int):
        """Pivots `docs`, rising, list by list: a decompressed block gives scores, which replace the block's maximum."""
        have = bound[docs]
        for w, x in order:
            if not len(docs):
                break
            block = np.searchsorted(x.last, docs)
            there = block < len(x.last)
            inside, mine = docs[there], block[there]
            change = x.top[mine].astype(np.int64) * -w
            for b in np.unique(mine).tolist():
                doc, worth = x.decompress(b)
                lo, hi = np.searchsorted(mine, (b, b + 1))
                at = np.searchsorted(doc, inside[lo:hi])
                hit = doc[np.minimum(at, len(doc) - 1)] == inside[lo:hi]
                change[lo:hi][hit] += w * worth[at[hit]]
            have[there] += change
            stay = have >= least
            docs, have = docs[stay], have[stay]
        return docs, have

    def kth(score: np.ndarray) -> int:
        return max(least, int(np.partition(score, len(score) - k)[len(score) - k])) if len(score) >= k else least

    pivots = np.flatnonzero(bound >= least)
    if len(pivots) > 4 * k:
        # the best bounds first, for a threshold that leaves few pivots among the rest
        tops = np.argpartition(bound[pivots], len(pivots) - 2 * k)[len(pivots) - 2 * k :]
        least = kth(scored(np.sort(pivots[tops]), least)[1])
        pivots = pivots[bound[pivots] >= least]
    docs, score = scored(pivots, least)
    stay = score >= kth(score)
    return docs[stay], score[stay], sum(len(x.open) for _, x in lists)


def _searched(queries, weights, k: int):
    """For rows of the index in the order of their shards: each task's k best documents of every query."""

    def run(it):
        best: list[list[tuple]] = [[] for _ in queries.value]
        shard, rows, id_type = None, {}, None

        def done():
            head = rows.pop("")
            m, ids = np.frombuffer(head["data"], np.int64), head["ids"]
            lists = {t: _List(r["last"], r["top"], r["code"], r["data"], r["df"], m) for t, r in rows.items()}
            for q, (_, terms) in enumerate(queries.value):
                mine = [(c * weights.value[t], lists[t]) for t, c in terms if t in lists and weights.value[t] > 0]
                if mine:
                    least = best[q][-1][0] if len(best[q]) == k else 1
                    docs, scores, _ = search_shard(mine, len(m), k, least)
                    if len(docs):
                        got = [(s, ids[d]) for s, d in zip(scores.tolist(), docs.tolist(), strict=True)]
                        best[q] = sorted(best[q] + got, key=lambda x: (-x[0], x[1] is None, x[1]))[:k]

        for b in it:
            id_type = b.schema.field("ids").type.value_type
            for r in b.to_pylist():
                if r["shard"] != shard:
                    if rows:
                        done()
                    shard, rows = r["shard"], {}
                rows[r["term"]] = r
        if rows:
            done()
            found = [(q, d, s) for q, x in enumerate(best) for s, d in x]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], id_type), pa.array([f[2] for f in found], pa.int64())], ["q", "doc_id", "score"])

    return run


def _query_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    block, used = [], 0
    for item, t in items.select(item_id, text).toLocalIterator():
        terms = [(w.decode(), c) for w, c in term_counts(t).items()]
        if terms:
            block.append((item, terms))
            used += sum(len(w) for w, _ in terms)
        if used > QUERY_BYTES:
            yield block
            block, used = [], 0
    if block:
        yield block


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = K, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The `k` best documents of an index for each item: (item_id, rank, doc_id, score).

    Items come to the driver in blocks of `QUERY_BYTES`, one at a time, each searched for in the whole index. Of the index only
    rows of a block's terms leave their files. Equal scores are ranked by rising doc_id, null ids last; repeated rows of
    the documents are documents each, repeated items have a result each. An item without terms or without a document
    above 0 has none, and so has everything over an empty index.
    """
    spark = index.sparkSession
    id_type = index.schema["ids"].dataType.elementType.simpleString()
    item_type = items.schema[item_id].dataType
    out = None
    for block in _query_blocks(items, item_id, text):
        terms = spark.createDataFrame([(t,) for t in sorted({t for _, ts in block for t, _ in ts})], "term string")
        found = index.join(F.broadcast(terms), "term")
        # at most a row for each term of a bounded block
        weights = {r["term"]: weight(n_docs, r["df"]) for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        rows = index.join(F.broadcast(terms.union(spark.createDataFrame([("",)], "term string"))), "term")
        # shards spread over tasks, each task meets the rows of a shard together
        rows = rows.repartition(split_count(spark), "shard").sortWithinPartitions("shard", "term").select(*index.columns)
        hits = rows.mapInArrow(_searched(spark.sparkContext.broadcast(block), spark.sparkContext.broadcast(weights), k), f"q long, doc_id {id_type}, score long")
        by = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], f"q long, item_id {item_type.simpleString()}")
        ranked = ranked.join(F.broadcast(ids), "q").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out if out is not None else spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id {id_type}, score long")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with temporary(spark) as done:
        index, n_docs = build_index(docs)
        return done(settle(search(index, n_docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))))


_SPLIT = "list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP11_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
t AS (SELECT CAST(count(*) AS HUGEINT) AS n, CAST(sum(len(w)) AS HUGEINT) AS l FROM d WHERE len(w) > 0),
p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
q AS (SELECT i, term, count(*) AS c FROM (SELECT i, unnest(w) AS term FROM (SELECT row_number() OVER () AS i, {_SPLIT} AS w FROM benchmark)) GROUP BY i, term),
b AS (SELECT row_number() OVER () AS i, item_id FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, t GROUP BY term, n),
m AS (SELECT r, doc_id, CAST(25 + (75 * len(w) * n) // l AS BIGINT) AS m FROM d, t WHERE len(w) > 0),
s AS (SELECT i, r, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s JOIN b USING (i) JOIN m USING (r) WHERE score > 0 QUALIFY rank <= {K}"""
