"""Token counts by way of pre-tokens.

A sentence-piece text is cut before each run of blanks, where no piece reaches across. Each distinct pre-token of the
corpus then goes to the library once, and a document's count is the sum over its pre-tokens.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.llm.shared import batches, held, most_frequent, settle, table

#: No piece holds a blank after another character, so a cut before any run of blanks is safe. The library writes a
#: blank as U+2581 and takes that character for one.
SENTENCE_LEVEL = re.compile("[ ▁]*[^ ▁]+|[ ▁]+")


def sentence_pieces(path: str):
    import sentencepiece

    return held(("sentence pieces", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))


#: The most frequent pre-tokens of at most LONGEST characters, whose counts every task gets by broadcast: at most
#: FREQUENT * LONGEST characters (19.2 MB), and about 4 MB in practice. All other pre-tokens meet their counts in a join.
FREQUENT, LONGEST = 150_000, 32
#: Distinct pre-tokens that a task counts before it passes them on.
_HELD = 200_000


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a sentence-piece text: the library puts one blank before the text, if there is any text."""
    return SENTENCE_LEVEL.findall(" " + text) if text else []


def _pre_token_sums(it):
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["pre_token", "n"])

    for batch in it:
        for t in batch.column(0):
            held.update(pre_tokens(t.as_py() or ""))
        if len(held) > _HELD:
            yield out()
            held.clear()
    yield out()


def _count_pieces(path: str):
    def count(it):
        sp = sentence_pieces(path)
        for batch in it:
            words = batch.column(0).to_pylist()
            # the library adds its own blank in front; a pre-token always starts with one
            n = [len(x) for x in sp.encode([w[1:] for w in words], num_threads=1)]
            # ... but it gives nothing for an empty rest, which stands for a single blank
            n = [1 if w in (" ", "▁") else k for w, k in zip(words, n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["pre_token", "n", "pieces"])

    return count


def piece_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(pre_token, n, pieces): every distinct pre-token of the corpus, how often it occurs, and its number of pieces.

    Tasks sum before the exchange; each distinct pre-token is counted once. The table is written to the shared folder.
    """
    batches(docs.sparkSession)
    sums = docs.select(text).mapInArrow(_pre_token_sums, "pre_token string, n long")
    distinct = sums.groupBy("pre_token").agg(F.sum("n").alias("n"))
    return settle(distinct.mapInArrow(_count_pieces(path), "pre_token string, n long, pieces long"), "pieces")


def _row_key(doc, text: bytes, seen: Counter) -> int:
    """A 64-bit key of a row among those of its task, by what it holds: its id, its text, and how many such rows came
    before it. It does not depend on the order of rows, so a task that runs again gives each row the same key."""
    import xxhash

    own = xxhash.xxh3_64_intdigest(text, seed=0 if doc is None else (doc & 0xFFFFFFFFFFFFFFFF) ^ 0x9E3779B97F4A7C15)
    seen[own] += 1
    key = own if seen[own] == 1 else xxhash.xxh3_64_intdigest(own.to_bytes(8, "little"), seed=seen[own])
    return key - (1 << 64) if key >> 63 else key


def _frequencies(known):
    """For each row one record with its size and what the frequent pre-tokens give, and one for each other pre-token."""
    def run(it):
        get, seen, part = known.value.get, Counter(), TaskContext.get().partitionId()
        names = ["part", "row", "doc_id", "n_bytes", "pre_token", "n"]
        for batch in it:
            rows, ids, sizes, words, counts = [], [], [], [], []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py() or ""
                raw = text.encode()
                key, total = _row_key(doc, raw, seen), 0
                for w, n in Counter(pre_tokens(text)).items():
                    p = get(w)
                    if p is None:
                        rows.append(key)
                        ids.append(None)
                        sizes.append(None)
                        words.append(w)
                        counts.append(n)
                    else:
                        total += n * p
                rows.append(key)
                ids.append(doc)
                sizes.append(len(raw))
                words.append(f"\0{part}/{key}")  # no pre-token begins so, and the rows of a hot one are dealt out
                counts.append(total)
            cols = [pa.array([part] * len(rows), pa.int32()), *(pa.array(x, pa.int64()) for x in (rows, ids, sizes)), pa.array(words, pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, without any text's ids.

    Null and empty texts have no tokens. Repeated rows and null ids give a row each. Other columns are not read.
    The counts of frequent pre-tokens come by a broadcast of bounded size; the rest meet the piece table in a join on
    the pre-token, where no key is frequent any more.
    """
    spark = docs.sparkSession
    pieces = piece_table(docs, path, text)
    top = most_frequent(pieces.where(F.length("pre_token") <= LONGEST), "n", FREQUENT)
    known = spark.sparkContext.broadcast({r["pre_token"]: r["pieces"] for r in top.select("pre_token", "pieces").toLocalIterator()})
    source = docs.select(F.col(doc_id).cast("long"), text)
    freq = source.mapInArrow(_frequencies(known), "part int, row long, doc_id long, n_bytes long, pre_token string, n long")
    joined = freq.join(pieces.select("pre_token", "pieces").hint("shuffle_hash"), "pre_token", "left")
    return (
        joined.groupBy("part", "row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence-piece counts of every document."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
