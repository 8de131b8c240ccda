"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has `VIRTUAL` points on a ring of 64-bit hashes; a row belongs to the shard of the next point clockwise.
A shard takes rows up to its bound; rows beyond it continue clockwise to the next point of a shard with room. The walk
runs on the number of rows between neighbouring points (a table whose size depends on shards alone) and says which
ranks of each arc go where. Rows get their rank in an arc from a range-partitioned sort of small rows by ring position,
so the result depends on the data, not on how it was split over files or tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.llm.shared import settle, split_count, table

SHARDS, VIRTUAL = 8, 128


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """Points in ring order as signed 64-bit numbers, and the shard that each belongs to."""
    points = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "little", signed=True), s) for s in range(shards) for v in range(virtual))
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def walk(counts: list[int], owner: np.ndarray, shards: int, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rows, shard, first slot) so that no shard takes more than its bound.

    With no slack the bounds are the mean rounded down or up, adding up to all rows: counts differ by one at most.
    """
    total = sum(counts)
    bound = [max(total // shards + (s < total % shards), int(-(-total * (1 + slack) // shards)) * (slack > 0)) for s in range(shards)]
    used, out, over = [0] * shards, [], []
    for arc, n in enumerate(counts):
        s = int(owner[arc])
        k = min(n, bound[s] - used[s])
        if k:
            out.append((arc, 0, k, s, used[s]))
            used[s] += k
        if n > k:
            over.append((arc, k, n - k))
    for arc, rank, n in over:
        for step in range(1, len(counts) + 1):
            s = int(owner[(arc + step) % len(counts)])
            k = min(n, bound[s] - used[s])
            if k:
                out.append((arc, rank, k, s, used[s]))
                used[s], rank, n = used[s] + k, rank + k, n - k
            if not n:
                break
    return sorted(out)


def _ranked(points: np.ndarray):
    def run(it):
        task, seen = TaskContext.get().partitionId(), np.zeros(len(points), np.int64)
        for batch in it:
            # sorted by position: rows of an arc are neighbours
            arc = np.searchsorted(points, batch.column("position").to_numpy()) % len(points)
            rank = np.empty(len(arc), np.int64)
            edges = np.flatnonzero(np.concatenate(([True], arc[1:] != arc[:-1], [True]))) if len(arc) else []
            for a, b in zip(edges, edges[1:]):
                rank[a:b] = seen[arc[a]] + np.arange(b - a)
                seen[arc[a]] += b - a
            keep = ["doc_id", "size", "text_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array([task] * len(arc), pa.int32()), pa.array(arc.astype(np.int64)), pa.array(rank)], [*keep, "task", "arc", "rank"])

    return run


def shard(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, slack: float = 0.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; slots of a shard run from 0 without gaps.

    A row's ring position comes from its id and its text's size and checksum, so null and repeated ids spread over the
    ring. Wholly equal rows are neighbours and interchangeable. A null text has no bytes. No text is moved. An empty
    table gives no rows; columns other than the id and the text are not read.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    small = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    # wholly equal rows are interchangeable, so any number tells them apart and lets them go to several tasks
    small = small.withColumns({"position": F.xxhash64("doc_id", "size", "text_crc32"), "any": F.monotonically_increasing_id()})
    order = ["position", "doc_id", "size", "text_crc32", "any"]
    points, owner = ring(shards, virtual)
    dealt = small.repartitionByRange(split_count(spark, small), *order).sortWithinPartitions(*order)
    ranked = settle(dealt.mapInArrow(_ranked(points), "doc_id long, size long, text_crc32 long, task int, arc long, rank long"), "ranked")
    counts = settle(ranked.groupBy("arc", "task").agg(F.count("*").alias("n")), "counts")
    by_arc = {r["arc"]: r["n"] for r in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # shards * virtual rows at most
    rows = walk([by_arc.get(a, 0) for a in range(len(points))], owner, shards, slack)
    keys = np.array([(arc << 44) + rank for arc, rank, *_ in rows], np.int64)
    to, slot = (np.array([r[i] for r in rows], np.int64) for i in (3, 4))
    before = Window.partitionBy("arc").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("arc", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(it):
        for batch in it:
            key = (batch.column("arc").to_numpy() << 44) + batch.column("rank").to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(to[at].astype(np.int32)), pa.array(slot[at] + key - keys[at])], [*batch.schema.names[:3], "shard", "slot"])

    full = ranked.join(base, ["arc", "task"]).select("doc_id", "size", "text_crc32", "arc", (F.col("rank") + F.col("base")).alias("rank"))
    return full.mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int, slot long")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of all documents under the law `rows`: counts at most one apart."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
