"""Best-fit packing by linear grouping.

All planning runs on the histogram of piece lengths, which has at most `capacity` bins whatever the corpus holds:

1. lengths over a threshold are rounded up within groups of equal cardinality;
2. few sizes are left, so a linear programme over configurations of them (column generation with a knapsack for each
   step) says how many sequences of each configuration to open;
3. actual documents take the places of the rounded ones: each place but a configuration's last takes the longest document
   up to its size, and the last one the longest that still fits, so what rounding left over is used up;
4. what the whole parts of the programme did not place goes through steps 1 to 3 again;
5. small lengths go where they fit best, into the room that configurations leave.

The plan says for each range of ranks within a length which sequences and offsets it takes. Documents get their rank
from counts per (task, length), so nothing is sorted and no group is collected.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.llm.shared import batches, settle, table
from proselake.llm.pieces import piece_ids

#: Lengths up to this share of the capacity are small; groups of equal cardinality for the others.
SMALL_SHARE, GROUPS = 0.25, 96


def grouped(hist: dict[int, int], low: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Linear grouping: (rounded size, [(length, count)...]) of groups of equal cardinality, longest first."""
    todo = [(length, hist[length]) for length in sorted(hist, reverse=True) if length > low]
    each = -(-sum(n for _, n in todo) // groups) if todo else 0
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length, n in todo:
        while n:
            if not room:
                out.append((length, []))
                room = each
            k = min(n, room)
            out[-1][1].append((length, k))
            n, room = n - k, room - k
    return out


def _best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity with the largest value: an unbounded knapsack."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        gain = best[c - sizes[fits]] + value[fits]
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-12:
            best[c], took[c] = gain[k], fits[k]
        else:
            best[c] = best[c - 1]
    made, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if took[c] >= 0:
            made[took[c]] += 1
            c -= int(sizes[took[c]])
        else:
            c -= 1
    return float(best[capacity]), made


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, by the linear programme that uses the fewest sequences.

    After `rounds` columns the programme ends with what it has, which is a valid solution if not the best one. With 96
    sizes it took 150 to 400.
    """
    s, d = np.array(sizes), np.array(demand, float)
    columns = np.diag((capacity // s).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(columns)
        x, price = inverse @ d, inverse.sum(axis=0)
        value, new = _best_configuration(s, price, capacity)
        if value <= 1 + 1e-6:
            break
        step = inverse @ new
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        columns[:, int(ratio.argmin())] = new
    x = np.maximum(np.linalg.solve(columns, d), 0)
    return [(columns[:, i], float(x[i])) for i in range(len(s)) if x[i] > 0]


class _Plan:
    """Classes of sequences alike: ids first .. first + count - 1, the room left, and ranges of ranks put into them."""

    def __init__(self, hist: dict[int, int], capacity: int):
        self.capacity, self.left, self.rank, self.rows, self.next = capacity, dict(hist), dict.fromkeys(hist, 0), [], 0
        self.in_configurations = 0
        self.free: dict[int, list[tuple[int, int]]] = {}

    def place(self, length: int, first: int, count: int, offset: int) -> None:
        """The next `count` documents of this length go to the sequences from `first` on, one each, at `offset`."""
        self.rows.append((length, self.rank[length], count, first, offset))
        self.rank[length] += count
        self.left[length] -= count

    def keep(self, first: int, count: int, room: int) -> None:
        if room and count:
            self.free.setdefault(room, []).append((first, count))

    def longest(self, top: int, low: int, taken: dict[int, int]) -> int:
        """The longest length over `low` and up to `top` of which there are more than those taken; 0 if there is none."""
        while top > low and self.left.get(top, 0) <= taken.get(top, 0):
            top -= 1
        return top if top > low else 0

    def configured(self, sizes: list[int], demand: list[int], low: int) -> int:
        """Open the configurations that the programme wants for these sizes; how many documents they took."""
        placed = 0
        for config, times in sorted(configurations(sizes, demand, self.capacity), key=lambda u: -u[1]):
            todo, slots = int(times + 1e-6), [s for s, n in zip(sizes, config, strict=True) for _ in range(int(round(n)))]
            while todo:
                taken: dict[int, int] = {}
                lengths, room = [], self.capacity
                for i, size in enumerate(slots):
                    length = self.longest(room if 0 < i == len(slots) - 1 else size, low, taken)
                    if not length:
                        break
                    taken[length] = taken.get(length, 0) + 1
                    lengths.append(length)
                    room -= length
                if len(lengths) < len(slots):
                    break  # the documents of these sizes are used up
                # sequences stay alike until one of the lengths runs out
                count = min(todo, *(self.left[length] // n for length, n in taken.items()))
                offset = 0
                for length in lengths:
                    self.place(length, self.next, count, offset)
                    offset += length
                self.keep(self.next, count, room)
                self.next += count
                todo -= count
                placed += count * len(lengths)
        return placed

    def best_fit(self, length: int) -> None:
        while n := self.left[length]:
            room = min((r for r in self.free if r >= length), default=None)
            if room is None:
                room, first = self.capacity, self.next
                k = min(room // length, n)
                count = n // k
                self.next += count
            else:
                first, count = self.free[room].pop()
                if not self.free[room]:
                    del self.free[room]
                k = min(room // length, n)
                used = min(count, n // k)
                self.keep(first + used, count - used, room)
                count = used
            for i in range(k):
                self.place(length, first, count, self.capacity - room + i * length)
            self.keep(first, count, room - k * length)


def plan(hist: dict[int, int], capacity: int = 1024, groups: int = GROUPS, small_share: float = SMALL_SHARE) -> _Plan:
    """The plan for a histogram of lengths: ``rows`` of (length, first rank, count, first sequence, offset), ``next``
    sequences in all, and ``in_configurations`` documents that the configurations took.
    """
    p = _Plan(hist, capacity)
    full = hist.get(capacity, 0)
    if full:
        p.place(capacity, 0, full, 0)
        p.next = full
    low = int(capacity * small_share)
    while made := grouped({k: n for k, n in p.left.items() if n}, low, groups):
        # groups of one rounded size are one size of the programme
        sizes = sorted({size for size, _ in made}, reverse=True)
        demand = [sum(n for s, parts in made if s == size for _, n in parts) for size in sizes]
        placed = p.configured(sizes, demand, low)
        p.in_configurations += placed
        if not placed:
            break
    for length in sorted(p.left, reverse=True):
        p.best_fit(length)
    return p


def _cut(path: str, end_id: int, capacity: int):
    end = np.array([end_id], "<u4")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]

    def run(it):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encoder = piece_ids(path, keeps_white=True)
        for batch in it:
            ids, piece, start, length, crc, rank = [], [], [], [], [], []
            for doc, got in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1)), strict=True):
                got = memoryview(np.concatenate((got, end)))
                n = len(got)
                at, k = 0, n % capacity or capacity
                i = 0
                while at < n:
                    ids.append(doc)
                    piece.append(i)
                    start.append(at)
                    length.append(k)
                    crc.append(zlib.crc32(got[at : at + k]))
                    rank.append(int(seen[k]))
                    seen[k] += 1
                    at, k, i = at + k, capacity, i + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(ids), pa.int32()), pa.array(rank, pa.int64())],
                names,
            )

    return run


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A null text counts as empty and still has its end id, so each row of the input gives at least one piece. Null and
    repeated ids give pieces as any other; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    batches(spark)
    source = docs.select(F.col(doc_id).cast("long"), text)
    cut = source.mapInArrow(_cut(path, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")
    pieces = settle(cut, "pieces")
    counts = settle(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows = sorted(plan(hist, capacity).rows)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    keys = np.array([(length << 44) + rank for length, rank, *_ in rows], np.int64)
    first, offset = (np.array([r[i] for r in rows], np.int64) for i in (3, 4))
    laid = spark.sparkContext.broadcast((keys, first, offset))

    def place(it):
        keys, first, offset = laid.value
        for batch in it:
            key = (batch.column("length").to_numpy().astype(np.int64) << 44) + batch.column("rank").to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            got = [pa.array(first[at] + key - keys[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), *got], [*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = pieces.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 byte-level ids over all documents."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
