"""Helpers that the training-data operators have in common."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that goes to a Python task; long texts make the byte bound the one that counts.
BATCH_ROWS = 500
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder; the folder may be in any store that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made by the operators that run within `temporary`, innermost last.
_MADE: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the driver and all executors see.

    Only where the session does not set that folder (local tests) a temporary one of this machine takes its place.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/proselake"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Delete what operators write within, but for the tables that the given function is told to keep.

    ``with temporary(spark) as done: out = done(settle(operator(docs)))``: `out` stands in files and needs nothing else.
    """
    _MADE.append([])
    kept: list[str] = []

    def done(df: DataFrame) -> DataFrame:
        kept.extend(df.inputFiles())
        return df

    try:
        yield done
    finally:
        made = _MADE.pop()
        for path in made:
            if not any(uuid_of(path) in f for f in kept):
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            elif _MADE:
                _MADE[-1].append(path)


def uuid_of(path: str) -> str:
    return path.rpartition("/")[2]


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts the lineage at files that survive lost executors, and each written partition comes from exactly one
    task attempt, so later steps may rely on ids that were given out inside tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of this session, so that long texts cannot fill a Python worker.

    The bounds hold for the session, since plans run after the call that made them; smaller ones of the caller stay.
    """
    for name, bound, now in (("maxRecordsPerBatch", rows, int), ("maxBytesPerBatch", BATCH_BYTES, lambda x: int(x.rstrip("b")) if x.rstrip("b").isdigit() else None)):
        key = f"spark.sql.execution.arrow.{name}"
        have = now(spark.conf.get(key))
        if have is None or not 0 < have <= bound:
            spark.conf.set(key, str(bound))


#: What this Python worker keeps from task to task: objects of one kind, by key.
_HELD: dict[tuple, object] = {}


def held(key: tuple, make=None, room: int = 1):
    """The object with this key, made where the worker does not have it yet. Of its kind, the key's first part, `room` stay;
    all of another kind go.

    Workers outlive stages, so what one operator kept would stand beside the next one's memory.
    """
    if key not in _HELD:
        for old in [k for k in _HELD if k[0] != key[0]] or list(_HELD)[: max(0, len(_HELD) + 1 - room)]:
            del _HELD[old]
        if make is not None:
            _HELD[key] = make()
    return _HELD.get(key)


#: Bytes of input for a task of an explicit exchange.
TASK_BYTES = 256 << 20


def split_count(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Partitions for an explicit exchange of `df`: the session's own number, or more where its files are large."""
    size, leaves = 0, df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator() if df is not None else None
    while leaves is not None and leaves.hasNext():
        own = int(str(leaves.next().stats().sizeInBytes()))
        # a table without files has no known size
        size += own if own < 1 << 60 else 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)


def least_count(counted: DataFrame, n: str, bound: int) -> int:
    """The least count of which at most `bound` rows have as much or more, to within a sixteenth.

    Counts are summed by their size class, so a table of a few hundred rows comes to the driver, and no rows are sorted.
    """
    # classes: below 16 each count, then 16 steps for each power of two
    step = F.expr(f"CASE WHEN {n} < 16 THEN {n} ELSE {n} - {n} % shiftleft(1L, length(bin({n})) - 5) END")
    sizes = sorted(((r["c"], r["k"]) for r in counted.groupBy(step.cast("long").alias("c")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, rows = (sizes[0][0] + (1 << 60), 0) if sizes else (1, 0)
    for c, k in sizes:
        rows += k
        if rows > bound:
            break
        least = c
    return least


def most_frequent(counted: DataFrame, n: str, bound: int) -> DataFrame:
    """The rows with the largest counts: those from some count on, at most `bound`; equal counts are all in or all out."""
    return counted.where(F.col(n) >= least_count(counted, n, bound))


#: A key is hot if it holds more than this share of the rows that meet in a join, so there are at most HOT of them.
HOT = 1000


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, total: int | None = None) -> DataFrame:
    """Inner join of `rows` with `keyed`, which has one row for each key and in `n` the number of rows with that key.

    Hot keys come by a broadcast of at most `HOT` rows, so their rows stay where they are; all others meet by an
    exchange in which no key is hot. `rows` and `keyed` may be read twice and should be settled tables. `n` is dropped.
    """
    bound = (keyed.agg(F.sum(n)).first()[0] or 0) // HOT if total is None else total // HOT
    hot = keyed.where(F.col(n) > bound).drop(n)
    if not hot.take(1):
        return rows.join(keyed.drop(n), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.where(F.col(n) <= bound).drop(n), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)
