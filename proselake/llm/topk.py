"""Exact top-k search: tiled matrix products of query blocks and shards, a partial selection in each tile, a tree of merges.

Queries and candidates are cut into blocks. Each cell of the grid (query block, group of candidate blocks) is one key of a join;
a task walks through the blocks of its cells, one tile at a time, and keeps a list of k for each query. The lists of a query
block then meet in groups of `FAN`, level by level. No task, row or list grows with the number of vectors.
"""

from __future__ import annotations

import heapq
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.llm.shared import batches, settle, table, temporary
from proselake.llm.vectors import BLOCK, BLOCK_CELLS, BLOCK_ROWS, blocked, matrix, usable

K, SCALE, QUERY_STEP = 20, 64, 20
#: Candidate blocks in a cell at most; lists that meet in one merge; queries in a tile.
CELL_BLOCKS, FAN, TILE_QUERIES = 256, 16, 512
#: Of a list's place: a vector with an id, one with a null id, nothing.
KNOWN, NULL, NOTHING = 0, 1, 2

_LISTS = "qb long, part long, ids array<{id}>, n int, found binary, state binary, score binary, exact array<string>"


def _ids(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as 64-bit numbers, and whether each is null."""
    return ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int8)


def best(score: np.ndarray, found: np.ndarray, state: np.ndarray, k: int):
    """Of each row of a table of candidates the k with the highest scores, ties to smaller ids, null ids last."""
    if score.dtype == object:
        order = np.array([sorted(range(len(r)), key=lambda j, r=r, f=f, s=s: (s[j] == NOTHING, -r[j], s[j], f[j]))[:k] for r, f, s in zip(score.tolist(), found.tolist(), state.tolist(), strict=True)], dtype=np.int64).reshape(len(score), -1)
    else:
        order = np.lexsort((found, state, ~score, state == NOTHING))[:, :k]
    return tuple(np.take_along_axis(a, order, 1) for a in (score, found, state))


def tile(q: np.ndarray, own: np.ndarray, c: np.ndarray, ids: tuple[np.ndarray, np.ndarray], k: int):
    """The k best of a block of candidates, which stand in the order of their ids, for each query; `own` is a query's own
    place in the block, or -1. A key of score and place makes all scores differ, so that a partial selection is exact.
    """
    d, m = min(q.shape[1], c.shape[1]), len(c)
    q, c = q[:, :d], c[:, :d]
    most = d * int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) + 1
    kind = np.float64 if most * (m + 1) < 1 << 53 else np.int64 if most * (m + 1) < 1 << 62 else object
    # the key of nothing lies below all others
    low = -(most + 1) * (m + 1)
    key = (q.astype(kind) @ c.astype(kind).T if d else np.zeros((len(q), m), kind)) * m + np.arange(m - 1, -1, -1).astype(kind)
    has = np.flatnonzero(own >= 0)
    key[has, own[has]] = low
    n = min(k, m)
    if kind is object:
        at = np.array([heapq.nlargest(n, range(m), key=r.__getitem__) for r in key.tolist()], dtype=np.int64).reshape(len(q), n)
    else:
        at = np.argpartition(key, m - n, axis=1)[:, m - n :]
    top = np.take_along_axis(key, at, 1)
    state = np.where(top == low, NOTHING, ids[1][at]).astype(np.int8)
    score = (top - (m - 1 - at)) // m if kind is object else np.floor_divide(top.astype(np.int64) - (m - 1 - at), m)
    return score, ids[0][at], state


def _merged(a, b, k: int):
    if a is None:
        return best(*b, k)
    if a[0].dtype != b[0].dtype:
        a, b = ((x[0].astype(object), *x[1:]) for x in (a, b))
    return best(*(np.concatenate(p, axis=1) for p in zip(a, b, strict=True)), k)


def _row(qb: int, part: int, ids: pa.Array, lists) -> pa.RecordBatch:
    score, found, state = lists
    text = None
    if score.dtype == object:
        text, raw = [",".join(map(str, r)) for r in score.tolist()], None
    else:
        raw = score.tobytes()
    cols = [pa.array([qb], pa.int64()), pa.array([part], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([found.shape[1]], pa.int32()), pa.array([found.tobytes()], pa.binary()),
            pa.array([state.astype(np.int8).tobytes()], pa.binary()), pa.array([raw], pa.binary()), pa.array([text], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(cols, ["qb", "part", "ids", "n", "found", "state", "score", "exact"])


def _lists(b, i: int):
    n, text = b.column("n")[i].as_py(), b.column("exact")[i].as_py()
    rows = lambda name, kind: np.frombuffer(b.column(name)[i].as_py(), kind).reshape(-1, n)
    score = rows("score", np.int64) if text is None else np.array([[int(v) for v in t.split(",")] for t in text], dtype=object).reshape(-1, n)
    return score, rows("found", np.int64), rows("state", np.int8)


def _query_rows(it):
    """Each marked vector of the candidate blocks as a row, with its place there."""
    for b in it:
        for i in range(b.num_rows):
            marks = np.frombuffer(b.column("marks")[i].as_py(), np.uint8)
            at = np.flatnonzero(marks)
            if not len(at):
                continue
            x = matrix(b.column("kind")[i].as_py(), b.column("x")[i].as_py(), b.column("wide")[i].as_py(), b.column("dim")[i].as_py())[at]
            wide = x.dtype == object
            cols = [pa.array([b.column("block")[i].as_py()] * len(at), pa.int64()), pa.array(at, pa.int32()), b.column("ids")[i].values.take(pa.array(at)),
                    pa.array([None if wide else r.tobytes() for r in x], pa.binary()), pa.array([",".join(map(str, r)) if wide else None for r in x.tolist()], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["block", "place", "id", "x", "wide"])


def _query_blocks(first: int):
    """One block of queries for each partition, numbered from `first`; shorter vectors are filled up with zeros."""

    def run(it):
        rows = [b for b in it if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows).combine_chunks()
        if t.column("wide").null_count:
            x = [np.frombuffer(v, np.int64) for v in t.column("x").to_pylist()]
            kind = np.int64
        else:
            x = [[int(v) for v in r.split(",")] for r in t.column("wide").to_pylist()]
            kind = object
        dim = max(map(len, x))
        full = np.zeros((len(x), dim), kind)
        for r, v in zip(full, x, strict=True):
            r[: len(v)] = v
        wide = [",".join(map(str, r)) for r in full.tolist()] if kind is object else None
        cols = [pa.array([first + TaskContext.get().partitionId()], pa.int64()), pa.array([t.column("block").to_pylist()], pa.list_(pa.int64())), pa.array([t.column("place").to_pylist()], pa.list_(pa.int32())),
                pa.array([t.column("id").to_pylist()], pa.list_(t.column("id").type)), pa.array([dim], pa.int32()), pa.array([None if wide else full.tobytes()], pa.binary()), pa.array([wide], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(cols, ["qb", "q_block", "q_place", "q_ids", "q_dim", "q_x", "q_wide"])

    return run


def _cells(k: int):
    """Walks through the tiles of cells; a cell's list is given out where the next cell begins."""

    def run(it):
        at, query, lists = None, None, None
        for b in it:
            for i in range(b.num_rows):
                cell = (b.column("qb")[i].as_py(), b.column("part")[i].as_py())
                if cell != at:
                    if lists is not None:
                        yield _row(*at, query[0], lists)
                    if at is None or cell[0] != at[0]:
                        wide = b.column("q_wide")[i].as_py()
                        q = matrix("wide" if wide is not None else "int64", b.column("q_x")[i].as_py(), wide, b.column("q_dim")[i].as_py())
                        q = q if b.column("q_dim")[i].as_py() else np.zeros((len(b.column("q_ids")[i].values), 0), np.int64)
                        query = b.column("q_ids")[i].values, q, b.column("q_block")[i].values.to_numpy(), b.column("q_place")[i].values.to_numpy()
                    at, lists = cell, None
                _, q, block, place = query
                c = matrix(b.column("kind")[i].as_py(), b.column("x")[i].as_py(), b.column("wide")[i].as_py(), b.column("dim")[i].as_py())
                own = np.where(block == b.column("block")[i].as_py(), place, -1)
                ids = _ids(b.column("ids")[i].values)
                got = [tile(q[a : a + TILE_QUERIES], own[a : a + TILE_QUERIES], c, ids, k) for a in range(0, len(q), TILE_QUERIES)]
                if len({g[0].dtype for g in got}) > 1:
                    got = [(g[0].astype(object), *g[1:]) for g in got]
                lists = _merged(lists, tuple(np.concatenate(p) for p in zip(*got, strict=True)), k)
        if lists is not None:
            yield _row(*at, query[0], lists)

    return run


def _level(k: int):
    """Merges the lists of one query block that meet in a group."""

    def run(t: pa.Table) -> pa.Table:
        lists = None
        for i in range(t.num_rows):
            lists = _merged(lists, _lists(t, i), k)
        return pa.Table.from_batches([_row(t.column("qb")[0].as_py(), t.column("part")[0].as_py(), t.column("ids")[0].values, lists)])

    return run


def _ranked(it):
    for b in it:
        for i in range(b.num_rows):
            score, found, state = _lists(b, i)
            there = state != NOTHING
            rank = np.broadcast_to(np.arange(1, found.shape[1] + 1), found.shape)
            of = np.broadcast_to(np.arange(len(found))[:, None], found.shape)[there]
            ids = b.column("ids")[i].values
            vec = pa.array(found[there], mask=state[there] == NULL).cast(ids.type)
            scores = score[there].tolist() if score.dtype == object else score[there]
            fits = pa.array([v if -(1 << 63) <= v < 1 << 63 else None for v in scores], pa.int64()) if score.dtype == object else pa.array(scores, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(rank[there], pa.int32()), vec, fits], ["query_id", "rank", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row that `is_query` marks the `k` other rows with the largest integer inner products: (query_id, rank, vec_id, score).

    Ids are integers. Every row but the query's own is a candidate, repeated rows and rows with the query's id included; each
    of several repeated query rows has a list. Ties go to smaller ids, null ids last; a null id may be found, and no row
    with one is a query unless `is_query` says so. Vectors that are null or hold null or non-finite components take no part; of
    two lengths the shorter counts as filled up with zeros. With fewer than `k` candidates all are given, with no query nothing.
    A score beyond 64 bits is null, while the ranks stay exact. Other columns of the input are not read.
    """
    spark = vectors.sparkSession
    batches(spark, BLOCK_ROWS)
    id_type = vectors.schema[vec_id].dataType.simpleString()
    schema = f"query_id {id_type}, rank int, vec_id {id_type}, score long"
    kept = vectors.where(usable(vector)).select(F.col(vec_id).alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("mark"), F.col(vector).cast("array<double>").alias("v"))
    blocks = settle(kept.mapInArrow(blocked(scale), BLOCK.format(id=id_type)), "blocks")
    rows = settle(blocks.mapInArrow(_query_rows, f"block long, place int, id {id_type}, x binary, wide string"), "queries")
    n_blocks = blocks.count()
    sizes = {r["w"]: (r["n"], r["b"]) for r in rows.groupBy(F.col("wide").isNotNull().alias("w")).agg(F.count("*").alias("n"), F.max(F.coalesce(F.octet_length("x") / 8, F.octet_length("wide"))).alias("b")).collect()}
    if not sizes:
        return spark.createDataFrame([], schema)
    queries, n_query_blocks = None, 0
    for wide, (n, cells) in sorted(sizes.items()):
        count = ceil(n / max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, int(cells)))))
        made = rows.where(F.col("wide").isNotNull() == wide).repartition(count).mapInArrow(
            _query_blocks(n_query_blocks), f"qb long, q_block array<long>, q_place array<int>, q_ids array<{id_type}>, q_dim int, q_x binary, q_wide array<string>")
        # written by itself: within a union the numbers of partitions would be others
        made = settle(made, "query_blocks")
        queries = made if queries is None else queries.unionByName(made)
        n_query_blocks += count
    # cells enough for all tasks, none of them with more blocks than one task should walk through
    parts = min(n_blocks, max(ceil(n_blocks / CELL_BLOCKS), ceil(3 * int(spark.conf.get("spark.sql.shuffle.partitions")) / n_query_blocks)))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    left = queries.withColumn("part", F.explode(upto(parts)))
    right = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts))).withColumn("qb", F.explode(upto(n_query_blocks)))
    lists = left.hint("merge").join(right, ["qb", "part"]).mapInArrow(_cells(k), _LISTS.format(id=id_type))
    while True:
        parts = ceil(parts / FAN)
        lists = lists.withColumn("part", F.expr(f"part div {FAN}")).groupBy("qb", "part").applyInArrow(_level(k), _LISTS.format(id=id_type))
        if parts == 1:
            return lists.mapInArrow(_ranked, schema)


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    with temporary(spark) as done:
        return done(settle(top_k(vectors, F.col("vec_id") % QUERY_STEP == 0)))


OP12_SQL = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
x AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (SELECT a.r AS a, b.r AS b, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM (SELECT x.* FROM x JOIN v USING (r) WHERE vec_id % {QUERY_STEP} = 0) a JOIN x b USING (i) WHERE a.r <> b.r GROUP BY 1, 2)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY s.a ORDER BY score DESC, c.vec_id) AS INTEGER) AS rank, c.vec_id, score
FROM s JOIN v q ON q.r = s.a JOIN v c ON c.r = s.b QUALIFY rank <= {K}"""
