"""Centroid clustering: Lloyd's rounds on integer vectors, distances by one matrix product for each block.

|x|^2 - 2 x.c + |c|^2 is exact in doubles while its terms stay below 2^53, which is checked for each vector by its largest
component; vectors beyond the bound are measured in 64-bit, then in unbounded integers. Sums meet in `treeAggregate`, so
what the driver gets is k sums whatever the number of vectors, and a lost executor costs its own blocks alone, which
are read again from the shared folder.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.llm.shared import batches, settle, table, temporary
from proselake.llm.vectors import BLOCK, blocked, exact, matrix, usable

ROUNDS, CLUSTERS, SCALE, DIM, SEED = 10, 8, 1024, 64, 3


def _within(bound: int, dim: int, most: int) -> int:
    """The largest component for which no step of a squared distance to a centroid of components up to `most` exceeds `bound`."""
    return isqrt(bound // max(1, dim)) - most


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of the nearest centroid, ties to the smaller one, and the squared distance, both exact."""
    dim, most = x.shape[1], max(abs(v) for c in centroids for v in c)
    top = np.abs(x).max(axis=1)
    c = np.array(centroids, dtype=object)
    near, dist = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    small = (top <= _within((1 << 53) - 1, dim, most)).astype(bool)
    middle = ~small & (top <= _within((1 << 63) - 1, dim, most)).astype(bool)
    if small.any():
        xf, cf = x[small].astype(np.float64), c.astype(np.float64)
        d = (xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)
        near[small] = d.argmin(1)
        dist[small] = d.min(1).astype(np.int64)
    for rows, kind in ((middle, np.int64), (~small & ~middle, object)):
        if rows.any():
            xi, ci = x[rows].astype(kind), c.astype(kind)
            d = np.stack([((xi - one) ** 2).sum(1) for one in ci], axis=1)
            near[rows] = np.array([r.argmin() for r in d])
            dist[rows] = d.min(1)
    return near, dist


def _zero(k: int, dim: int):
    return np.zeros((k, dim), object), [0] * k, [0] * k


def _add(a, b):
    return a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)], [x + y for x, y in zip(a[2], b[2], strict=True)]


def _measured(centroids: list[list[int]], dim: int):
    """Adds a block to (sums, counts, inertia), each for every centroid."""

    def step(acc, row):
        x = matrix(row["kind"], row["x"], row["wide"], dim)
        near, dist = nearest(x, centroids)
        # a block has at most 2^12 vectors, so 64-bit sums hold components up to 2^50
        x = x if int(np.abs(x).max()) < 1 << 50 else x.astype(object)
        sums, counts, inertia = _zero(len(centroids), dim)
        for j in np.unique(near).tolist():
            mine = near == j
            sums[j] = x[mine].sum(0).astype(object)
            counts[j], inertia[j] = int(mine.sum()), int(dist[mine].sum())
        return _add(acc, (sums, counts, inertia))

    return step


def _digest(c: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()


def _labelled(centroids: list[list[int]], inertia: list[int], dim: int):
    fits = lambda v: v if v < 1 << 63 else None
    marks, whole = [_digest(c) for c in centroids], sum(inertia)

    def run(it):
        for b in it:
            ids, kinds, xs, wides = (b.column(n) for n in ("ids", "kind", "x", "wide"))
            for i in range(b.num_rows):
                near, dist = nearest(matrix(kinds[i].as_py(), xs[i].as_py(), wides[i].as_py(), dim), centroids)
                cols = [ids[i].values, pa.array(near, pa.int32()), pa.array([fits(int(d)) for d in dist], pa.int64()), pa.array([fits(inertia[j]) for j in near.tolist()], pa.int64()),
                        pa.array([fits(whole)] * len(near), pa.int64()), pa.array([marks[j] for j in near.tolist()])]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: int = SEED, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Cluster, squared distance, inertia and centroid digest of every vector of exactly `dim` finite components.

    Centroids start as the `k` vectors whose ids have the smallest SHA-256 of ``seed:id``; equal ids by their components, null
    ids last. With fewer vectors than `k` each of them starts a centroid; with none the result is empty. Repeated rows count
    and stand in the result each; a null id stays null. Vectors that are null, of another length or not finite are left out.
    A distance or inertia beyond 64 bits is null, while the clusters stay exact. Other columns of the input are not read.
    """
    spark = vectors.sparkSession
    batches(spark, 4096)
    id_type = vectors.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    kept = vectors.where(usable(vector) & (F.size(vector) == dim)).select(F.col(vec_id).alias("vec_id"), F.lit(False).alias("mark"), F.col(vector).cast("array<double>").alias("v"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = [[exact(v, scale) for v in r["v"]] for r in starts]
    if not centroids:
        return spark.createDataFrame([], schema)
    blocks = settle(kept.mapInArrow(blocked(scale), BLOCK.format(id=id_type)), "blocks")
    rows = blocks.select("kind", "x", "wide").rdd
    for _ in range(rounds):
        sums, counts, _ = rows.treeAggregate(_zero(len(centroids), dim), _measured(centroids, dim), _add)
        centroids = [[int(v) // n for v in s] if n else c for s, n, c in zip(sums.tolist(), counts, centroids, strict=True)]
    *_, inertia = rows.treeAggregate(_zero(len(centroids), dim), _measured(centroids, dim), _add)
    return blocks.mapInArrow(_labelled(centroids, inertia, dim), schema)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of the embeddings after ten rounds."""
    with temporary(spark) as done:
        return done(settle(clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))))


def _sql() -> str:
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings "
        f"WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})",
        "x AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v)",
        f"s AS (SELECT v, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c FROM v WHERE vec_id IS NOT NULL QUALIFY c < {CLUSTERS})",
        "c0 AS MATERIALIZED (SELECT c, unnest(v) AS m, generate_subscripts(v, 1) AS i FROM s)",
    ]
    for k in range(ROUNDS + 1):
        parts.append(
            f"a{k} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS n FROM "
            f"(SELECT r, c, CAST(sum((x - m) * (x - m)) AS BIGINT) AS d FROM x JOIN c{k} USING (i) GROUP BY r, c)) WHERE n = 1)"
        )
        if k < ROUNDS:
            parts.append(
                f"c{k + 1} AS MATERIALIZED (SELECT c, i, coalesce(n.m, o.m) AS m FROM c{k} o LEFT JOIN (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM "
                f"(SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{k} JOIN x USING (r) GROUP BY c, i)) n USING (c, i))"
            )
    return (
        "WITH " + ",\n".join(parts) + f",\nh AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)\n"
        "SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 "
        f"FROM a{ROUNDS} JOIN v USING (r) JOIN h USING (c)"
    )


OP13_SQL = _sql()
