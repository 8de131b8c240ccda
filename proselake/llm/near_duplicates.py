"""Near-duplicates: circulant MinHash bands for candidates, exact Jaccard similarity on full shingle sets for links.

1. One pass over the texts gives each row its shingle count, a key of its words, the band hashes of its signature, and
   its words in compressed form. Rows with equal words are one node from here on, however many there are.
2. Nodes that share a band are candidates. Each is compared with the least node of the band first: a star, not pairs,
   in blocks of bounded size that all hold the least node.
3. Components of these links are classes so far. What a star could not link to its centre is compared with all others
   of its band, in blocks of bounded size, so every two nodes that share a band are compared or in one class already.
   For the many copies of one text the work is linear; it grows with the product only for texts that share a band and
   are not alike.
4. The components of all links are the classes.

With 32 bands of 4 coordinates a pair at the threshold of 0.75 shares no band with a probability of 6e-6, one at 0.8
with 5e-8, at every size of the corpus and of the band.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proselake.llm.graph import components
from proselake.llm.shared import batches, held, hot_join, settle, split_count, table
from proselake.llm.shingles import COORDINATES, folded, mix, shingle_sets, signatures

ROWS = 4
#: Nodes and shingles of a chunk, on average; a block holds two chunks, or one small one and the centre of a star.
CHUNK_NODES, STAR_NODES, CHUNK_SHINGLES = 500, 200, 2_000_000


def band_hashes(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash of each band of each signature."""
    n, k = sig.shape
    with np.errstate(over="ignore"):
        parts = sig.reshape(n, k // rows, rows).astype(np.uint64)
        out = np.broadcast_to(np.arange(k // rows, dtype=np.uint64) + np.uint64(1), (n, k // rows)).copy()
        for i in range(rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return out.view(np.int64)


def _described(others: list[str]):
    def run(it):
        import zstandard

        held(("nothing",))
        part, row, squeeze = TaskContext.get().partitionId() << 33, 0, zstandard.ZstdCompressor(level=3)
        for batch in it:
            raw = [None if t is None else t.encode() for t in batch.column("__n_text").to_pylist()]
            texts = [folded(t) for t in raw]
            shingles, edges = shingle_sets(texts)
            n = np.diff(edges)
            bands = band_hashes(signatures(shingles, edges, COORDINATES))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.ravel()))
            cols = [
                pa.array(np.arange(part + row, part + row + len(texts))),
                batch.column("__n_id"),
                pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
                pa.array(n.astype(np.int64)),
                lists,
                pa.array([None if t is None else squeeze.compress(t) for t in raw], pa.binary()),
            ]
            row += len(texts)
            yield pa.RecordBatch.from_arrays([*cols, *(batch.column(o) for o in others)], ["uid", "doc_id", "key", "n", "bands", "body", *others])

    return run


def star_links(shingles: np.ndarray, edges: np.ndarray, percent: int = 75) -> np.ndarray:
    """Which sets after the first are linked with the first: 100 * common >= percent * union, on full sets."""
    n = np.diff(edges)
    owner = np.repeat(np.arange(len(n)), n)
    centre = shingles[: n[0]]  # in ascending order
    at = np.minimum(np.searchsorted(centre, shingles), max(len(centre) - 1, 0))
    common = np.bincount(owner[centre[at] == shingles], minlength=len(n)) if len(centre) else np.zeros(len(n), np.int64)
    return np.flatnonzero(100 * common[1:] >= percent * (n[0] + n[1:] - common[1:])) + 1


def linked_pairs(shingles: np.ndarray, edges: np.ndarray, percent: int = 75, asked=None) -> list[tuple[int, int]]:
    """Links that span the components of a block: 100 * common >= percent * union, on full sets.

    `asked` are the sets that are compared with all others; without it all are.
    """
    m, n = len(edges) - 1, np.diff(edges)
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    owner = np.repeat(np.arange(m), n)
    order = np.argsort(shingles, kind="stable")
    s, by = shingles[order], owner[order]
    new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(s)))
    run = np.repeat(np.arange(len(new)), size)
    run_of = np.empty(len(s), np.int64)
    run_of[order] = run
    out = []
    for a in range(m) if asked is None else asked:
        runs = run_of[edges[a] : edges[a + 1]]
        runs = runs[size[runs] > 1]
        if not len(runs):
            continue
        k = size[runs]
        at = np.repeat(new[runs] - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(k.sum())
        common = np.bincount(by[at], minlength=m)
        common[a] = 0
        for b in np.flatnonzero(100 * common >= percent * (n[a] + n - common)):
            x, y = find(a), find(int(b))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((a, int(b)))
    return out


def _verified(percent: int, star: bool):
    """Links of blocks, each in a row of its own of (cell, i, j): bodies with the `first` ones in front."""

    def run(it):
        import zstandard

        key, ids, texts, firsts, loose = None, [], [], 0, zstandard.ZstdDecompressor()

        def close():
            if len(ids) < 2 or not firsts:
                return []
            shingles, edges = shingle_sets(texts)
            if star:
                return [(ids[0], ids[b]) for b in star_links(shingles, edges, percent)]
            return [(ids[a], ids[b]) for a, b in linked_pairs(shingles, edges, percent, range(firsts))]

        def links(found):
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["u", "v"])

        for batch in it:
            found: list[tuple[int, int]] = []
            keys = list(zip(*(batch.column(n).to_pylist() for n in ("cell", "i", "j")), strict=True))
            for k, uid, first, body in zip(keys, batch.column("uid").to_pylist(), batch.column("first").to_pylist(), batch.column("body"), strict=True):
                if k != key:
                    found += close()
                    key, ids, texts, firsts = k, [], [], 0
                ids.append(uid)
                texts.append(folded(loose.decompress(body.as_py())))
                firsts += first
            yield links(found)
        yield links(close())

    return run


def _compared(cells: DataFrame, rows: DataFrame, percent: int, star: bool) -> DataFrame:
    """(u, v): the links of `cells` (uid, cell, i, j, first). The first of a block are compared with the others."""
    where = ["cell", "i", "j"]
    bodies = cells.join(rows.select("uid", "body"), "uid").repartition(split_count(rows.sparkSession, rows), *where)
    return bodies.sortWithinPartitions(*where, F.desc("first"), "uid").mapInArrow(_verified(percent, star), "u long, v long")


def _chunks(c: str, s: str, nodes: int):
    return F.ceil(F.greatest(F.col(c) / nodes, F.col(s) / CHUNK_SHINGLES)).cast("long")


def _upto(n):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def _stars(members: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Links between the nodes of each band and its least node."""
    pairs = settle(members.where("uid <> least").select("uid", "least").distinct().join(rows.select("uid", "n"), "uid"), "stars")
    centres = settle(pairs.groupBy("least").agg(F.count("*").alias("c"), F.sum("n").alias("s")).select("least", "c", _chunks("c", "s", STAR_NODES).alias("chunks")), "centres")
    around = hot_join(pairs.select("uid", "least"), centres, ["least"], "c").select("uid", F.col("least").alias("cell"), F.pmod(F.xxhash64("uid"), "chunks").alias("i"), F.lit(0).alias("first"))
    middle = centres.select(F.col("least").alias("uid"), F.col("least").alias("cell"), _upto("chunks").alias("i"), F.lit(1).alias("first"))
    return _compared(middle.unionByName(around).withColumn("j", F.lit(0)), rows, percent, star=True)


def _left_over(members: DataFrame, roots: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Links between nodes that the star of a band left in another class than its centre, and the others of the band."""
    own, centre = roots.select(F.col("node").alias("uid"), F.col("root").alias("c_own")), roots.select(F.col("node").alias("least"), F.col("root").alias("c_least"))
    told = members.where("uid <> least").join(own, "uid", "left").join(centre, "least", "left")
    apart = F.coalesce("c_own", "uid") != F.coalesce("c_least", "least")
    told = settle(told.select("band", "uid", "n", apart.alias("apart")), "told")
    left = F.when(F.col("apart"), F.col("n"))
    sums = told.groupBy("band").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.count(left).alias("lc"), F.sum(left).alias("ls"), F.bit_xor(F.xxhash64("uid")).alias("x"))
    # bands with the same nodes are compared once: by number and hash of the nodes, and of those that are apart
    sums = sums.where("c > 1 and lc > 0").groupBy("x", "c", "s", "lc", "ls").agg(F.min("band").alias("band"))
    sizes = settle(sums.select("band", "c", _chunks("c", "s", CHUNK_NODES).alias("others"), _chunks("lc", "ls", CHUNK_NODES).alias("firsts")), "sizes")
    both = hot_join(told.select("band", "uid", "apart"), sizes, ["band"], "c").withColumnRenamed("band", "cell")
    first = both.where("apart").select("uid", "cell", F.pmod(F.xxhash64("uid"), "firsts").alias("i"), _upto("others").alias("j"), F.lit(1).alias("first"))
    other = both.select("uid", "cell", _upto("firsts").alias("i"), F.pmod(F.xxhash64("uid"), "others").alias("j"), F.lit(0).alias("first"))
    cells = first.unionByName(other).groupBy("uid", "cell", "i", "j").agg(F.max("first").alias("first"))
    return _compared(cells, rows, percent, star=False)


def _classified(docs: DataFrame, doc_id: str, text: str, percent: int, others: list[str]) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id, key, n, body and the renamed `others` of each row; key, its rows c, class and component_id of each node)."""
    spark = docs.sparkSession
    batches(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("__n_id"), F.col(text).alias("__n_text"), *(F.col(c).alias(f"__n_{i}") for i, c in enumerate(others)))
    schema = T.StructType([*T.StructType.fromDDL("uid long, doc_id long, key binary, n long, bands array<long>, body binary"), *source.schema[2:]])
    rows = settle(source.mapInArrow(_described([f"__n_{i}" for i in range(len(others))]), schema), "rows")
    some = rows.where("n > 0")
    nodes = settle(some.groupBy("key").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least_id"), F.count("*").alias("c")), "nodes")
    own = some.select("uid", "n", "bands").join(nodes.select(F.col("node").alias("uid")), "uid", "left_semi")
    banded = own.select(F.explode("bands").alias("band"), "uid", "n")
    shared = settle(banded.groupBy("band").agg(F.min("uid").alias("least"), F.count("*").alias("c")).where("c > 1"), "shared")
    members = settle(hot_join(banded, shared, ["band"], "c"), "members")
    links = settle(_stars(members, rows, percent), "links")
    roots = components(links)
    more = settle(_left_over(members, roots, rows, percent), "more")
    if more.take(1):
        roots = components(links.union(more))
    classes = nodes.join(roots.withColumnRenamed("root", "class"), "node", "left").select("key", "c", "least_id", F.coalesce("class", "node").alias("class"))
    classes = settle(classes, "classes")
    names = classes.groupBy("class").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n_nodes"))
    return rows, settle(hot_join(classes, names, ["class"], "n_nodes").select("key", "c", "class", "component_id"), "named")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing, not even with each
    other. Repeated rows give a row each. A null id takes part in links but never names a component, and is not kept
    if its component has another id. Other columns are not read.
    """
    rows, named = _classified(docs, doc_id, text, percent, [])
    linked = hot_join(rows.where("n > 0").select("doc_id", "key", "n"), named.drop("class"), ["key"], "c").select("doc_id", "n", "component_id")
    full = linked.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id").withColumn(
        "kept", F.when(F.col("component_id").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def _restored(names: list[str], text: str):
    def run(it):
        import zstandard

        loose = zstandard.ZstdDecompressor()
        for batch in it:
            texts = [None if b is None else loose.decompress(b).decode() for b in batch.column("body").to_pylist()]
            others = iter(batch.schema.names[1:])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text else batch.column(next(others)) for n in names], names)

    return run


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """`docs` with exactly one row of each class: the one with the least id, of repeated ids the first.

    Rows without words all stay, as they are linked with nothing. All columns stay as they are.
    """
    others = [c for c in docs.columns if c != text]
    rows, named = _classified(docs, doc_id, text, percent, others)
    last = F.lit((1 << 63) - 1)
    first = hot_join(rows.where("n > 0").select("uid", "doc_id", "key"), named.drop("component_id"), ["key"], "c").groupBy("class").agg(F.min(F.struct(F.coalesce("doc_id", last), "uid")).alias("s"))
    stay = first.select(F.col("s.uid").alias("uid")).union(rows.where("n = 0").select("uid"))
    kept = rows.join(stay, "uid", "left_semi").select("body", *(f"__n_{i}" for i in range(len(others))))
    return kept.mapInArrow(_restored(docs.columns, text), docs.schema)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Exact classes over all pairs that share a shingle, for small tables: ends in ``near(doc_id, n_shingles, component_id, kept)``.
NEAR_SQL = r"""
n_words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {docs}),
n_sets AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM n_words WHERE len(w) > 0)),
n_sizes AS (SELECT doc_id, count(*) AS n FROM n_sets GROUP BY doc_id),
n_links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM n_sets x JOIN n_sets y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n_sizes p ON p.doc_id = x.doc_id JOIN n_sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
n_reach AS (SELECT a AS doc_id, a AS r FROM n_links UNION SELECT b, n_reach.r FROM n_reach JOIN n_links ON n_links.a = n_reach.doc_id),
n_least AS (SELECT doc_id, min(r) AS r FROM n_reach GROUP BY doc_id),
near AS (SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.r, w.doc_id) AS component_id, w.doc_id = coalesce(l.r, w.doc_id) AS kept
  FROM n_words w LEFT JOIN n_sizes s USING (doc_id) LEFT JOIN n_least l USING (doc_id))"""

OP1_SQL = f"WITH RECURSIVE {NEAR_SQL.format(docs='documents')} SELECT doc_id, n_shingles, component_id, kept FROM near"
