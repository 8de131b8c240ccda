"""Ranked search, exact top-k and clustering against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from proselake.llm import lexical, topk, vectors
from proselake.llm.centroids import clusters, nearest
from proselake.llm.lexical import build_index, search, search_shard, term_counts
from proselake.llm.topk import tile, top_k

INF, NAN = float("inf"), float("nan")


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked(docs, items, k):
    """Each item's list by the published scores, in Python's integers."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n, total = len(counts), sum(x[2] for x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, size in counts:
            m = 25 + 75 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                found.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(found)[:k])]
    return out


def test_search(spark, monkeypatch):
    """Small shards and blocks, so that skipping, ties over shards, wide gaps and counts beyond a byte all occur."""
    monkeypatch.setattr(lexical, "QUERY_BYTES", 300)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ärger", "x9", "中文"]
    weights_ = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i if rng.random() < 0.9 else rng.choice([None, 7]), " ".join(rng.choices(vocabulary, weights_, k=rng.choice([0, 1, 3, 30, 200])))) for i in range(500)]
    docs += [(1000, None), (1001, ""), (1002, "--- !?"), (1003, "w1 " * 70_000 + "w2"), (1004, "W3,w3;W3"), (3, docs[3][1]), (3, docs[3][1])]
    items = [(j, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for j in range(25)] + [(90, None), (91, ""), (92, "unseen"), (93, "w3 W3 w3 w7"), (93, "w3 W3 w3 w7"), (None, "w1")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    for shard_docs, block in ((8192, 64), (60, 4)):
        monkeypatch.setattr(lexical, "SHARD_DOCS", shard_docs)
        monkeypatch.setattr(lexical, "BLOCK", block)
        index, n = build_index(d)
        got = [tuple(r) for r in search(index, n, q).collect()]
        key = lambda r: tuple(map(str, r))
        assert sorted(got, key=key) == sorted(ranked(docs, items, 10), key=key)
    index, n = build_index(d.limit(0))
    assert n == 0 and search(index, n, q).count() == 0 and search(build_index(d)[0], 5, q.limit(0)).count() == 0


def test_terms_and_chunks(monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK", 5)
    assert term_counts("Ab ab,AB é-é 12345678901 x") == Counter({b"ab": 3, "é".encode(): 2, b"12345678901": 1, b"x": 1})
    assert term_counts("a" * 100_000) == {b"a" * 100_000: 1} and not term_counts(None)


def test_blocks_are_skipped():
    """A high threshold leaves most blocks of a frequent term compressed, and the result is the same."""
    rng = np.random.default_rng(1)
    shard = lexical._Shard(3000, 60_000)
    for i in range(3000):
        shard.add(i, "common " * int(rng.integers(1, 40)) + ("rare " * 5 if i % 500 == 7 else ""))
    rows = shard.rows(0, __import__("pyarrow").int64()).to_pylist()
    m = np.frombuffer(rows[0]["data"], np.int64)
    lists = {r["term"]: lexical._List(r["last"], r["top"], r["code"], r["data"], r["df"], m) for r in rows[1:]}
    docs, scores, opened = search_shard([(5, lists["common"]), (9000, lists["rare"])], len(m), 3, 1)
    assert opened < len(lists["common"].last) // 3
    full = np.zeros(len(m), np.int64)
    for w, t in ((5, "common"), (9000, "rare")):
        for b in range(len(lists[t].last)):
            doc, worth = lists[t].decompress(b)
            full[doc] += w * worth
    assert sorted(scores, reverse=True)[:3] == sorted(full, reverse=True)[:3] and all(full[x] == s for x, s in zip(docs, scores, strict=True))


def exact(x, scale):
    return math.floor(Fraction(x) * scale)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def nearest_rows(rows, step, k, scale=64):
    kept = [(i, [exact(x, scale) for x in v]) for i, v in rows if usable(v)]
    out = []
    for a, (q, x) in enumerate(kept):
        if q is not None and q % step == 0:
            all_ = sorted((-sum(p * r for p, r in zip(x, y)), i is None, i or 0) for b, (i, y) in enumerate(kept) if b != a)[:k]
            out += [(q, r + 1, None if none else i, -s if -(1 << 63) <= -s < 1 << 63 else None) for r, (s, none, i) in enumerate(all_)]
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_top_k(spark, monkeypatch, kind):
    """Ties, equal rows, null ids, other lengths, huge components; small blocks make many tiles and two levels of merges."""
    rng = random.Random(4)
    rows = [(rng.choice([i, i, i, None, 20]), [rng.choice([-1.5, -0.25, 0.0, 0.5, 1.0]) for _ in range(6)]) for i in range(400)]
    rows += [(500, [0.1] * 3), (520, []), (540, [2.0] * 40), (560, None), (580, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (600, [NAN] * 6), (620, [INF] + [0.0] * 5), (640, [1e30, -1e30, 1.0, 0.0, 0.0, 0.0]), (641, [1e30, 2e29, 1.0, 0.0, 0.0, 0.0]), (660, [3e9] * 6), rows[20], rows[20]]
    if kind == "float":
        rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    d = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, rank string").repartition(3)
    for size in (4096, 16):
        monkeypatch.setattr(vectors, "BLOCK_ROWS", size)
        monkeypatch.setattr(topk, "BLOCK_ROWS", size)
        got = [tuple(r) for r in top_k(d, F.col("vec_id") % 20 == 0, 7).collect()]
        key = lambda r: tuple(map(str, r))
        assert sorted(got, key=key) == sorted(nearest_rows(rows, 20, 7), key=key)
    assert top_k(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0 and top_k(d, F.col("vec_id") < -1).count() == 0
    one = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<double>")
    assert top_k(one, F.col("vec_id") == 20).count() == 0


@pytest.mark.parametrize("most", [3, 1 << 20, 1 << 27, 1 << 40])
def test_tile(most):
    """Each number type of the product, with ties."""
    rng = np.random.default_rng(9)
    q, c = rng.integers(-most, most, (20, 5)), rng.integers(-most, most, (60, 5))
    c[40:] = c[:20]
    own = np.where(np.arange(20) % 3 == 0, np.arange(20), -1)
    score, found, state = tile(q, own, c, (np.arange(60), np.zeros(60, np.int8)), 8)
    for i in range(20):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(q[i], c[j])), j) for j in range(60) if j != own[i])[:8]
        assert sorted((-int(s), int(f)) for s, f, t in zip(score[i], found[i], state[i]) if t == topk.KNOWN) == want


def lloyd(rows, k, rounds, scale, dim, seed):
    kept = [(i, [exact(x, scale) for x in v]) for i, v in rows if usable(v) and len(v) == dim]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for step in range(rounds + 1):
        near = [min(range(len(centroids)), key=lambda j: (far(x, centroids[j]), j)) for _, x in kept]
        if step < rounds:
            groups = {j: [x for (_, x), n in zip(kept, near) if n == j] for j in set(near)}
            centroids = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    dist = [far(x, centroids[j]) for (_, x), j in zip(kept, near)]
    per = Counter()
    for j, d in zip(near, dist):
        per[j] += d
    fits = lambda v: v if v < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, fits(d), fits(per[j]), fits(sum(dist)), sha[j]) for (i, _), j, d in zip(kept, near, dist)]


@pytest.mark.parametrize("huge", [0.0, 3e5, 1e12, 1e30])
def test_clusters(spark, monkeypatch, huge):
    """Doubles, 64-bit and unbounded integers give what Python's integers give; odd rows stay out."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    rng = random.Random(6)
    rows = [(rng.choice([i, i, None, 5]), [rng.gauss(0, 1) + 4 * (i % 3) for _ in range(4)]) for i in range(200)] + [(300, None), (301, [1.0, None, 1.0, 1.0]), (302, [NAN] * 4), (303, [1.0] * 5), (304, []), (305, [INF] * 4), (306, [0.5] * 4), (306, [0.5] * 4)]
    if huge:
        rows += [(400 + i, [huge * rng.uniform(-1, 1) for _ in range(4)]) for i in range(20)]
    d = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    got = [tuple(r) for r in clusters(d, 6, 5, 1024, 4, 3).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(lloyd(rows, 6, 5, 1024, 4, 3), key=key)


def test_few_vectors(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert clusters(d, 8, 3, 1024, 64).count() == 0
    assert sorted(tuple(r)[:3] for r in clusters(d, 8, 3, 1024, 2).collect()) == [(1, 0, 0), (2, 0, 0)]
    near, dist = nearest(np.array([[0, 3], [0, 1]]), [[0, 2], [0, 4], [0, 0]])
    assert near.tolist() == [0, 0] and dist.tolist() == [1, 1]
