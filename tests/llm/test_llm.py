import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proselake.llm import near_duplicates as near
from proselake.llm import queries as Q
from proselake.llm import repeats, shared, urls
from proselake.llm.binary import PerfectHash, key_codes, read_ids, write_ids
from proselake.llm.decontaminate import decontaminate, scan, uncontaminated, windows
from proselake.llm.decontaminate import words as split_words
from proselake.llm.licenses import TEXTS, inherit, scanned
from proselake.llm.near_duplicates import drop_near_duplicates, near_duplicates
from proselake.llm.packing import pack, plan
from proselake.llm.pieces import PieceIds
from proselake.llm.quality import JUDGED_SQL, quality
from proselake.llm.sharding import ring, shard, walk
from proselake.llm.shared import hot_join, most_frequent
from proselake.llm.suffixes import repeated_windows, suffix_array
from proselake.llm.tokens import token_counts
from proselake.llm.urls import Segmenter, filter_urls, parts, rule_of

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key string, n long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 7)))
    base = [word() for _ in range(150)]
    near = list(base)
    near[70] = "changed"
    long = " ".join(word() for _ in range(9000))
    rows = [(None, None, "k", 1), (1, "", "k", 2), (2, " \n ", "k", 3), (3, " ".join(base), "k", 4), (4, " ".join(near), None, 5), (5, " ".join(base).upper(), "k", 6),
            (6, long, "k", 7), (7, "<|endoftext|> ▁ é 中文 <s>", "k", None), (7, "<|endoftext|> ▁ é 中文 <s>", "k", None), (8, "a b", "k", 8), (None, " ".join(base), "k", 9)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(200):
        x = [rng.randint(0, rng.choice([1, 3, 9])) for _ in range(rng.randint(1, 50))]
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_repeated_windows():
    rng = random.Random(3)
    base = b"".join(bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 8))) + b" " for _ in range(100))
    segs = [base[a : a + 260] for a in (0, 3, 50, 90)] + [b"x" * 230]
    count = Counter(s[j : j + 200] for s in segs for j in range(len(s) - 199))
    for s, hit in zip(segs, repeated_windows([0] * len(segs), segs), strict=True):
        assert hit.tolist() == [count[s[j : j + 200]] > 1 for j in range(len(s) - 199)]


def removed(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + 200] for x in data for i in range(len(x) - 199))
    for x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - 199):
            if count[x[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        yield len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest()


@pytest.mark.parametrize("frequent", [2000, 1])
def test_repeats(spark, docs, monkeypatch, frequent):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    got = repeats.remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    data = docs.select("doc_id", "text").collect()
    assert rows(got) == sorted([(r["doc_id"], *w) for r, w in zip(data, removed([r["text"] for r in data]), strict=True)], key=str)
    assert repeats.drop_repeats(docs).count() == docs.count()


def test_repeats_in_large_cells(spark, monkeypatch):
    monkeypatch.setattr(repeats, "FREQUENT", 20)
    monkeypatch.setattr(repeats, "BLOCK", 3000)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 7)))
    some = lambda: " ".join(word() for _ in range(60))
    passage, longer = some()[:160], some()[:230]
    texts = [f"{some()} {passage if i % 3 else longer} {some()}" for i in range(90)]
    texts += [t[: len(t) // 2 + 150] for t in texts[:6]] + texts[:2]
    sizes, split = [], repeats.by_size

    def recorded(parts, block):
        out = split(parts, block)
        sizes.extend([max((r[1] for r in d.groupBy("cell").agg(F.sum(F.length("part"))).collect()), default=0) for d in out])
        return out

    monkeypatch.setattr(repeats, "by_size", recorded)
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert rows(got) == sorted([(i, *w) for i, w in enumerate(removed(texts))], key=str)
    # what is left for suffix arrays is bounded, and there was a cell over the bound
    assert sizes[0] <= 3000 < sizes[1]


def test_near_duplicates(spark, docs):
    got = rows(near_duplicates(docs))
    assert (4, 146, 3, False) in got and (3, 146, 3, True) in got and (5, 146, 3, False) in got and (None, 146, 3, False) in got
    assert (None, 0, None, True) in got and (1, 0, 1, True) in got and (8, 1, 8, True) in got
    assert sorted(str(r["doc_id"]) for r in drop_near_duplicates(docs).collect()) == ["1", "2", "3", "6", "7", "8", "None"]


def classes_of(texts):
    sets = [set(shingles(t)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def shingles(text):
    w = [x for x in re.split("[\\x20\\x09-\\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


@pytest.mark.parametrize(("nodes", "star"), [(500, 200), (15, 4)])
def test_large_families(spark, monkeypatch, nodes, star):
    monkeypatch.setattr(near, "CHUNK_NODES", nodes)
    monkeypatch.setattr(near, "STAR_NODES", star)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    texts = []
    for _ in range(3):
        base = [word() for _ in range(60)]
        for _ in range(70):
            t = list(base)
            for _ in range(rng.choice([1, 1, 2, 3, 4])):
                t[rng.randrange(60)] = word()
            texts.append(" ".join(t))
    t = [word() for _ in range(80)]
    for k in range(40):  # a chain, linked only from one to the next ones
        t = list(t)
        t[k] = word()
        texts.append(" ".join(t))
    rng.shuffle(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(d).collect()} == classes_of(texts)


def test_hot_join(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT", 3)
    rows_ = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 2), ("d", 3)], "k string, v int")
    keyed = rows_.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m")).where("k <> 'd'")
    got = hot_join(rows_, keyed, ["k"], "n")
    assert sorted(map(tuple, got.select("k", "v", "m").collect())) == sorted([("a", i, 49) for i in range(50)] + [("b", 1, 1), ("c", 2, 2)])


def test_held():
    made = []
    get = lambda key, room=1: shared.held(key, lambda: made.append(key) or key, room)
    for key, room in ((("a", 1), 1), (("a", 1), 1), (("a", 2), 1), (("a", 1), 1), (("b", 1), 2), (("b", 2), 2), (("b", 1), 2), (("b", 3), 2), (("b", 2), 2), (("b", 1), 2)):
        assert get(key, room) == key
    assert made == [("a", 1), ("a", 2), ("a", 1), ("b", 1), ("b", 2), ("b", 3), ("b", 1)]
    assert shared.held(("nothing",)) is None and not shared._HELD


def test_most_frequent(spark):
    rng = random.Random(1)
    counts = [int(1.2 ** rng.randint(0, 60)) for _ in range(2000)]
    d = spark.createDataFrame(list(enumerate(counts)), "k int, n long")
    for bound in (0, 1, 50, 700, 5000):
        got = sorted(r["n"] for r in most_frequent(d, "n", bound).collect())
        assert len(got) <= bound and got == sorted(counts)[len(counts) - len(got) :]
        # what is left out would not have fitted, but for one class of equal or nearly equal counts
        rest = sorted(counts)[: len(counts) - len(got)]
        assert not rest or len(got) + sum(c > rest[-1] * 15 / 16 for c in rest) > bound
    assert most_frequent(d.where("false"), "n", 5).count() == 0


def test_piece_ids():
    rng = random.Random(11)
    bits = [" ", " ", " ", "\n", "\t", "\r\n", "\xa0", "\u3000", "\u2009", "\x85", "\x1c", "a", "b", "Z", "é", "ß", "×", "Σ", "İ", "中", "'s", "'", "'ll", ",", ".", "...", "&&&", "$", "1", "23", "\u0301", "≠", "😀", "<|endoftext|>", "the", "word", "_", "-", "\0"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["x" * 200 + " y" + "é" * 90, " " * 300, "\n" * 99 + "a", ""]
    for name, keeps_white in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        for store in (100_000, 300):
            e = PieceIds(public_tokenizers.path(name), keeps_white, store)
            got = [x.tolist() for b in range(0, len(texts), 700) for x in e.ids(pa.array(texts[b : b + 700], pa.string()))]
            assert got == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark, docs):
    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    seq = defaultdict(list)
    for r in out:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in seq.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == Counter(p for r in docs.collect() for p in pieces_of(r["doc_id"], r["text"]))


def pieces_of(doc_id, text):
    ids = [*tokenizer("byte_bpe_50k.json").encode(text or "", add_special_tokens=False).ids, 2]
    first = len(ids) % 1024 or 1024
    edges = [0, *range(first, len(ids) + 1, 1024)]
    return [(doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


@cache
def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_plan():
    rng = random.Random(4)
    lengths = [rng.choice([1024, rng.randint(1, 256), rng.randint(1, 256), rng.randint(257, 1023)]) for _ in range(6000)]
    cases = {"mixed": dict(Counter(lengths)), "many": {k: 1000 * n for k, n in Counter(lengths).items()}, "full": {1024: 5}, "short": {3: 9000}, "none": {}, "one": {300: 1}, "few": {600: 100, 500: 3}}
    for name, hist in cases.items():
        p = plan(hist)
        places = defaultdict(list)
        for length, rank, count, first, offset in p.rows:
            places[length].append((rank, count))
        for length, n in hist.items():
            # ranks of a length are given out once each
            at = 0
            for rank, count in sorted(places[length]):
                assert rank == at
                at += count
            assert at == n
        if name != "many":
            room = defaultdict(list)
            for length, _, count, first, offset in p.rows:
                for i in range(count):
                    room[first + i].append((offset, length))
            assert sorted(room) == list(range(p.next))
            for v in room.values():
                at = 0
                for offset, length in sorted(v):
                    assert offset == at
                    at += length
                assert at <= 1024
        if name in ("mixed", "many"):
            large = sum(n for k, n in hist.items() if 256 < k < 1024)
            assert p.in_configurations >= 0.99 * large and p.next <= 1.01 * sum(k * n for k, n in hist.items()) / 1024 + 1


def test_token_counts(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted([(r["doc_id"], len((r["text"] or "").encode()), len(sp.encode(r["text"] or "")), len(sp.encode(r["text"] or "")) > 4096) for r in docs.collect()], key=str)
    assert rows(token_counts(docs, path)) == want


def test_binary(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = read_ids(write_ids(docs, path, 1)).collect()
    want = Counter((r["doc_id"], zlib.crc32(np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in docs.collect())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want
    at = 0
    in_order = sorted(got, key=lambda r: r["start"])
    for r in in_order:
        assert r["start"] == at
        at += r["n_tokens"]
    # null ids come first
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in in_order]
    assert keys == sorted(keys)


def test_perfect_hash():
    codes, _ = key_codes(list(range(5000)))
    assert sorted(PerfectHash.of(codes)[codes].tolist()) == list(range(5000))


def test_sharding(spark, docs):
    out = shard(docs, 4, 16).collect()
    n = Counter(r["shard"] for r in out)
    assert max(n.values()) - min(n.values()) <= 1 and len(out) == docs.count()
    for s, k in n.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(k))


@pytest.mark.parametrize(("shards", "virtual", "slack"), [(4, 8, 0.0), (8, 128, 0.0), (5, 3, 0.3)])
def test_sharding_by_a_plain_walk(spark, shards, virtual, slack):
    """Row by row around the ring: to the next point's shard while it has room, the others on to the next one with room."""
    rng = random.Random(shards)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 20))) for _ in range(700)] + ["same"] * 300 + [None]
    d = spark.createDataFrame([(i if i < 800 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    t = F.coalesce("text", F.lit(""))
    placed = d.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc")).withColumn("p", F.xxhash64("doc_id", "size", "crc"))
    points = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "little", signed=True), s) for s in range(shards) for v in range(virtual))
    # arc by arc from the first point on; its arc holds what lies beyond the last point too
    arc_of = lambda p: bisect_left([x for x, _ in points], p) % len(points)
    todo = sorted((arc_of(r["p"]), r["p"], r["doc_id"], r["size"], r["crc"]) for r in placed.collect())
    room = [-(-len(todo) * (10 + round(slack * 10)) // (10 * shards)) if slack else len(todo) // shards + (s < len(todo) % shards) for s in range(shards)]
    want, over = [], []
    for arc, _, *row in todo:
        if room[points[arc][1]]:
            room[points[arc][1]] -= 1
            want.append((*row, points[arc][1]))
        else:
            over.append((arc, row))
    for arc, row in over:
        s = next(points[(arc + k) % len(points)][1] for k in range(1, len(points) + 1) if room[points[(arc + k) % len(points)][1]])
        room[s] -= 1
        want.append((*row, s))
    out = shard(d, shards, virtual, slack).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in out) == Counter(want)
    for s in range(shards):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(w[-1] == s for w in want)))


def test_sharding_of_copies(spark):
    texts = [None, "", "é", "x" * 9000] + ["same"] * 300
    d = spark.createDataFrame([(i if i < 150 else 7, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    out = shard(d).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in d.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    n = Counter(r["shard"] for r in out)
    assert max(n.values()) - min(n.values()) <= 1 and all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(k)) for s, k in n.items())


def moved(rows_, slack):
    """The share of rows that change their shard when a ninth one comes, by the walk alone."""
    rng = np.random.default_rng(3)
    at = np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, rows_))
    own = []
    for shards in (8, 9):
        points, owner = ring(shards)
        arc = np.searchsorted(points, at) % len(points)
        order = np.argsort(arc, kind="stable")
        counts = np.bincount(arc, minlength=len(points))
        base = np.concatenate(([0], np.cumsum(counts)[:-1]))
        to = np.full(rows_, -1)
        for a, rank, n, s, _ in walk(counts.tolist(), owner, shards, slack):
            to[order[base[a] + rank : base[a] + rank + n]] = s
        assert (to >= 0).all()
        own.append(to)
    return float((own[0] != own[1]).mean())


def test_movement_on_growth():
    # a ninth of the rows has to move to the ninth shard; bounds make more of them move, and slack fewer
    tight, loose = moved(100_000, 0.0), moved(100_000, 0.25)
    assert 1 / 9 <= loose < 0.2 and loose < tight < 0.35


def test_urls(spark):
    assert parts("HTTP://A.Net/x?y") == ("a.net", "/x") and parts(None) == ("", "")
    assert rule_of("b.example.net", "/en/1") == ("example.net/en/", "allow") and rule_of("example.net", "") == (None, None)
    assert Segmenter({"cheap": 9, "pills": 9, "ch": 1}).split("cheappills") == ("cheap", "pills")
    odd = ["HTTP://ÀB.Net?x", "a://b://c/d", "://", "x:/y", "a://", "p\nq://R.org#z", None, ""]
    got = spark.createDataFrame([(u,) for u in odd], "url string").select(urls._host("url")).collect()
    assert [r[0] for r in got] == [parts(u)[0] for u in odd]
    pages = spark.createDataFrame([(1, "http://x.net/a", "<p>x y"), (2, "http://x.org/fr/", None), (3, None, ""), (3, "nothing", "")], "page_id long, url string, html string")
    got = {(r["page_id"], r["host"]): r["verdict"] for r in filter_urls(pages).collect()}
    assert got[1, "x.net"] == "block" and got[2, "x.org"] == "allow" and len(got) == 3


def test_urls_beyond_the_broadcasts(spark, monkeypatch):
    slug = "a" * 70
    text = "<p>" + "cheap " * 9 + "pills " * 8 + "good " * 7 + "books " * 6
    rows_ = [(i, f"http://cheappills{i % 3}.net/sale/{slug}x", text) for i in range(6)] + [(10 + i, f"http://goodbooks.org/fr/read/{slug}y", text) for i in range(5)]
    rows_ += [(20, "http://cheappills.info/", ""), (21, "http://goodbooks.info/", ""), (22, f"http://q.info/{slug}y", ""), (23, f"http://q.info/{slug}x", ""), (23, f"http://q.info/{slug}x", ""), (None, None, None)]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string")
    model = Segmenter({"cheap": 99, "pills": 88, "good": 77, "books": 66})
    seen = [(i, *parts(u)) for i, u, _ in rows_]
    taught = {v: [t for _, h, p in seen if rule_of(h, p)[1] == v for t in model.tokens(h, p)] for v in ("block", "allow")}
    pages_of = Counter(rule_of(h, p)[1] for _, h, p in seen)
    size, count = len(set(taught["block"]) | set(taught["allow"])) + 1, {v: Counter(t) for v, t in taught.items()}
    want = []
    for i, h, p in seen:
        score = np.log((pages_of["block"] + 1) / (pages_of["allow"] + 1)) + sum(np.log((count["block"][t] + 1) / (len(taught["block"]) + size)) - np.log((count["allow"][t] + 1) / (len(taught["allow"]) + size)) for t in model.tokens(h, p))
        want.append((i, rule_of(h, p)[1] or ("block" if score > 0 else "allow")))
    assert {(20, "block"), (21, "allow"), (22, "allow"), (23, "block")} <= set(want)
    for bound in (100_000, 1):
        monkeypatch.setattr(urls, "VOCABULARY", bound)
        monkeypatch.setattr(urls, "FEATURES", bound)
        assert rows(filter_urls(pages).select("page_id", "verdict")) == sorted(want, key=str)
    assert filter_urls(pages.where("false")).count() == 0


def test_licenses(spark):
    files = spark.createDataFrame([("a/LICENSE", "Released under the MIT License."), ("a/b/c.py", "x = 1"), ("a/b/d.py", "Licensed under the Apache License, Version 2.0."), ("e.py", None), (None, "")], "path string, text string")
    got = {r["path"]: (r["license"], r["license_from"]) for r in inherit(scanned(files)).collect()}
    assert got == {"a/LICENSE": ("MIT", None), "a/b/c.py": ("MIT", "a"), "a/b/d.py": ("Apache-2.0", None), "e.py": (None, None), None: (None, None)}


def test_license_blocks(spark):
    line = "Licensed under the Apache License, Version 2.0."
    prose = "we walked by the river and nobody there could say which licence the old ferry had been given that summer or who had paid for it"
    mit = "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + TEXTS["MIT"][0].replace(", ", ",\n")
    texts = {"lines": f"{line}\n{prose}\n{prose}", "run": f"{prose} {line} {prose} {prose}", "mit": mit, "mit within": f"{prose}\n{mit}\n{prose}", "spdx": f"# SPDX-License-Identifier: MIT\n{prose}",
             "mention": prose, "other": "SPDX-License-Identifier: Unlicense", "copyright": "Copyright 2020 A. Person. All rights reserved."}
    got = {r["path"]: (r["own_license"], r["cosine_milli"]) for r in scanned(spark.createDataFrame(list(texts.items()), "path string, text string")).collect()}
    assert got["lines"] == got["run"] == ("Apache-2.0", 1000) and got["spdx"] == ("MIT", 1000)
    assert got["mit"][0] == got["mit within"][0] == "MIT" and min(got["mit"][1], got["mit within"][1]) >= 950
    assert got["mention"] == got["other"] == got["copyright"] == (None, None)


#: Headers as files bear them, with the licence that a reader would name; None where the text names none.
HEADERS = [
    ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0", "Apache-2.0"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "Apache-2.0"),
    ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/", "MPL-1.1"),
    (" * The contents of this file are subject to the Mozilla Public License Version\n * 1.1 (the \"License\"); you may not use this file except in compliance with\n * the License.", "MPL-1.1"),
    ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */", "MPL-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("Copyright (c) 2001 B. Writer\n\nPermission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", None),
    ("You may not use this file except in compliance with the License.", None),
    ("See the License for the specific language governing permissions and limitations under the License.", None),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", None),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", "GPL-3.0"),
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.", "GPL-2.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\nCopyright (C) 1991, 1999 Free Software Foundation, Inc.", "LGPL-2.1"),
    ("GNU LIBRARY GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1991 Free Software Foundation, Inc.", "LGPL-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 1, February 1989\n\nCopyright (C) 1989 Free Software Foundation, Inc.", "GPL-1.0"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.", "AGPL-3.0"),
    ("Permission is granted to copy, distribute and/or modify this document\nunder the terms of the GNU Free Documentation License, Version 1.3\nor any later version published by the Free Software Foundation;\nwith no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.", "GFDL-1.3"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"), ("// Licensed under CC0 1.0 Universal.", "CC0-1.0"), ("Released under the MIT License.", "MIT"), ("Released under the ISC License.", "ISC"),
    *((f"SPDX-License-Identifier: {x}", x) for x in ("Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MPL-1.1", "MPL-2.0", "CC-BY-4.0", "CC0-1.0")), ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("SPDX-License-Identifier: LGPL-3.0-only", "LGPL-3.0"),
    ("SPDX-License-Identifier: Zlib", None), ("SPDX-License-Identifier: LicenseRef-Own", None), ("Copyright (c) 2019 The Authors. All rights reserved.", None), ("This software is provided under a commercial license; ask our sales staff for terms.", None),
    ("Boost Software License - Version 1.0 - August 17th, 2003", None), ("Eclipse Public License - v 2.0", None), ("The driving licence was lost, and no copyright was ever claimed for the song.", None),
    ("This is free and unencumbered software released into the public domain. For more information, please refer to the Unlicense.", None),
]


def test_license_headers(spark):
    """Bare, and within other text before and after: no header is taken for another licence, and at most one in twenty is missed."""
    prose = "we walked along the river until it was dark and then somebody told the old story of the ferry again"
    files = [(f"{i}/{kind}", body) for i, (text, _) in enumerate(HEADERS) for kind, body in (("bare", text), ("run", f"{prose} {text} {prose}"), ("lines", f"{prose}\n\n{text}\n\n{prose}"))]
    files += [(f"{i}/full", v[0]) for i, v in enumerate(TEXTS.values(), 1000)]
    got = {r["path"]: r["own_license"] for r in scanned(spark.createDataFrame(files, "path string, text string")).collect()}
    want = {p: HEADERS[int(p.split("/")[0])][1] if int(p.split("/")[0]) < 1000 else list(TEXTS)[int(p.split("/")[0]) - 1000] for p, _ in files}
    wrong = {p: (got[p], want[p]) for p in want if got[p] is not None and got[p] != want[p]}
    missed = [p for p in want if want[p] and got[p] is None]
    assert not wrong, wrong
    assert len(missed) <= len([p for p in want if want[p]]) // 20, missed


def test_decontaminate(spark):
    item = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, f"Before. {item.upper()}! After", "x"), (2, "clean text", None), (3, None, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["text"] for r in decontaminate(d, spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")).collect()}
    assert got == {1: "Before. ! After", 2: "clean text", 3: None}


def test_quality(spark, docs):
    got = {r["doc_id"]: r for r in quality(docs).collect()}
    assert got[1]["base_failed"] and got[2]["n_words"] == 0 and got[6]["n_words"] == 9000 and got[None]["n_dup_lines"] == 0


def test_empty_tables(spark, docs):
    none = docs.where("false")
    byte = public_tokenizers.path("byte_bpe_50k.json")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    files = spark.createDataFrame([], "path string, text string")
    for out in (near_duplicates(none), drop_near_duplicates(none), repeats.remove_repeats(none), pack(none, byte), shard(none), quality(none), token_counts(none, public_tokenizers.path("piece_bpe_32k.model")),
                read_ids(write_ids(none, public_tokenizers.path("word_bpe_49k.json"), 1)), filter_urls(pages), scan(none, items), uncontaminated(none, items), inherit(scanned(files))):
        assert out.count() == 0
    assert uncontaminated(docs, items.where("false")).count() == docs.count()


def test_clashing_names(spark):
    names = ["__d_items", "__d_hits", "__d_words", "__d_text", "c_0", "rest", "n", "uid", "key", "bands", "body", "size", "shard", "notes", "runs", "h", "did"]
    text = "one two three four five six seven eight nine ten eleven twelve"
    d = spark.createDataFrame([(i, t, *["v"] * len(names)) for i, t in enumerate([text, text, None, "other words"])], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    for out, kept in ((uncontaminated(d, items), 2), (decontaminate(d, items), 4), (drop_near_duplicates(d), 3), (repeats.drop_repeats(d), 4)):
        assert out.columns == d.columns and out.count() == kept and out.where("n = 'v' AND __d_hits = 'v' AND rest = 'v'").count() == kept
    assert scan(d, items).where(F.size("__d_hits") > 0).count() == 2
    files = spark.createDataFrame([("a/LICENSE", "Released under the MIT License.", 5, "x", 7, "y"), ("a/b", "z", 6, "x", 8, "y")], "path string, text string, n int, license string, depth int, keep string")
    got = {r["path"]: r for r in inherit(scanned(files)).collect()}
    assert (got["a/b"]["license"], got["a/b"]["depth"], got["a/b"]["n"], got["a/b"]["keep"]) == ("MIT", 1, 6, "y")
    pages = spark.createDataFrame([(1, "http://x.net/a", "<p>x", "v", "v")], "page_id long, url string, html string, host string, verdict string")
    assert filter_urls(pages).first()["verdict"] == "block"


def test_ties_repeats_and_long_texts(spark):
    item = " ".join(f"w{i}" for i in range(12))
    long = "é " * 200_000 + item
    d = spark.createDataFrame([(1, long), (1, long), (2, item.upper())], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, item), (None, item), (8, "w3 w4"), (9, ""), (10, None)], "item_id long, text string")
    got = [(r["doc_id"], len(r["__d_hits"]), r["__d_items"], r["__d_words"]) for r in scan(d, items).collect()]
    assert sorted(got) == [(1, 4, ["7", "8", "None"], 200_012)] * 2 + [(2, 4, ["7", "8", "None"], 12)]
    # of two licence files the first by name counts where cosines are equal
    line = {k: f"SPDX-License-Identifier: {k}" for k in ("MIT", "MPL-2.0")}
    files = spark.createDataFrame([("a/LICENSE", line["MPL-2.0"]), ("a/COPYING", line["MIT"]), ("a/x", "y " * 100_000), ("a/x", "y"), ("z/LICENSE", "word " * 50_000 + line["MIT"])], "path string, text string")
    found = scanned(files).collect()
    best = {r["path"]: (r["own_license"], r["cosine_milli"]) for r in found}
    assert best["a/LICENSE"][0] == "MPL-2.0" and best["z/LICENSE"] == ("MIT", 1000)
    first = min((-c, k) for k, c in (best["a/LICENSE"], best["a/COPYING"]))[1]
    assert [r["license"] for r in inherit(scanned(files)).where("path = 'a/x'").collect()] == [first] * 2
    # equal pages get equal verdicts, however long
    pages = spark.createDataFrame([(1, "http://" + "q" * 5000 + ".info/" + "z" * 5000, None)] * 2 + [(2, "http://a.net/", ""), (3, "http://a.org/fr/", "")], "page_id long, url string, html string")
    got = Counter((r["page_id"], r["verdict"]) for r in filter_urls(pages).collect())
    assert set(got.values()) == {1, 2} and got[2, "block"] == got[3, "allow"] == 1


def test_many_directories(spark):
    rng = random.Random(3)
    paths = ["/".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) + "/" + rng.choice(["LICENSE", "x.py", "y.py"]) for _ in range(150)] + ["LICENSE", "top.py", "a/LICENSE"]
    rows_ = [(p, f"SPDX-License-Identifier: {rng.choice(['MIT', 'Apache-2.0'])}" if p.endswith("LICENSE") and rng.random() < 0.7 else "x") for p in paths]
    found = scanned(spark.createDataFrame(rows_, "path string, text string")).collect()
    given = {}
    for r in found:
        if r["path"].rpartition("/")[2] == "LICENSE" and r["own_license"]:
            up = r["path"].rpartition("/")[0]
            given[up] = min(given.get(up, (0, "~")), (-r["cosine_milli"], r["own_license"]))
    want = Counter()
    for r in found:
        up = r["path"].rpartition("/")[0]
        chain = [up.rsplit("/", k)[0] for k in range(up.count("/") + 1)] + [""]
        near_ = next((u for u in chain if u in given), None)
        want[r["path"], r["own_license"] or (near_ is not None and given[near_][1]) or None, None if r["own_license"] else near_] += 1
    got = inherit(scanned(spark.createDataFrame(rows_, "path string, text string"))).collect()
    assert Counter((r["path"], r["license"], r["license_from"]) for r in got) == want


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = Q.QUERIES[name](spark, SF)
    want = con.sql(Q.SQL[name])
    at = [want.columns.index(c) for c in got.columns]
    assert rows(got) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_pipeline(spark, tmp_path):
    """All five stages against plain versions of them."""
    import corpus_pipeline as P

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    some = lambda n: " ".join(rng.choice([word(), word(), "the", "and", "of"]) for _ in range(n))
    passage, item = some(60), some(14)
    texts = [some(rng.randint(60, 400)) for _ in range(25)]
    texts += [f"{some(80)} {passage} {some(80)}\n{some(9)}" for _ in range(4)] + [f"{some(90)} {item.upper()} {some(30)}"] + [some(20), "", None, "### " * 80, ("spam egg ham " * 40).strip()]
    base = some(200).split()
    texts += [" ".join(base), " ".join(base), " ".join([*base[:100], "changed", *base[101:]]), some(2500)]
    rng.shuffle(texts)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    kept = [i for (i,) in con.sql(f"WITH {JUDGED_SQL.format(docs='documents')} SELECT doc_id FROM judged WHERE kept ORDER BY doc_id").fetchall()]
    assert 30 <= len(kept) < len(texts)
    classes = classes_of([texts[i] for i in kept])
    kept = [i for k, i in enumerate(kept) if classes[k] == k]
    data = [texts[i].encode() for i in kept]
    count = Counter(x[i : i + 200] for x in data for i in range(len(x) - 199))
    left = {}
    for i, x in zip(kept, data):
        gone = bytearray(len(x))
        for k in range(len(x) - 199):
            if count[x[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        left[i] = bytes(c for c, g in zip(x, gone) if not g).decode()
    hit = [i for i, t in left.items() if windows(item) & {b" %b " % b" ".join(w[k : k + 10]) for w in [split_words(t)] for k in range(len(w))}]
    assert len(hit) == 1 and any(left[i] != texts[i] for i in left)
    want = Counter(p for i, t in left.items() if i not in hit for p in pieces_of(i, t))
    out = P.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    # each stage alone keeps the columns, and clashing ones with them
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("n_words", F.lit("mine")).withColumn("key", F.lit(3))
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.where("n_words = 'mine' AND key = 3").count() == got.count() > 0, name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_pipeline_on_tables(spark):
    import corpus_pipeline as P

    assert P.run(spark, SF).count() > 0 and [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "suffix_array_dedup", "decontamination", "packing"]
