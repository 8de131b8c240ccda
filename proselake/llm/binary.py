"""Binary token ids: shard files of raw ids with a minimal perfect hash index and stored fingerprints.

A shard file holds, in this order: the ids of its documents one after the other (2 or 4 bytes each, little-endian);
for each document its first id and length; the index; a JSON footer, its length and a magic word. Documents are in
ascending order of their key across and within shards.

The index is a cascade of bit arrays: a key that alone hits a position of a level sets that bit, the others go on to
the next level. The rank of a key's bit is its number, without gaps, and leads to a fingerprint and the key's documents.
"""

from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.llm.shared import batches, settle, shared_dir, split_count, table
from proselake.llm.pieces import piece_ids

MAGIC = b"IDSHARD1"
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finaliser, seeded by level."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * _M1
        x = (x ^ (x >> np.uint64(33))) * _M2
        return x ^ (x >> np.uint64(33))


def key_codes(keys: list, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code and a 32-bit fingerprint of each key; null is a key of its own."""
    got = np.frombuffer(b"".join(hashlib.blake2b(repr(k).encode(), digest_size=12, salt=salt.to_bytes(8, "little")).digest() for k in keys), [("code", "<u8"), ("print", "<u4")])
    return got["code"].copy(), got["print"].copy()


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit codes in about 3 bits a key, looked up in constant expected time."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # 64-bit words
        self.ranks, self.before, n = [], [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(n + np.cumsum(ones) - ones)
            n += int(ones.sum())

    @classmethod
    def of(cls, codes: np.ndarray) -> PerfectHash:
        levels, left = [], codes
        while len(left):
            size = -(-max(64, len(left) * 3 // 2) // 64) * 64
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            left = left[~alone]
        return cls(levels)

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        """The number of each code; a code that was not put in gets any number or -1."""
        out, left = np.full(len(codes), -1, np.int64), np.arange(len(codes))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (_mix(codes[left], level) % np.uint64(len(words) * 64)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[here]] = (ranks[at >> 6] + below)[here]
            left = left[~here]
        return out


def _file_system(uri: str):
    """The store of a shared folder and the path in it; a plain path is a local one."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


class ShardWriter:
    """Streams ids to the file; only keys, offsets and lengths stay in memory until `close`."""

    def __init__(self, uri: str, width: int):
        fs, path = _file_system(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.width, self.keys, self.lengths = fs.open_output_stream(path), width, [], []

    def add(self, key, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.keys.append(key)
        self.lengths.append(len(ids))

    def close(self) -> None:
        length = np.array(self.lengths, "<u8")
        first = np.array([i for i, k in enumerate(self.keys) if not i or k != self.keys[i - 1]], np.int64)
        own = [self.keys[i] for i in first]
        salt = 0
        while len(np.unique((codes := key_codes(own, salt))[0])) < len(own):
            salt += 1
        hashed = PerfectHash.of(codes[0])
        order = hashed[codes[0]]
        prints, start, count = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u8"), np.zeros(len(own), "<u8")
        prints[order], start[order], count[order] = codes[1], first, np.diff(np.append(first, len(self.keys)))
        parts = [np.cumsum(length) - length, length, prints, start, count, *hashed.levels]
        for p in parts:
            self.out.write(p.tobytes())
        footer = json.dumps({"width": self.width, "documents": len(self.keys), "keys": len(own), "salt": salt, "ids": int(length.sum()), "levels": [len(x) for x in hashed.levels]}).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()


class ShardReader:
    """Keyed access to a shard file: the index is read once, the ids of a document by one ranged read."""

    def __init__(self, uri: str):
        fs, path = _file_system(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        tail = self.file.read_at(16, end - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"no shard file: {uri}")
        size = int.from_bytes(tail[:8], "little")
        self.meta = m = json.loads(self.file.read_at(size, end - 16 - size))
        at = m["ids"] * m["width"]
        raw, parts, i = self.file.read_at(end - 16 - size - at, at), [], 0
        for kind, n in (("<u8", m["documents"]), ("<u8", m["documents"]), ("<u4", m["keys"]), ("<u8", m["keys"]), ("<u8", m["keys"]), *(("<u8", n) for n in m["levels"])):
            parts.append(np.frombuffer(raw, kind, n, i))
            i += n * int(kind[-1])
        self.first, self.length, self.prints, self.start, self.count = parts[:5]
        self.hashed = PerfectHash(parts[5:])

    def find(self, keys: list) -> list[list[tuple[int, int, int]]]:
        """(position, first id, length) of each document of each key; none for a key that is not there."""
        if not keys:
            return []
        codes, prints = key_codes(keys, self.meta["salt"])
        at = self.hashed[codes]
        ok = (at >= 0) & (self.prints[np.maximum(at, 0)] == prints) if self.meta["keys"] else np.zeros(len(keys), bool)
        return [[(d, int(self.first[d]), int(self.length[d])) for d in range(int(self.start[i]), int(self.start[i] + self.count[i]))] if good else [] for i, good in zip(at, ok, strict=True)]

    def ids(self, first: int, length: int) -> np.ndarray:
        w = self.meta["width"]
        return np.frombuffer(self.file.read_at(length * w, first * w), f"<u{w}").astype("<u4")


def _write(path: str, end_id: int, folder: str, width: int):
    end = np.array([end_id], "<u4")

    def run(it):
        at = TaskContext.get()
        # another attempt writes another file; the manifest, which Spark commits, names the one that counts
        uri = f"{folder}/shard-{at.partitionId():06d}-{at.taskAttemptId()}.ids"
        writer, encoder, n = ShardWriter(uri, width), piece_ids(path, keeps_white=False), 0
        for batch in it:
            keys, first = batch.column(0).to_pylist(), n
            for key, got in zip(keys, encoder.ids(batch.column(1)), strict=True):
                writer.add(key, np.concatenate((got, end)))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([at.partitionId()] * len(keys), pa.int32()), pa.array([uri] * len(keys)), batch.column(0), pa.array(range(first, n), pa.int64())], ["shard", "uri", "doc_id", "position"])
        writer.close()

    return run


def write_ids(docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """Write shard files below the shared folder; returns the manifest (shard, uri, doc_id, position).

    `width` is 2 for vocabularies of at most 65,536 ids, else 4. Null texts are empty and hold the end id alone. Null
    ids come first; repeated ids keep all their documents, ordered by a hash of their text, so that even one id with
    a third of all rows is dealt to many shards.
    """
    spark = docs.sparkSession
    batches(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    dealt = source.repartitionByRange(split_count(spark, docs.select(doc_id, text)), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    folder = shared_dir(spark)
    return settle(dealt.mapInArrow(_write(path, end_id, folder, width), "shard int, uri string, doc_id long, position long"), "manifest")


def _read(it):
    uri, reader = None, None
    for batch in it:
        shards, uris, docs, at = (batch.column(n).to_pylist() for n in ("shard", "uri", "doc_id", "position"))
        out: list[tuple] = []
        edges = [i for i in range(len(uris)) if not i or uris[i] != uris[i - 1]] + [len(uris)]
        for a, b in zip(edges, edges[1:]):
            if uris[a] != uri:
                uri, reader = uris[a], ShardReader(uris[a])
            for position, places in zip(at[a:b], reader.find(docs[a:b]), strict=True):
                # a repeated id has several documents, which stand together
                _, first, length = places[position - places[0][0]]
                out.append((first, length, zlib.crc32(reader.ids(first, length).tobytes())))
        cols = [pa.array([o[i] for o in out], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), batch.column("doc_id"), *cols], ["shard", "doc_id", "first", "n_tokens", "ids_crc32"])


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every key of the manifest, by keyed access to the shard files.

    A file's rows stand together in the manifest, so its index is read about once. `start` adds the ids of all shards
    before; the window runs over one row per shard.
    """
    found = manifest.mapInArrow(_read, "shard int, doc_id long, first long, n_tokens long, ids_crc32 long")
    found = settle(found, "found")
    sizes = found.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = sizes.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return found.join(base, "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op8_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to shard files and read back by key."""
    import public_tokenizers

    manifest = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_ids(manifest)
