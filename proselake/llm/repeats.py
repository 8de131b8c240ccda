"""Exact removal of repeated 200-byte strings, within and across documents, by suffix arrays of segments.

1. One pass cuts each text into segments of windows with one anchor (`anchors`), and hashes anchor and segment.
2. Anchors that occur once are done: none of their windows repeats. Where all segments of an anchor are equal, all
   their windows repeat. Both follow from counts by anchor, without any text.
3. Anchors with unequal segments are left, at the borders of repeated passages. Equal segments form classes, counted
   likewise. One segment of each class brings its text to the cell of its anchor, and a suffix array by linear
   grouping over blocks of cells tells which windows of the single ones occur in another class.
4. Runs of repeated windows go back to their documents and are removed.

A cell whose anchor is frequent is dealt out by the 84 bytes to the left and to the right of the anchor, since each
window holds one of the two; so a frequent line in ever new surroundings fills no cell. A longer passage in ever new
surroundings still does: a cell of more bytes than a block gets no suffix array, but each of its windows is hashed (128
bits, with the cell), counted with partial counts before the exchange, and met with the repeated ones over salted keys.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proselake.llm.anchors import GRAM, WINDOW, segments
from proselake.llm.shared import batches, held, hot_join, settle, split_count, table
from proselake.llm.suffixes import repeated_windows

#: Occurrences of an anchor from which its cell is dealt out by side; bytes of a block for one suffix array.
FREQUENT, BLOCK = 2000, 1 << 19
#: Tasks over which the occurrences of one window in a large cell are dealt.
SALTS = 16
_SIDE = (WINDOW - GRAM) // 2
#: Stands for a null id among the keys of rows.
_NO_ID = -(1 << 63)

_RUNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _described(it):
    import xxhash

    held(("nothing",))
    for batch in it:
        hs, gs, firsts, counts, ats, rows = [], [], [], [], [], []
        for k, t in enumerate(batch.column(2)):
            raw = t.as_buffer()
            if raw is None or raw.size < WINDOW:
                continue
            data = memoryview(raw)
            h, a, b, at = segments(np.frombuffer(data, np.uint8))
            hs.append(h)
            gs += [xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(a.tolist(), (b + WINDOW).tolist())]
            firsts.append(a)
            counts.append(b - a + 1)
            ats.append(at - a)
            rows.append(np.full(len(h), k))
        if not hs:
            continue
        row = pa.array(np.concatenate(rows))
        cols = [
            pa.array(np.concatenate(hs).view(np.int64)),
            pa.array(np.array(gs, np.uint64).view(np.int64)),
            batch.column(0).take(row),
            batch.column(1).take(row),
            pa.array(np.concatenate(firsts).astype(np.int32)),
            pa.array(np.concatenate(counts).astype(np.int16)),
            pa.array(np.concatenate(ats).astype(np.int16)),
        ]
        yield pa.RecordBatch.from_arrays(cols, ["h", "g", "did", "xx", "first", "n", "at"])


def merged(runs) -> list[tuple[int, int]]:
    """Maximal runs of half-open byte ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def merged_arrays(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """As `merged`, of ranges in two arrays."""
    if not len(a):
        return []
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    return list(zip(a[new].tolist(), b[np.append(new[1:] - 1, len(b) - 1)].tolist()))


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in runs for x in r), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _squeezed(it):
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in it:
        body = [squeeze.compress(t.as_buffer() or b"") for t in batch.column("text")]
        names = ["body" if n == "text" else n for n in batch.schema.names]
        yield pa.RecordBatch.from_arrays([pa.array(body, pa.binary()) if n == "text" else batch.column(n) for n in batch.schema.names], names)


def _cells(raw: bytes, first: int, n: int, at: int, h: int, frequent: bool) -> list[tuple[int, int, bytes]]:
    """(cell, first window, bytes) of a segment: one, or up to two for a frequent anchor."""
    if not frequent:
        return [(h, first, raw[first : first + n - 1 + WINDOW])]
    out, anchor = [], first + at
    code = lambda side, part: int.from_bytes(hashlib.blake2b(side + h.to_bytes(8, "little", signed=True) + part, digest_size=8).digest(), "little", signed=True)
    split = at - _SIDE  # windows up to here hold the left side, those from here on the right one
    if split >= 0:
        end = min(split, n - 1)
        out.append((code(b"L", raw[anchor - _SIDE : anchor]), first, raw[first : first + end + WINDOW]))
    if split <= n - 1:
        begin = first + max(0, split)
        out.append((code(b"R", raw[anchor + GRAM : anchor + GRAM + _SIDE]), begin, raw[begin : first + n - 1 + WINDOW]))
    return out


def _noted(keep: list[str], keep_text: bool):
    """Per document: what is surely removed, the segments to judge, and the result if there is nothing to judge."""

    def run(it):
        import zstandard

        squeeze, loose = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        cell = pa.list_(pa.struct([("cell", pa.int64()), ("first", pa.int64()), ("judge", pa.bool_()), ("part", pa.binary())]))
        for batch in it:
            cols: list[list] = [[] for _ in range(8)]
            notes = batch.column("notes")
            edges, inner = notes.offsets.to_numpy(), notes.values
            first, n, at, h, frequent, known, present = (inner.field(i).to_numpy(zero_copy_only=False) for i in range(7))
            last = first.astype(np.int64) + n - 1 + WINDOW
            for k, body in enumerate(batch.column("body")):
                raw = loose.decompress(body.as_py())
                lo, hi = (int(edges[k]), int(edges[k + 1])) if notes[k].is_valid else (0, 0)
                sure = merged_arrays(first[lo:hi][known[lo:hi]], last[lo:hi][known[lo:hi]])
                here = (lo + np.flatnonzero(present[lo:hi])).tolist()
                parts = [{"cell": c, "first": f, "judge": not known[i], "part": p} for i in here for c, f, p in _cells(raw, int(first[i]), int(n[i]), int(at[i]), int(h[i]), bool(frequent[i]))]
                open_ = any(p["judge"] for p in parts)
                kept = without(raw, sure)
                result = (len(raw), sum(b - a for a, b in sure), len(sure), hashlib.sha256(kept).hexdigest())
                for col, v in zip(cols, (*result, [{"a": a, "b": b} for a, b in sure] if open_ else None, parts, squeeze.compress(kept) if open_ or keep_text else None, open_), strict=True):
                    col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), _RUNS, cell, pa.binary(), pa.bool_()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "sure", "parts", "rest", "open"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*keep, *names])

    return run


def _judged(it):
    """Rows in the order of their cell: the runs of repeated windows of the segments to judge."""
    cells, parts, marks, size, last = [], [], [], 0, None

    def close():
        out = []
        count: dict[int, int] = {}
        for c in cells:
            count[c] = count.get(c, 0) + 1
        own = [i for i, c in enumerate(cells) if count[c] > 1]
        if own:
            for i, hit in zip(own, repeated_windows([cells[i] for i in own], [parts[i] for i in own]), strict=True):
                did, xx, first, judge = marks[i]
                if judge and hit.any():
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                    out += [(did, xx, first + int(a), first + int(b) - 1 + WINDOW) for a, b in zip(edge[::2], edge[1::2])]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], ["did", "xx", "a", "b"])

    for batch in it:
        names = ("cell", "did", "xx", "first", "judge", "part")
        for cell, did, xx, first, judge, part in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if size > BLOCK and cell != last:
                yield close()
                cells, parts, marks, size = [], [], [], 0
            last = cell
            cells.append(cell)
            parts.append(part)
            marks.append((did, xx, first, judge))
            size += len(part)
    yield close()


def _windowed(it):
    """The windows of parts of large cells, each by its hash."""
    import xxhash

    for batch in it:
        dids, xxs, ats, judges, keys = [], [], [], [], []
        names = ("cell", "did", "xx", "first", "judge", "part")
        for cell, did, xx, first, judge, part in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            n, head = len(part) - WINDOW + 1, cell.to_bytes(8, "little", signed=True)
            dids += [did] * n
            xxs += [xx] * n
            ats += range(first, first + n)
            judges += [judge] * n
            keys += [xxhash.xxh3_128_digest(head + part[i : i + WINDOW]) for i in range(n)]
        k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        cols = [pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(dids, pa.int64()), pa.array(xxs, pa.int64()), pa.array(ats, pa.int64()), pa.array(judges, pa.bool_())]
        yield pa.RecordBatch.from_arrays(cols, ["k", "l", "did", "xx", "a", "judge"])


def by_size(parts: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """`parts` of the cells of at most `block` bytes, and those of larger ones; there is at most one of these per block."""
    large = settle(parts.groupBy("cell").agg(F.sum(F.length("part")).alias("size")).where(F.col("size") > block).select("cell"), "large")
    return tuple(parts.join(F.broadcast(large), "cell", how) for how in ("left_anti", "left_semi"))


def _counted(parts: DataFrame) -> DataFrame:
    """(did, xx, a, b): the repeated windows of parts to judge, whatever the size of their cells."""
    windows = settle(parts.mapInArrow(_windowed, "k long, l long, did long, xx long, a long, judge boolean"), "windows")
    many = windows.groupBy("k", "l").agg(F.count("*").alias("c")).where("c > 1").select("k", "l", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = windows.where("judge").withColumn("salt", F.pmod(F.hash("did", "xx", "a"), F.lit(SALTS)))
    return own.join(many, ["k", "l", "salt"]).select("did", "xx", "a", (F.col("a") + WINDOW).alias("b"))


def _text(raw: bytes) -> str:
    """A character that a removed run cuts goes with it."""
    return raw.decode("utf-8", "ignore")


def _finished(keep: list[str], keep_text: bool):
    def run(it):
        import zstandard

        loose = zstandard.ZstdDecompressor()
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "rest"]
        for batch in it:
            cols: list[list] = [[] for _ in range(4)]
            for n, rest, sure, more in zip(batch.column("n_bytes").to_pylist(), batch.column("rest"), batch.column("sure").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                old = [(x["a"], x["b"]) for x in sure]
                runs = merged(old + [(x["a"], x["b"]) for x in more or []])
                # what is left of the old text, with its places in it
                edges = [0, *(x for r in old for x in r), n]
                raw, at, kept = loose.decompress(rest.as_py()), 0, []
                gone = iter([*runs, (n, n)])
                a, b = next(gone)
                for lo, hi in zip(edges[::2], edges[1::2]):
                    x = lo
                    while x < hi:
                        while b <= x and a < n:
                            a, b = next(gone)
                        y = min(hi, max(a, x))
                        kept.append(raw[at + x - lo : at + y - lo])
                        x = min(hi, b) if y < hi else hi
                    at += hi - lo
                left = b"".join(kept)
                for col, v in zip(cols, (sum(b - a for a, b in runs), len(runs), hashlib.sha256(left).hexdigest(), _text(left) if keep_text else None), strict=True):
                    col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*keep, *names])

    return run


def _schema(df: DataFrame, keep: list[str], more: str) -> T.StructType:
    return T.StructType([*(df.schema[n] for n in keep), *T.StructType.fromDDL(more)])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """All columns of `docs` but the text, with n_bytes, n_removed, n_spans and kept_sha256; and, if asked for, ``rest``:
    the text that stays.

    A null text has no bytes; texts under 200 bytes lose nothing. Repeated rows are copies of each other, so all their
    windows repeat. Rows are told apart by id and text hash; null ids are one id. Columns of the input that bear a
    name of the result's give way to it, and so do those named sure, parts, open, did, xx, notes, runs or body, which the steps
    in between use; `drop_repeats` keeps columns of any name.
    """
    spark = docs.sparkSession
    batches(spark)
    made = {"n_bytes", "n_removed", "n_spans", "kept_sha256", "sure", "parts", "rest", "open", "did", "xx", "notes", "runs", "body"}
    others = [c for c in docs.columns if c != text and c not in made]
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64(t).alias("xx"), t.alias("text"), *others)
    anchors = settle(keyed.select("did", "xx", "text").mapInArrow(_described, "h long, g long, did long, xx long, first int, n short, at short"), "anchors")
    counts = anchors.groupBy("h").agg(F.count("*").alias("c"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("c > 1")
    counts = settle(counts.select("h", "c", (F.col("lo") != F.col("hi")).alias("mixed"), (F.col("c") > FREQUENT).alias("frequent")), "counts")
    several = settle(hot_join(anchors, counts, ["h"], "c"), "several")
    mixed = several.where("mixed")
    who = F.struct("did", "xx", "first")
    classes = mixed.groupBy("h", "g").agg(F.count("*").alias("c"), F.min(who).alias("one"))
    classes = settle(classes.select("h", "g", "c", (F.col("c") > 1).alias("sure"), "one"), "classes")
    told = hot_join(mixed, classes, ["h", "g"], "c").select("did", "xx", "first", "n", "at", "h", "frequent", "sure", (who == F.col("one")).alias("present"))
    no = F.lit(False)
    pure = several.where("not mixed").select("did", "xx", "first", "n", "at", "h", no.alias("frequent"), F.lit(True).alias("sure"), no.alias("present"))
    fields = ["first", "n", "at", "h", "frequent", "sure", "present"]
    notes = told.union(pure).distinct().groupBy("did", "xx").agg(F.collect_list(F.struct(*fields)).alias("notes"))

    keep = ["did", "xx", *others]
    bodies = keyed.mapInArrow(_squeezed, T.StructType([*(T.StructField("body", T.BinaryType()) if f.name == "text" else f for f in keyed.schema)]))
    noted = bodies.join(notes, ["did", "xx"], "left")
    more = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, sure array<struct<a:long,b:long>>, parts array<struct<cell:long,first:long,judge:boolean,part:binary>>, rest binary, open boolean"
    state = settle(noted.mapInArrow(_noted(keep, keep_text), _schema(keyed, keep, more)), "state")

    parts = state.select("did", "xx", F.explode("parts").alias("p")).select("did", "xx", "p.*")
    small, large = by_size(parts, BLOCK)
    dealt = small.repartition(split_count(spark, state), "cell").sortWithinPartitions("cell", "did", "xx", "first")
    found = dealt.mapInArrow(_judged, "did long, xx long, a long, b long").union(_counted(large))
    runs = found.distinct().groupBy("did", "xx").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    more = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, rest string"
    waiting = state.where("open").drop("parts", "open", "n_removed", "n_spans", "kept_sha256").join(runs, ["did", "xx"], "left")
    finished = waiting.mapInArrow(_finished(keep, keep_text), _schema(keyed, keep, more))
    done = state.where("not open").select(*finished.columns)
    if keep_text:
        done = done.mapInArrow(_texts, finished.schema)
    else:
        done = done.withColumn("rest", F.lit(None).cast("string"))
    return done.union(finished).drop("did", "xx", *([] if keep_text else ["rest"]))


def _texts(it):
    import zstandard

    loose = zstandard.ZstdDecompressor()
    for batch in it:
        texts = [_text(loose.decompress(b.as_py())) for b in batch.column("rest")]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "rest" else batch.column(n) for n in batch.schema.names], batch.schema.names)


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with all repeated 200-byte strings taken out of the text; null texts become empty, all else stays."""
    names = [f"__r_{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    found = remove_repeats(docs.toDF(*names), at[doc_id], at[text], keep_text=True)
    kept = (F.col("rest").cast(f.dataType) if n == at[text] else F.col(n) for n, f in zip(names, docs.schema, strict=True))
    return found.select(*kept).toDF(*docs.columns)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that stand in a repeated 200-byte string."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
