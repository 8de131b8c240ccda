"""Integer vectors in blocks: what exact top-k search and centroid clustering share.

A vector of doubles becomes integers, floor(scale * x), which are exact in every later step. Blocks hold many vectors as one
matrix of the narrowest integer type that takes them; vectors with components beyond 62 bits go as decimal text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vectors in a block at most, and components, so that a block of long vectors stays as small.
BLOCK_ROWS = 4096
BLOCK_CELLS = 1 << 20

BLOCK = "block long, ids array<{id}>, marks binary, dim int, kind string, x binary, wide array<string>"


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, odd), F.lit(True))


def exact(x: float, scale: int) -> int:
    """floor(scale * x) also where the product overflows a double."""
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)


def matrix(kind: str, x: bytes, wide, dim: int) -> np.ndarray:
    """The integers of a block, a row a vector: int64, or Python's own integers for wide ones."""
    if kind == "wide":
        return np.array([[int(v) for v in t.split(",")] for t in wide], dtype=object).reshape(len(wide), dim)
    return np.frombuffer(x, np.dtype(kind)).reshape(-1, dim).astype(np.int64) if dim else np.zeros((len(x), 0), np.int64)


class _Blocks:
    """Gathers vectors of like length and width, and gives blocks of bounded size with rising ids, null ids last."""

    def __init__(self, scale: int, id_type: pa.DataType):
        self.scale, self.id_type, self.parts, self.made = scale, id_type, {}, 0

    def add(self, ids: pa.Array, marks: np.ndarray, vectors: pa.Array):
        lens = np.diff(vectors.offsets.to_numpy())
        cells = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        at = np.concatenate(([0], np.cumsum(lens)))
        with np.errstate(over="ignore"):
            big = np.abs(cells * self.scale) >= 2.0**62
        n_big = np.concatenate(([0], np.cumsum(big)))
        wide = n_big[at[1:]] > n_big[at[:-1]]
        # vectors of like length share a block, so that padding at most doubles it; all empty ones are a class of their own
        size = np.frexp(lens.astype(np.float64))[1]
        for w, s in sorted(set(zip(wide.tolist(), size.tolist(), strict=True))):
            rows = np.flatnonzero((wide == w) & (size == s))
            dim = int(lens[rows].max())
            col = np.arange(dim)
            there = col < lens[rows][:, None]
            where = np.where(there, at[:-1][rows][:, None] + col, 0)
            x = np.where(there, cells[where], 0.0) if dim else np.zeros((len(rows), 0))
            x = np.array([[exact(v, self.scale) for v in r] for r in x.tolist()], dtype=object).reshape(x.shape) if w else np.floor(x * self.scale).astype(np.int64)
            key, step = (w, s), max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, dim)))
            taken = ids.take(pa.array(rows))
            for i in range(0, len(rows), step):
                have = self.parts.setdefault(key, [])
                if have and sum(len(p[1]) for p in have) + len(rows[i : i + step]) > step:
                    yield self.block(key)
                    have = self.parts.setdefault(key, [])
                have.append((taken.slice(i, step), marks[rows[i : i + step]], x[i : i + step]))

    def block(self, key) -> pa.RecordBatch:
        parts = self.parts.pop(key)
        dim = max(p[2].shape[1] for p in parts)
        ids = pa.concat_arrays([p[0] for p in parts])
        x = np.concatenate([np.pad(p[2], ((0, 0), (0, dim - p[2].shape[1]))) for p in parts])
        order = pa.compute.array_sort_indices(ids, order="ascending").to_numpy()
        ids, marks, x = ids.take(pa.array(order)), np.concatenate([p[1] for p in parts])[order], x[order]
        text, raw, kind = None, None, "wide"
        if key[0]:
            text = [",".join(map(str, r)) for r in x.tolist()]
        else:
            most = int(np.abs(x).max()) if x.size else 0
            kind = next(k for k in ("int8", "int16", "int32", "int64") if most <= np.iinfo(k).max)
            # a block of empty vectors has a byte for each
            raw = x.astype(kind).tobytes() if dim else b"\0" * len(x)
        self.made += 1
        number = (TaskContext.get().partitionId() << 32) | self.made
        cols = [pa.array([number], pa.int64()), pa.array([ids.to_pylist()], pa.list_(self.id_type)), pa.array([marks.astype(np.uint8).tobytes()], pa.binary()),
                pa.array([dim], pa.int32()), pa.array([kind]), pa.array([raw], pa.binary()), pa.array([text], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(cols, ["block", "ids", "marks", "dim", "kind", "x", "wide"])


def blocked(scale: int):
    """For `mapInArrow` over (id, mark boolean, vector array<double>): one row for each block, as `BLOCK` says."""

    def run(it):
        blocks = None
        for b in it:
            if blocks is None:
                blocks = _Blocks(scale, b.column(0).type)
            if b.num_rows:
                yield from blocks.add(b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.column(2))
        for key in list(blocks.parts) if blocks else ():
            yield blocks.block(key)

    return run
