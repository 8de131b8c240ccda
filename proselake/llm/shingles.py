"""Word shingles of whole texts as 64-bit hashes, and circulant MinHash signatures of them, a batch at a time."""

from __future__ import annotations

import numpy as np

SIZE = 5
#: Coordinates of a signature.
COORDINATES = 128
#: Shingles that are permuted at a time, so that the work stays in a core's cache.
_STEP = 1 << 15
#: Bytes of text whose words are hashed at a time.
_GROUP = 1 << 19

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * _A
    x = (x ^ (x >> np.uint64(33))) * _B
    return x ^ (x >> np.uint64(33))


def folded(text: bytes | None) -> bytes:
    """The words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, one blank between them; all in UTF-8."""
    return b" ".join((text or b"").translate(_FOLD).split())


_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept from batch to batch."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _POWERS = np.cumprod(up), np.cumprod(down)
    return _POWERS[0][:n], _POWERS[1][:n]


def shingle_sets(texts: list[bytes], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each folded text, one text after the other, and where each text begins (and the end).

    A text of fewer words than `size` is one shingle; a text without words has none. Texts are taken in groups of about
    `_GROUP` bytes, so the arrays that stand beside the result stay small.
    """
    out, edges, lo, used = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0, 0
    for i, t in enumerate(texts):
        used += len(t)
        if used > _GROUP or i + 1 == len(texts):
            got, e = _group_sets(texts[lo : i + 1], size)
            out.append(got)
            edges.append(e[1:] + edges[-1][-1])
            lo, used = i + 1, 0
    return np.concatenate(out), np.concatenate(edges)


def _group_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = np.flatnonzero(raw == 32)
    lengths = np.array([len(t) for t in texts], np.int64)
    with np.errstate(over="ignore"):
        up, down = _powers(len(raw))
        sums = np.concatenate(([np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up)))
        start = np.concatenate(([0], blank[:-1] + 1))
        word = mix((sums[blank] - sums[start]) * down[start] + (blank - start).astype(np.uint64))
        # empty texts are words of no length
        real = blank > start
        word, start = word[real], start[real]
        first = np.concatenate(([0], np.cumsum(lengths + 1)))
        at = np.searchsorted(start, first)
        n = np.diff(at)
        windows = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
        edges = np.concatenate(([0], np.cumsum(windows)))
        owner = np.repeat(np.arange(len(texts)), windows)
        begin = at[owner] + np.arange(edges[-1]) - edges[owner]
        span = np.minimum(n, size)[owner]
        padded = np.concatenate((word, np.zeros(size, np.uint64)))
        out = span.astype(np.uint64)
        for k in range(size):
            out = out + np.where(k < span, mix(padded[begin + k] * _PLACES[k] + np.uint64(k)), np.uint64(0))
        out = mix(out)
    # sorting by text and hash makes equal shingles of a text neighbours
    order = np.lexsort((out, owner)) if len(texts) > 1 else np.argsort(out)
    out, owner = out[order], owner[order]
    if len(out):
        new = np.concatenate(([True], (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])))
        out, owner = out[new], owner[new]
    return out, np.searchsorted(owner, np.arange(len(texts) + 1))


def _permuted(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _shuffled(x: np.ndarray) -> np.ndarray:
    """Another permutation of the 32-bit numbers, applied once to the shingles' places."""
    x = (x ^ (x >> np.uint32(17))) * np.uint32(0xED5AD4BB)
    x = (x ^ (x >> np.uint32(11))) * np.uint32(0xAC4C1B51)
    return x ^ (x >> np.uint32(15))


def signatures(shingles: np.ndarray, edges: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least value of the second permutation, shifted by k places on the ring of
    32-bit numbers, over the places that the first permutation gives the shingles. Sets without shingles get all ones.
    """
    out = np.full((len(edges) - 1, coordinates), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        place = _shuffled((shingles >> np.uint64(32)).astype(np.uint32))
        full = np.flatnonzero(np.diff(edges))
        ends, i = edges[full + 1], 0
        while i < len(full):
            # as many whole sets as go into a step, or a part of one large set at a time
            a = edges[full[i]]
            j = max(i + 1, int(np.searchsorted(ends, a + _STEP, "right")))
            b = edges[full[j - 1] + 1]
            for lo in range(int(a), int(b), _STEP) if j == i + 1 else [int(a)]:
                hi = min(int(b), lo + _STEP) if j == i + 1 else int(b)
                part = place[lo:hi]
                starts = [0] if j == i + 1 else (edges[full[i:j]] - a)
                for k in range(coordinates):
                    least = np.minimum.reduceat(_permuted(part + np.uint32(k)), starts)
                    out[full[i:j], k] = np.minimum(out[full[i:j], k], least)
            i = j
    return out
