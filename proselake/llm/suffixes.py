"""Suffix arrays by linear grouping, and repeated windows of text segments from them.

Symbols are pieces of text that end with a blank or line end, numbered in byte order. No piece is the beginning of
another one, so suffixes in symbol order are in byte order, at a sixth of the length.
"""

from __future__ import annotations

import numpy as np

from proselake.llm.anchors import WINDOW
from proselake.llm.shingles import mix

#: Longest piece, in bytes; where a longer one occurs, each byte of the block is a piece of its own.
LONGEST = 64


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes in ascending order, in linear space and without renaming.

    First, groups of suffixes are refined from the last to the first: each suffix of a group looks up the nearest
    suffix before it that is in a smaller group, by following the pointers found so far, and those found move to new
    groups right after their old one, by the number of suffixes that found them. In the end each group holds the
    suffixes with one Lyndon prefix, and the pointers lead to the previous smaller suffixes. Then the groups are
    filled from the first to the last: a suffix in its final place gives their places to all suffixes whose Lyndon
    prefix ends where it begins.
    """
    n = len(text)
    sa = np.argsort(np.asarray(text), kind="stable").tolist()
    place, group, size = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for k, i in enumerate(sa):
        place[i] = k
        if k and text[i] != text[sa[k - 1]]:
            start = k
        group[i] = start
        size[start] += 1
    before = list(range(-1, n - 1))
    end = n
    while end:
        start = group[sa[end - 1]]
        if end - start == 1:
            i = sa[start]
            j = before[i]
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                # one suffix moves to a group of its own, the last place of its old one
                g = group[j]
                size[g] -= 1
                last = g + size[g]
                k, other = place[j], sa[last]
                sa[k], sa[last] = other, j
                place[other], place[j] = k, last
                group[j] = last
                size[last] += 1
            end = start
            continue
        found: dict[int, int] = {}
        for i in sorted(sa[start:end]):
            j = before[i]
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                found[j] = found.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, c in found.items():
            by_count.setdefault(c, []).append(j)
        for c in sorted(by_count, reverse=True) if len(by_count) > 1 else by_count:
            moved = by_count[c]
            for j in moved:
                g = group[j]
                size[g] -= 1
                last = g + size[g]
                k, other = place[j], sa[last]
                sa[k], sa[last] = other, j
                place[other], place[j] = k, last
            for j in moved:
                g = group[j]
                # all that left a group stand behind what is left of it
                new = g + size[g]
                group[j] = ~new
            for j in moved:
                new = ~group[j]
                group[j] = new
                size[new] += 1
        end = start
    free, out = list(range(n + 1)), [0] * n
    j = n - 1
    while j >= 0:
        g = group[j]
        out[free[g]] = j
        free[g] += 1
        j = before[j]
    for k in range(n):
        i = out[k]
        j, stop = i - 1, before[i]
        while j != stop:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = before[j]
    return out


def _pieces(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces end (exclusive): after each blank or line end, and at the end of each segment."""
    cut = np.flatnonzero((raw == 32) | (raw == 10)) + 1
    cut = np.union1d(cut, ends)
    if np.diff(cut, prepend=0).max(initial=0) > LONGEST:
        cut = np.arange(1, len(raw) + 1)
    return cut


def repeated_windows(cells: list[int], segments: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each segment, which of its windows occur anywhere else in a segment of the same cell, as booleans.

    All segments of a cell must stand in one call. Equal segments of one cell count as different places.
    """
    raw = np.frombuffer(b"".join(segments), np.uint8)
    ends = np.cumsum([len(s) for s in segments])
    cut = _pieces(raw, ends)
    first = np.concatenate(([0], cut[:-1]))
    length = cut - first
    owner = np.searchsorted(ends, first, "right")
    # symbols in byte order; a segment's last piece is followed by a symbol below all others
    data = raw.tobytes()
    strings = [data[a:b] for a, b in zip(first.tolist(), cut.tolist())]
    number = {s: k + 1 for k, s in enumerate(sorted(set(strings)))}
    spot = np.arange(len(strings)) + owner
    text, at = np.zeros(len(strings) + len(segments), np.int64), np.full(len(strings) + len(segments), -1)
    text[spot], at[spot] = np.fromiter(map(number.__getitem__, strings), np.int64, len(strings)), np.arange(len(strings))
    order = at[np.array(suffix_array(text.tolist()), np.int64)]
    order = order[order >= 0]
    begin, room = first[order], ends[owner[order]] - first[order]
    # common bytes of neighbours, eight at a time, up to a window
    padded = np.concatenate((raw, np.zeros(window + 16, np.uint8)))
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    common = np.zeros(len(order), np.int64)
    active = np.arange(1, len(order))
    for step in range(0, window, 8):
        x = eight[begin[active] + step] ^ eight[begin[active - 1] + step]
        same = x == 0
        low = x[~same]
        common[active[~same]] = step + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) >> 3)
        active = active[same]
        common[active] = step + 8
    common[1:] = np.minimum(common[1:], np.minimum(room[1:], room[:-1]))
    # a window starts d bytes before the end of its first piece, and goes on for window - d bytes from there
    ok = (order > 0) & (owner[np.maximum(order - 1, 0)] == owner[order])
    prior = np.where(ok, length[np.maximum(order - 1, 0)], 0)
    out = np.zeros(len(raw), bool)
    cell = np.asarray(cells, np.int64)[owner[order]]
    with np.errstate(over="ignore"):
        tail = np.zeros(len(order), np.uint64)
        for d in range(1, int(prior.max(initial=0)) + 1):
            block = np.cumsum(common < window - d)
            # the hash of d bytes goes on from that of d - 1 bytes, as long as the piece is so long
            long = np.flatnonzero(prior >= d)
            tail[long] = mix(tail[long] + np.uint64(0x9E3779B97F4A7C15) + padded[begin[long] - d])
            live = long[room[long] >= window - d]
            key = mix(block[live].astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + tail[live]) + cell[live].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            out[begin[live[count[inverse] > 1]] - d] = True
    starts = ends - [len(s) for s in segments]
    return [out[a : b - window + 1] for a, b in zip(starts, ends)]
