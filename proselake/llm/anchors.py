"""Content-defined anchors: every 200-byte string of a text names one 32-byte string in it, by content alone.

The anchor of a window is its 32-byte string with the least hash, the leftmost of equals. So two equal windows have
equal anchors at the same place in them, and comparing texts around equal anchors finds all repeated windows. Windows
in a row with one anchor form a segment, on average of about 85 windows.
"""

from __future__ import annotations

import numpy as np

from proselake.llm.shingles import mix

WINDOW, GRAM = 200, 32


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 32-byte string, by doubling the length five times."""
    with np.errstate(over="ignore"):
        x, span = mix(raw.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
        while span < GRAM:
            x = x[:-span] * np.uint64((0xD1342543DE82EF95 * span * 2 + 1) & 0xFFFFFFFFFFFFFFFF) + x[span:]
            x ^= x >> np.uint64(29)
            span *= 2
    return mix(x)


def _window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w values in a row, from minima over blocks of w taken forwards and backwards."""
    n = len(x) - w + 1
    full = -(-len(x) // w) * w
    blocks = np.concatenate((x, np.full(full - len(x), ~np.uint64(0)))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def segments(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window, anchor) of each segment of one text of at least 200 bytes."""
    h = gram_hashes(raw)
    w = WINDOW - GRAM + 1
    least = _window_minima(h, w)
    # the anchor's place: the last position up to which this least value has been the leftmost one
    n = len(least)
    change = np.concatenate(([True], least[1:] != least[:-1]))
    first = np.flatnonzero(change)
    value = least[first]
    last = np.append(first[1:], n) - 1
    # the grams that are the least of some window around them: those that the largest of these least values does not pass
    edge = np.full(w - 1, ~np.uint64(0))
    spot = np.flatnonzero(~_window_minima(np.concatenate((edge, ~least, edge)), w) == h)
    # equal values in one run can have several places; a run longer than w windows, or one whose grams repeat, is split
    out_h, out_a, out_b, out_at = [], [], [], []
    if len(spot) == len(first):
        return value, first, last, spot
    for v, a, b in zip(value, first, last):
        i = int(np.searchsorted(spot, a))
        s = int(a)
        while s <= b:
            while spot[i] < s or h[spot[i]] != v:
                i += 1
            e = min(int(b), int(spot[i]))
            out_h.append(v)
            out_a.append(s)
            out_b.append(e)
            out_at.append(int(spot[i]))
            s = e + 1
    return np.array(out_h, np.uint64), *(np.array(x, np.int64) for x in (out_a, out_b, out_at))
