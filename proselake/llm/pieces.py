"""Token ids of whole texts, a batch at a time, by way of short pieces that repeat.

A tokenizer's ids of a text are the ids of its pieces in order, as long as a cut falls only where the tokenizer itself
always cuts: around runs of white space, and between a letter and a mark that is no apostrophe. The cuts come from array
operations on the bytes of many texts; each piece is known by a 64-bit hash (and its length), and a piece that is not
known yet goes to the library, many at a time, with a special string between them.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from proselake.llm.shared import held
from proselake.llm.shingles import mix

#: Pieces that a worker keeps, in about 40 bytes each. A full store keeps what was used since it was last full.
STORE = 600_000
#: Longest piece that is kept, in bytes; longer ones go to the library each time.
LONGEST = 64
#: Bytes of text that are cut at a time.
_GROUP = 1 << 19
#: Bytes of new pieces that the library gets at once.
_ASK = 1 << 16

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 3
#: The characters of Unicode's White_Space beyond ASCII, in UTF-8.
_WIDE = {2: [0xC285, 0xC2A0], 3: [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]}


def kinds(raw: np.ndarray) -> np.ndarray:
    """For each byte: 1 white space, 2 a Latin letter, 3 an ASCII mark but the apostrophe, else 0."""
    kind = _KIND[raw]
    if not (raw >= 0xC2).any():
        return kind
    lead = np.flatnonzero(raw >= 0xC2)
    padded = np.concatenate((raw, np.zeros(2, np.uint8)))
    two = (raw[lead].astype(np.int32) << 8) | padded[lead + 1]
    three = (two << 8) | padded[lead + 2]
    # letters of Latin-1: all of this range but the signs for times and divided by
    latin = lead[(two >= 0xC380) & (two <= 0xC3BF) & (two != 0xC397) & (two != 0xC3B7)]
    kind[latin] = kind[latin + 1] = 2
    for at, n in ((lead[np.isin(two, _WIDE[2])], 2), (lead[np.isin(three, _WIDE[3])], 3)):
        for k in range(n):
            kind[at + k] = 1
    return kind


def cuts(raw: np.ndarray, edges: np.ndarray, keeps_white: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of texts begin and end; `edges` has the beginning of each text, and the end.

    A tokenizer that keeps white space gives one blank to the word after it, and tells the last character of a longer
    run from the others; so a run that does not end in a blank stays with its word.
    """
    n = len(raw)
    kind = kinds(raw)
    white = kind == 1
    cut = np.zeros(n + 1, bool)
    cut[edges] = True
    if n:
        before, here = kind[:-1], kind[1:]
        # a letter before a mark
        cut[1:n] |= (before == 2) & (here == 3)
        begins = white.copy()
        begins[1:] &= ~white[:-1] | cut[1:n]
        cut[:n] |= begins
        ends = white.copy()
        ends[:-1] &= ~white[1:] | cut[1:n]
        if keeps_white:
            first, last = np.flatnonzero(begins), np.flatnonzero(ends)
            long = last > first
            # the last blank of a longer run goes with the word after it; without a word the run is one piece
            word = ~cut[last + 1]
            cut[last[long & word & (raw[last] == 32)]] = True
            # one byte alone that is no blank is a piece
            cut[last[~long & (raw[last] != 32)] + 1] = True
        else:
            cut[np.flatnonzero(ends) + 1] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    if not keeps_white and n:
        own = ~white[start]
        start, end = start[own], end[own]
    return start, end


def piece_hashes(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece, eight bytes at a time; pieces of up to eight bytes differ for sure."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        h = np.zeros(len(start), np.uint64)
        live, done = np.arange(len(start)), 0
        while len(live):
            rest = length[live] - done
            bits = (np.minimum(rest, 8) * 8).astype(np.uint64)
            word = eight[start[live] + done]
            part = bits < 64
            word[part] &= (np.uint64(1) << bits[part]) - np.uint64(1)
            h[live] = mix((h[live] * np.uint64(0x9E3779B97F4A7C15)) ^ word)
            live, done = live[rest > 8], done + 8
        # the length goes in last, so that zero bytes at the end count
        return mix(h + length.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


class _Store:
    """Ids by piece hash: open addressing over arrays."""

    def __init__(self, bound: int, kind: str = "<u4"):
        self.bound, self.kind = bound, kind
        self._fill(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, kind))

    def _fill(self, keys, sizes, ids) -> None:
        self.slot = np.zeros(0, np.int32)
        self.key, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.used, self.ids, self.count, self.filled = np.zeros(0, bool), np.zeros(0, self.kind), 0, 0
        self.add(keys, sizes, ids)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out, mask = np.full(len(keys), -1, np.int64), np.uint64(len(self.slot) - 1)
        live, step = np.arange(len(keys)), 0
        while len(live):
            got = self.slot[((keys[live] + np.uint64(step)) & mask).astype(np.int64)]
            some = got >= 0
            live, got = live[some], got[some]
            same = self.key[got] == keys[live]
            out[live[same]] = got[same]
            live, step = live[~same], step + 1
        return out

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """New and distinct keys, with their ids one after the other."""
        n, m = self.count + len(keys), self.filled + len(ids)
        if n > len(self.key):
            grow = lambda x, to: np.concatenate((x, np.zeros(to - len(x), x.dtype)))
            room = max(n, len(self.key) * 3 // 2)
            self.key, self.at, self.size, self.used = (grow(x, room) for x in (self.key, self.at, self.size, self.used))
        if m > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.filled], np.zeros(max(m, len(self.ids) * 3 // 2) - self.filled, self.kind)))
        new = np.arange(self.count, n)
        self.key[new], self.size[new], self.used[new] = keys, sizes, True
        self.at[new] = self.filled + np.cumsum(sizes) - sizes
        self.ids[self.filled : m] = ids
        self.count, self.filled = n, m
        if 2 * n >= len(self.slot):
            # twice to four times as many places as keys
            new, self.slot = np.arange(n), np.full(1 << (2 * n + 64).bit_length(), -1, np.int32)
        left, step, mask = new, 0, np.uint64(len(self.slot) - 1)
        while len(left):
            spot = ((self.key[left] + np.uint64(step)) & mask).astype(np.int64)
            free = self.slot[spot] < 0
            self.slot[spot[free]] = left[free]
            # of several that want one place the last got it
            left, step = left[self.slot[spot] != left], step + 1

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many each) of these numbers."""
        self.used[numbers] = True
        start, size = self.at[numbers].astype(np.int64), self.size[numbers].astype(np.int64)
        return runs(self.ids, start, size).astype("<u4"), size

    def shrink(self) -> None:
        """A full store keeps what was used since it was last full, but at most half of its bound."""
        if self.count > self.bound:
            kept = np.flatnonzero(self.used[: self.count])[-self.bound // 2 :]
            ids, sizes = self.get(kept)
            self._fill(self.key[kept], sizes, ids)
            self.used[: self.count] = False


def runs(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values of several ranges, one after the other."""
    ends = np.cumsum(size)
    return values[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class PieceIds:
    """Ids of texts as arrays of unsigned 32-bit numbers, by a `tokenizers` file."""

    def __init__(self, path: str, keeps_white: bool, store: int = STORE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keeps_white = Tokenizer.from_file(path), keeps_white
        self.store = _Store(store, "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        special = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in special.values()]
        # a special string is cut out before all else, so it keeps pieces apart; one of its own id marks the place
        self.mark, token = next(iter(special.items()))
        self.between = token.content

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _asked(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of pieces by the library."""
        texts, used = [[]], 0
        for p in pieces:
            if used > _ASK:
                texts.append([])
                used = 0
            texts[-1].append(p.decode())
            used += len(p)
        out, sizes = [], []
        for t in texts:
            (got,) = self.tokenizer.encode_batch_fast([self.between.join(t)], add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            at = np.concatenate(([-1], np.flatnonzero(ids == self.mark), [len(ids)]))
            sizes.append(np.diff(at) - 1)
            out.append(ids[ids != self.mark])
        return np.concatenate(out), np.concatenate(sizes)

    def _group(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text) of texts without special strings."""
        start, end = cuts(raw, edges, self.keeps_white)
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(len(edges) - 1, np.int64)
        length = end - start
        keys = piece_hashes(raw, start, np.minimum(length, LONGEST))
        long = np.flatnonzero(length > LONGEST)
        self.store.shrink()
        number = self.store.find(keys)
        number[long] = -2
        lost = np.flatnonzero(number == -1)
        if len(lost):
            new, one = np.unique(keys[lost], return_index=True)
            data = raw.tobytes()
            ids, sizes = self._asked([data[a:b] for a, b in zip(start[lost[one]].tolist(), end[lost[one]].tolist())])
            self.store.add(new, sizes, ids)
            number[lost] = self.store.find(keys[lost])
        if not len(long):
            ids, sizes = self.store.get(number)
        else:
            data = raw.tobytes()
            extra, more = self._asked([data[a:b] for a, b in zip(start[long].tolist(), end[long].tolist())])
            short = number >= 0
            self.store.used[number[short]] = True
            base = self.store.filled
            at, sizes = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
            at[short], sizes[short] = self.store.at[number[short]], self.store.size[number[short]]
            at[long], sizes[long] = base + np.cumsum(more) - more, more
            ids = runs(np.concatenate((self.store.ids[:base], extra)), at, sizes)
        total = np.concatenate(([0], np.cumsum(sizes)))
        upto = total[np.searchsorted(start, edges)]
        return ids, np.diff(upto)

    def ids(self, texts: pa.Array):
        """Yield the ids of each text of a string array; null is an empty text."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i, n = 0, len(texts)
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + _GROUP, "right")) - 1))
            raw = data[offsets[i] : offsets[j]]
            edges = offsets[i : j + 1] - offsets[i]
            held = raw.tobytes()
            odd = {k for k in range(i, j) if any(s in held[edges[k - i] : edges[k - i + 1]] for s in self.special)} if any(s in held for s in self.special) else ()
            if odd:
                # the library reads such a text whole
                for k in range(i, j):
                    own = raw[edges[k - i] : edges[k - i + 1]]
                    yield self.whole(own.tobytes().decode()) if k in odd else self._group(own, np.array([0, len(own)]))[0]
            else:
                ids, sizes = self._group(raw, edges)
                yield from np.split(ids, np.cumsum(sizes)[:-1])
            i = j


def piece_ids(path: str, keeps_white: bool) -> PieceIds:
    """One per worker process, kept from task to task."""
    return held(("pieces", path, keeps_white), lambda: PieceIds(path, keeps_white))
