"""Counts of many phrases in one pass over a text, each as if it were searched for alone: leftmost, without overlaps of its own."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from proselake.functions.kept import kept


class PhraseSet:
    """An automaton over all phrases. It reports every occurrence of each; of one phrase's those count that begin at or after
    the end of the last one counted. An empty phrase occurs nowhere."""

    def __init__(self, phrases: list[str]):
        import ahocorasick

        self.size, self.automaton, self.some = len(phrases), ahocorasick.Automaton(), False
        places: dict[str, list[int]] = {}
        for k, p in enumerate(phrases):
            if p:
                places.setdefault(p, []).append(k)
        for p, ks in places.items():
            self.automaton.add_word(p, (len(p), ks))
            self.some = True
        if self.some:
            self.automaton.make_automaton()

    def found(self, text: str) -> dict[int, int]:
        """The counts of the phrases that occur, by their places in the list."""
        counts: dict[int, int] = {}
        ends: dict[int, int] = {}
        for end, (n, ks) in self.automaton.iter(text) if self.some else ():
            if end - n >= ends.get(ks[0], -1):
                ends[ks[0]] = end
                for k in ks:
                    counts[k] = counts.get(k, 0) + 1
        return counts


def phrase_counts(phrases):
    """A function of a text column: an array with the count of each phrase. A worker makes the automaton once."""
    phrases = list(phrases)
    key = ("phrases", hashlib.sha256("\0".join(phrases).encode()).hexdigest())

    def run(texts: pa.Array) -> pa.Array:
        known = kept(key, lambda: PhraseSet(phrases))
        out = np.zeros((len(texts), len(phrases)), np.int64)
        for row, t in zip(out, texts, strict=True):
            for k, n in known.found(t.as_py() or "").items():
                row[k] = n
        ends = np.arange(len(texts) + 1, dtype=np.int32) * len(phrases)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    return F.arrow_udf(run, "array<bigint>")


def phrase_hits(phrases):
    """A function of a text column: [{phrase, count}] of the phrases that occur, in the order of the list."""
    phrases = list(phrases)
    key = ("phrases", hashlib.sha256("\0".join(phrases).encode()).hexdigest())

    def run(texts: pa.Array) -> pa.Array:
        known = kept(key, lambda: PhraseSet(phrases))
        found = [sorted(known.found(t.as_py() or "").items()) for t in texts]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array([phrases[k] for f in found for k, _ in f], pa.string()), pa.array([n for f in found for _, n in f], pa.int64())], ["phrase", "count"])
        return pa.ListArray.from_arrays(pa.array(ends), rows)

    return F.arrow_udf(run, "array<struct<phrase:string,count:bigint>>")
