"""Error-free sums and products of doubles as column expressions, and a fused multiply-add made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proselake.functions.text import let

#: Parts a double into two halves of its mantissa.
_SPLIT = float((1 << 27) + 1)


def _named(f, **columns: Column) -> Column:
    """`f` of a struct of these columns, each computed once."""
    return let(F.struct(*(c.alias(n) for n, c in columns.items())), f)


def two_sum(a: Column, b: Column, f) -> Column:
    """`f(s, e)`, where s is the rounded sum of two doubles and e what rounding took from it, exactly."""
    def error(v: Column) -> Column:
        back = v["s"] - v["a"]
        return (v["a"] - (v["s"] - back)) + (v["b"] - back)

    return _named(lambda v: _named(lambda w: f(w["s"], w["e"]), s=v["s"], e=error(v)), a=a, b=b, s=a + b)


def two_product(x: float, y: Column, f) -> Column:
    """`f(p, e)`, where p is the rounded product of a constant and a double and e what rounding took from it, exactly."""
    big = _SPLIT * x
    xh = big - (big - x)
    xl = x - xh

    def error(v: Column, high: Column) -> Column:
        low = v["y"] - high
        return ((F.lit(xh) * high - v["p"]) + F.lit(xh) * low + F.lit(xl) * high) + F.lit(xl) * low

    halves = lambda v: v.withField("h", v["t"] - (v["t"] - v["y"]))
    return _named(lambda v: let(halves(v), lambda v: _named(lambda w: f(w["p"], w["e"]), p=v["p"], e=error(v, v["h"]))), y=y, p=F.lit(x) * y, t=F.lit(_SPLIT) * y)


def fused(x: float, y: Column, z: Column) -> Column:
    """x * y + z, rounded once, for values far from the ends of the doubles' range.

    The exact value is s + w + e with a rounded s, a smaller w and a far smaller e. Rounding s + w gives it, unless s + w lies in
    the middle of two doubles: there the sign of e decides.
    """
    def last(s: Column, w: Column, e: Column) -> Column:
        # q is the remainder of r; in a tie r + 2q is the other neighbour, and exact
        other = lambda v, n, rest: F.when((v["q"] != 0) & (rest == 0) & (v["e"] * F.signum(v["q"]) > 0), n).otherwise(v["r"])
        return _named(lambda v: two_sum(v["s"], v["w"], lambda r, q: _named(lambda u: two_sum(u["r"], u["q"] * 2, lambda n, rest: other(u, n, rest)), r=r, q=q, e=v["e"])), s=s, w=w, e=e)

    def summed(p: Column, low: Column) -> Column:
        return _named(lambda v: two_sum(v["p"], z, lambda s, t: _named(lambda u: two_sum(u["t"], v["low"], lambda w, e: last(u["s"], w, e)), s=s, t=t)), p=p, low=low)

    return two_product(x, y, summed)
