"""Error-free arithmetic in columns against exact rationals, to the last bit."""

import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from proselake.functions.exact import fused, two_product, two_sum
from proselake.plans import sentence_sql as X


def doubles(rng, n):
    return [rng.choice([1, -1]) * rng.random() * 2.0 ** rng.randint(-40, 40) for _ in range(n)]


def test_sums_and_products(spark):
    rng = random.Random(3)
    rows = list(zip(doubles(rng, 3000), doubles(rng, 3000), strict=True))
    d = spark.createDataFrame(rows, "a double, b double")
    pair = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    for a, b, s, p in d.select("a", "b", two_sum(F.col("a"), F.col("b"), pair), two_product(0.39, F.col("b"), pair)).collect():
        assert s["s"] == a + b and Fraction(s["s"]) + Fraction(s["e"]) == Fraction(a) + Fraction(b)
        assert p["s"] == 0.39 * b and Fraction(p["s"]) + Fraction(p["e"]) == Fraction(0.39) * Fraction(b)


@pytest.mark.parametrize("x", [0.39, -1.7, 1 + 2.0**-52, 3.0])
def test_fused(spark, x):
    """Also for sums in the middle of two doubles, where the far smaller rest decides."""
    rng = random.Random(4)
    rows = list(zip(doubles(rng, 3000), doubles(rng, 3000), strict=True))
    for _ in range(3000):
        # z such that x * y + z cancels, or lies at or beside a tie
        y = doubles(rng, 1)[0]
        p = x * y
        rows.append((y, rng.choice([-p, p * 2.0**53, -p * 2.0**52, p * 2.0 ** rng.randint(50, 106), float(int(p * 8)), 2.0 ** rng.randint(30, 90)])))
    for y, z, got in spark.createDataFrame(rows, "y double, z double").select("y", "z", fused(x, F.col("y"), F.col("z"))).collect():
        assert got == float(Fraction(x) * Fraction(y) + Fraction(z)), (y, z)


def test_ties(spark):
    """x * y = 1 + 2^-51 + 2^-104, so z = 2^53 puts the sum just above a middle, and z = 2^53 + 2 too."""
    y = x = 1 + 2.0**-52
    rows = [(s * y, s * z) for z in (2.0**53, 2.0**53 + 2, 2.0**54, 2.0**54 + 4, 2.0**52, -(2.0**53), -(2.0**53) - 2) for s in (1.0, -1.0)]
    for y, z, got in spark.createDataFrame(rows, "y double, z double").select("y", "z", fused(x, F.col("y"), F.col("z"))).collect():
        assert got == float(Fraction(x) * Fraction(y) + Fraction(z))


def test_grade_in_sql():
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        n = rng.randint(1, 10 ** rng.randint(1, 6))
        rows.append((i, n, rng.randint(1, n), rng.randint(0, 20 * n)))
    con = duckdb.connect()
    con.execute("CREATE TABLE r (i BIGINT, n BIGINT, m BIGINT, y BIGINT)")
    con.executemany("INSERT INTO r VALUES (?, ?, ?, ?)", rows)
    plain = 0
    for i, grade in con.sql(f"WITH {X.graded('r')} SELECT i, grade FROM g").fetchall():
        _, n, m, y = rows[i]
        a, c = n / m, 11.8 * (y / n)
        assert grade == float(Fraction(0.39) * Fraction(a) + Fraction(c)) - 15.59
        plain += grade != 0.39 * a + c - 15.59
    assert plain > 20
