"""Radix selection against numpy."""

import math
import random

import numpy as np
import pytest

from riskfold.operators import quantiles as qu


def test_bits_order_like_doubles():
    values = np.array([-math.inf, -1e300, -2.5, -1e-320, -0.0, 0.0, 5e-324, 1.0, 2.0, 1e308, math.inf, math.nan])
    bits = qu.ordered_bits(values)
    assert (np.diff(bits) >= 0).all() and bits[4] == bits[5]
    back = [qu.from_ordered(int(b)) for b in bits]
    assert back[:-1] == values[:-1].tolist() and math.isnan(back[-1])


@pytest.mark.parametrize("seed", range(2))
def test_quantiles(spark, seed):
    r = random.Random(seed)
    rows = [(r.gauss(0, 1e6), float(r.randrange(3)) if r.random() < 0.9 else None, 7.0, None, r.choice([-1, 1]) * 10.0 ** r.randrange(-200, 200),
             r.randrange(10 ** 12)) for _ in range(1 + 700 * seed)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, `odd name` long").repartition(5)
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = qu.quantile_values(df, df.columns, qs)
    for k, c in enumerate(df.columns):
        known = [row[k] for row in rows if row[k] is not None]
        for q in qs:
            want = float(np.quantile(known, q)) if known else None
            assert got[c, q] == want or math.isclose(got[c, q], want, rel_tol=1e-12), (c, q)


def test_empty_table(spark):
    assert qu.quantile_values(spark.createDataFrame([], "a double"), ["a"], [0.5]) == {("a", 0.5): None}


def test_moments(spark):
    r = random.Random(9)
    rows = [(r.gauss(1e9, 1.0), r.random() if r.random() < 0.7 else None, 4.0, None) for _ in range(900)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(7)
    got = qu.column_moments(df, df.columns)
    for k, c in enumerate("abc"):
        known = np.array([row[k] for row in rows if row[k] is not None])
        assert got[c][0] == len(known) and math.isclose(got[c][1], known.mean(), rel_tol=1e-12)
        assert math.isclose(got[c][2], known.std(), rel_tol=1e-6, abs_tol=1e-12)
    assert "d" not in got and qu.column_moments(df.limit(0), ["a"]) == {}
