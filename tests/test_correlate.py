"""Strong Spearman pairs against pandas, with null patterns that cross."""

import random

import pandas as pd
import pytest

from riskfold.operators.correlate import strong_pairs


def table(n=240, seed=2):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        base, other = r.gauss(0, 1), r.gauss(0, 1)
        many, few = k % 3 == 0, k % 40 == 0
        rows.append((k, base, base + r.gauss(0, 0.3), None if many else base * 2 + r.gauss(0, 0.5), None if many else -other,
                     None if few else other + r.gauss(0, 0.2), float(r.randrange(2)), None if k % 2 else float(round(base)), 3.0, None,
                     None if few else float(k % 5)))
    return rows


COLUMNS = ["a", "b", "c", "d", "e", "flag", "g", "same", "none", "h"]


@pytest.mark.parametrize("threshold", [0.0, 0.5, 0.9])
def test_strong_pairs(spark, threshold):
    rows = table()
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in COLUMNS)).repartition(4)
    want = pd.DataFrame(rows, columns=["k", *COLUMNS])[COLUMNS].astype(float).corr("spearman", min_periods=2)
    got = {(r["feature_i"], r["feature_j"]): r["rho"] for r in strong_pairs(df, COLUMNS, "k", threshold).collect()}
    expected = {(a, b): want.loc[a, b] for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1:] if abs(want.loc[a, b]) > max(threshold, 1e-12)}
    assert {k for k, v in got.items() if abs(v) > 1e-12} == set(expected)
    assert all(abs(got[k] - v) < 1e-9 for k, v in expected.items())


def test_few_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "k long, a double, b double")
    assert strong_pairs(df, ["a", "b"], "k", 0.1).count() == 0
    assert strong_pairs(df.limit(0), ["a", "b"], "k", 0.1).count() == 0


def test_cells_do_not_move_as_rows(spark, monkeypatch):
    """Many blocks and ranges give the same pairs, and what moves is the values of blocks, not a row a cell."""
    from riskfold.operators import runs

    rows = [(k, None if r[1] is None else float(round(3 * r[1])), *r[2:]) for k, r in enumerate(table(2000, 7))]
    want = pd.DataFrame(rows, columns=["k", *COLUMNS])[COLUMNS].astype(float).corr("spearman", min_periods=2)
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in COLUMNS)).repartition(2)
    monkeypatch.setattr(runs, "CELLS", 300 * len(COLUMNS))
    monkeypatch.setattr(runs, "RANGE_ROWS", 150)
    got = {(r["feature_i"], r["feature_j"]): r["rho"] for r in strong_pairs(df, COLUMNS, "k", 0.3).collect()}
    expected = {(a, b): want.loc[a, b] for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1:] if abs(want.loc[a, b]) > 0.3}
    assert set(got) == set(expected)
    assert all(abs(got[k] - v) < 1e-9 for k, v in expected.items())
    records = runs.blocks(df, COLUMNS)
    cut = runs.pieces(records, runs.ranges(records, len(rows)))
    moved = cut.groupBy("f").agg({"*": "count", "range": "max"}).collect()
    assert sum(r["count(1)"] for r in moved) * 10 < len(rows) * len(COLUMNS)
    assert max(r["max(range)"] for r in moved) > 3


def test_target_ranks_over_ranges(spark, monkeypatch):
    from riskfold.operators import runs
    from riskfold.operators.select import spearman_with_target

    r = random.Random(3)
    rows = [(float("nan") if k % 50 == 0 else r.gauss(0, 1), None if k % 7 == 0 else float(r.randrange(5)), 1.0, None, k % 3 // 2) for k in range(900)]
    names = ["x", "y", "same", "none"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", label int").repartition(3)
    whole = {x["feature"]: x["rho"] for x in spearman_with_target(df, names, "label").collect()}
    monkeypatch.setattr(runs, "CELLS", 400)
    monkeypatch.setattr(runs, "RANGE_ROWS", 100)
    cut = {x["feature"]: x["rho"] for x in spearman_with_target(df, names, "label").collect()}
    # NaN is one value above every number
    want = pd.DataFrame([(9.0 if a != a else a, b, c, d, e) for a, b, c, d, e in rows], columns=[*names, "label"]).astype(float)
    for c in ("x", "y"):
        both = want[[c, "label"]].dropna()
        assert abs(whole[c] - both.corr("spearman").iloc[0, 1]) < 1e-9 and abs(cut[c] - whole[c]) < 1e-12
    assert whole["same"] is None and cut["same"] is None and "none" not in whole
