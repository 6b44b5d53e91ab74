import numpy as np
import pandas as pd

from riskfold.operators.evaluate import (best_threshold, business_cost, classification_metrics, grid_bucket,
                                         roc_auc, threshold_grid, threshold_sweep)
from riskfold.operators.rank import average_ranks
from pyspark.sql import functions as F


def _scores(spark, n=2000, seed=1):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.2).astype(int)
    s = np.round(np.clip(rng.normal(0.3 + 0.3 * y, 0.2), 0, 1), 2)  # many ties
    s[:5] = threshold_grid()[:5]                                     # scores exactly on the grid
    return spark.createDataFrame(pd.DataFrame({"y": y, "s": s})), y, s


def test_average_ranks_match_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500).astype(str), "v": rng.integers(0, 20, 500).astype(float)})
    got = average_ranks(spark.createDataFrame(pdf), ["g"], "v").toPandas()
    ref = pdf.assign(rank=pdf.groupby("g")["v"].rank(method="average")).drop_duplicates(["g", "v"])
    m = got.merge(ref, on=["g", "v"], suffixes=("", "_ref"))
    assert len(m) == len(ref) == len(got)
    assert np.allclose(m["rank"], m["rank_ref"])


def test_grid_bucket_exact_on_grid(spark):
    grid = threshold_grid()
    vals = grid + [0.0, 1.0, 0.5, 0.0099999, 0.99000001]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    got = [r[0] for r in df.select(grid_bucket(F.col("s"), grid)).collect()]
    assert got == [sum(t <= v for t in grid) for v in vals]


def test_threshold_sweep_matches_loop(spark):
    df, y, s = _scores(spark)
    sweep = threshold_sweep(df, "y", "s").toPandas().sort_values("threshold_index")
    best_cost, best_t = float("inf"), None
    for i, t in enumerate(threshold_grid()):
        p = (s >= t).astype(int)
        tn, fp = int(((y == 0) & (p == 0)).sum()), int(((y == 0) & (p == 1)).sum())
        fn, tp = int(((y == 1) & (p == 0)).sum()), int(((y == 1) & (p == 1)).sum())
        row = sweep.iloc[i]
        assert (row.tn, row.fp, row.fn, row.tp) == (tn, fp, fn, tp)
        cost = fn * 10 + fp - tn
        assert row.business_cost == cost
        if cost < best_cost:
            best_cost, best_t = cost, t
    best = best_threshold(threshold_sweep(df, "y", "s")).first()
    assert best["threshold"] == best_t and best["business_cost"] == best_cost
    m = classification_metrics(best_threshold(threshold_sweep(df, "y", "s"))).first()
    assert 0 <= m["accuracy"] <= 1


def test_roc_auc_matches_pairwise(spark):
    df, y, s = _scores(spark, n=600)
    pos, neg = s[y == 1], s[y == 0]
    ref = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(roc_auc(df, "y", "s").first()["roc_auc"] - ref) < 1e-12


def test_business_cost(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1), (1, 0)], "y int, p int")
    r = business_cost(df, "y", "p").first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (1, 1, 2, 1)
    assert r["business_cost"] == 2 * 10 + 1 * 1 + 1 * -1


def test_prefix_counts_move_the_rows_once(spark):
    """Running counts over several ranges and batches, groups with nulls and NaN among the values: as counted by hand,
    and the stored ranges need no exchange any more."""
    import math
    import random

    from riskfold.operators.rank import prefix_counts
    rng = random.Random(2)
    rows = [(g, x, rng.randint(1, 5)) for g in ("a", "b", "c") for x in rng.sample(range(5000), 900)] + [("d", float("nan"), 3), ("d", -1.0, 2)]
    df = spark.createDataFrame([(g, float(x), n) for g, x, n in rows], "g string, x double, n long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = prefix_counts(df, ["g"], "x", ["n"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = {(r["g"], -2.0 if math.isnan(r["x"]) else r["x"]): r["n_before"] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "hashpartitioning" not in plan and "Window" not in plan
    assert found == {(g, -2.0 if x != x else float(x)): 2 if x != x else sum(n for h, y, n in rows if h == g and y < x) for g, x, _ in rows}
