import numpy as np
import pandas as pd

from riskfold.operators.sample import kfold, sample_fraction, semi_either, stratified_split
from riskfold.operators.select import prune_by_group, prune_greedy, spearman_with_target
from riskfold.sources.binding import credit_tables
from riskfold.operators.sample import relation_sample
from conftest import SF_SMALL


def test_sampling_is_deterministic_and_stratified(spark):
    df = spark.range(20000).selectExpr("id AS SK_ID_CURR", "CAST(id % 10 = 0 AS INT) AS TARGET")
    a = sample_fraction(df, "SK_ID_CURR", 0.1).collect()
    b = sample_fraction(df.repartition(7), "SK_ID_CURR", 0.1).collect()
    assert sorted(a) == sorted(b) and 1700 < len(a) < 2300
    split = stratified_split(df, "SK_ID_CURR", "TARGET")
    assert {(r["TARGET"], r["split"]): r["count"] for r in split.groupBy("TARGET", "split").count().collect()} == {
        (0, "test"): 3600, (0, "train"): 14400, (1, "test"): 400, (1, "train"): 1600}
    folds = kfold(split.where("split = 'train'"), "SK_ID_CURR", "TARGET")
    sizes = {(r["TARGET"], r["fold"]): r["count"] for r in folds.groupBy("TARGET", "fold").count().collect()}
    assert sizes == {(0, k): 4800 for k in range(3)} | {(1, 0): 534, (1, 1): 533, (1, 2): 533}
    again = kfold(split.where("split = 'train'").repartition(5), "SK_ID_CURR", "TARGET")
    assert sorted(folds.collect()) == sorted(again.select(*folds.columns).collect())


def test_draws_are_independent_and_rows_without_label_have_none(spark):
    df = spark.range(6000).selectExpr("id AS SK_ID_CURR", "CASE WHEN id < 5999 THEN CAST(id % 4 = 0 AS INT) END AS TARGET")
    sampled = stratified_split(sample_fraction(df, "SK_ID_CURR", 0.3), "SK_ID_CURR", "TARGET")
    shares = {r["split"]: r["count"] for r in sampled.groupBy("split").count().collect()}
    assert abs(shares["test"] / (shares["test"] + shares["train"]) - 0.2) < 0.01
    assert stratified_split(df, "SK_ID_CURR", "TARGET").where("SK_ID_CURR = 5999").first()["split"] is None


def test_semi_either(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "a long, b long")
    ka = spark.createDataFrame([(1,), (1,)], "a long")
    kb = spark.createDataFrame([(30,), (10,)], "b long")
    assert sorted(r["a"] for r in semi_either(df, ka, "a", kb, "b").collect()) == [1, 3]


def test_relation_sample_keeps_relations(spark):
    t = credit_tables(spark, SF_SMALL)
    s = relation_sample(t, 0.2)
    clients = {r[0] for r in s["current_app"].select("SK_ID_CURR").collect()}
    assert clients
    assert {r[0] for r in s["bureau"].select("SK_ID_CURR").distinct().collect()} <= clients
    loans = {r[0] for r in s["bureau"].select("SK_ID_BUREAU").collect()}
    assert {r[0] for r in s["bureau_balance"].select("SK_ID_BUREAU").distinct().collect()} <= loans


def test_spearman_matches_pandas_pairwise(spark):
    rng = np.random.default_rng(5)
    n = 400
    y = (rng.random(n) < 0.3).astype(float)
    x1 = np.round(y + rng.normal(0, 1, n), 1)
    x2 = np.where(rng.random(n) < 0.3, np.nan, np.round(rng.normal(0, 1, n) - y, 0))
    pdf = pd.DataFrame({"x1": x1, "x2": x2, "y": y})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "x1 double, x2 double, y double")
    got = {r["feature"]: r["rho"] for r in spearman_with_target(df, ["x1", "x2"], "y").collect()}
    for c in ("x1", "x2"):
        both = pdf[[c, "y"]].dropna()          # pairwise-complete rows, ranked again
        ref = np.corrcoef(both[c].rank(method="average"), both["y"].rank(method="average"))[0, 1]
        assert abs(got[c] - ref) < 1e-9


def test_prune_greedy_by_hand():
    order = ["p", "q", "r", "s", "t"]
    # p beats its neighbour q; q is out, so its link to the stronger r counts no more
    assert prune_greedy([("p", "q"), ("q", "r")], order, {"p": 0.4, "q": 0.2, "r": 0.9}) == {"q"}
    # a tie keeps the earlier one; an unknown strength is the weakest
    assert prune_greedy([("s", "t")], order, {"s": 0.3, "t": 0.3}) == {"t"}
    assert prune_greedy([("s", "t")], order, {"t": 0.1}) == {"s"}
    # p loses to q and still takes r out
    assert prune_greedy([("p", "q"), ("p", "r")], order, {"p": 0.5, "q": 0.6, "r": 0.1}) == {"p", "r"}
    # pairs may come in either order; differences behind the twelfth decimal are none
    assert prune_greedy([("r", "q")], order, {"q": 0.7, "r": 0.7 + 1e-15}) == {"r"}
    assert prune_greedy([], order, {}) == set()


def test_prune_by_group_by_hand():
    order = ["p", "q", "r", "s"]
    # the group of r is {r, p, q} and keeps q; the group of q is {q, p} and keeps q
    assert prune_by_group([("p", "q"), ("q", "r"), ("p", "r")], order, {"p": 0.1, "q": 0.3, "r": 0.2}) == {"p", "r"}
    assert prune_by_group([("r", "s")], order, {"r": 0.5, "s": 0.5}) == {"s"}
    assert prune_by_group([("r", "s")], order, {}) == {"r"}  # the group's own feature stays


def _pairwise_spearman(pdf, a, b):
    both = pdf[[a, b]].dropna()
    ra, rb = both[a].rank(method="average"), both[b].rank(method="average")
    if ra.std() == 0 or rb.std() == 0:
        return None
    return float(np.corrcoef(ra, rb)[0, 1])


def test_spearman_matrix_pairwise_complete(spark):
    from riskfold.operators.select import null_pattern_groups, spearman_matrix
    rng = np.random.default_rng(9)
    n = 300
    base = rng.normal(0, 1, n)
    mask = rng.random(n) < 0.3
    pdf = pd.DataFrame({"k": np.arange(n),
                        "a": np.round(base, 1),
                        "b": np.where(mask, np.nan, np.round(base * 2 + rng.normal(0, 0.1, n), 1)),
                        "c": np.where(mask, np.nan, rng.integers(0, 4, n).astype(float)),
                        "d": np.where(rng.random(n) < 0.2, np.nan, -base)})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                               "k long, a double, b double, c double, d double")
    feats = ["a", "b", "c", "d"]
    assert sorted(map(sorted, null_pattern_groups(df, feats, "k"))) == [["a"], ["b", "c"], ["d"]]
    got = {(r["feature_i"], r["feature_j"]): r["rho"] for r in spearman_matrix(df, feats, "k").collect()}
    assert len(got) == 6
    for (x, y), rho in got.items():
        ref = _pairwise_spearman(pdf, x, y)
        assert abs(rho - ref) < 1e-9, (x, y, rho, ref)
