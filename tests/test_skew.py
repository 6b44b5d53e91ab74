"""Hot keys: one client owns a third of all loans, one loan a third of all
monthly rows.  Results must stay exact and the aggregations must combine
map-side before the shuffle (partial aggregates in the physical plan)."""
import numpy as np
import pandas as pd

from riskfold.operators.aggregate import agg_numeric, aggregate_through
from riskfold.plans import catalog
from riskfold.plans import features as fp


def _skewed(spark, n=30000):
    rng = np.random.default_rng(11)
    client = np.where(rng.random(n) < 1 / 3, 7, rng.integers(0, 500, n))
    loans = pd.DataFrame({"SK_ID_CURR": client, "SK_ID_BUREAU": np.arange(n),
                          "AMT_CREDIT_SUM": rng.normal(1000, 50, n).round(2)})
    months = pd.DataFrame({"SK_ID_BUREAU": np.where(rng.random(3 * n) < 1 / 3, 0, rng.integers(0, n, 3 * n)),
                           "MONTHS_BALANCE": -rng.integers(0, 90, 3 * n),
                           "STATUS": rng.choice(list("012345CX"), 3 * n)})
    return spark.createDataFrame(loans), spark.createDataFrame(months), loans, months


def test_hot_client_aggregation_exact(spark):
    sl, _, loans, _ = _skewed(spark)
    got = agg_numeric(sl, "SK_ID_CURR", "b").toPandas().set_index("SK_ID_CURR").sort_index()
    ref = loans.groupby("SK_ID_CURR")["AMT_CREDIT_SUM"].agg(["count", "mean", "max", "min", "sum"])
    assert np.allclose(got["b_AMT_CREDIT_SUM_sum"], ref["sum"]) and (got["b_AMT_CREDIT_SUM_count"] == ref["count"]).all()
    plan = agg_numeric(sl, "SK_ID_CURR", "b")._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan      # map-side combine: the hot key is one row per task before the shuffle


def test_hot_loan_through_bridge(spark):
    sl, sm, loans, months = _skewed(spark)
    fast = aggregate_through(sm.withColumnRenamed("SK_ID_BUREAU", "SK_ID_PREV"), "SK_ID_PREV",
                             sl.selectExpr("SK_ID_BUREAU AS SK_ID_PREV", "SK_ID_CURR"), "SK_ID_CURR", "m")
    got = fast.toPandas().set_index("SK_ID_CURR").sort_index()
    ref = months.merge(loans[["SK_ID_BUREAU", "SK_ID_CURR"]], on="SK_ID_BUREAU").groupby("SK_ID_CURR")[
        "MONTHS_BALANCE"].agg(["count", "sum", "min"])
    assert (got["m_MONTHS_BALANCE_count"] == ref["count"]).all()
    assert (got["m_MONTHS_BALANCE_sum"] == ref["sum"]).all() and (got["m_MONTHS_BALANCE_min"] == ref["min"]).all()


def test_hot_loan_block(spark):
    _, sm, _, months = _skewed(spark)
    plan = catalog.default_plan()
    got = fp.loan_features(sm, plan).where("SK_ID_BUREAU = 0").first()
    hot = months[months.SK_ID_BUREAU == 0]
    assert got["MONTHS_LOAN_DURATION"] == len(hot)
    assert got["DPD_FLAG"] == int((~hot.STATUS.isin(["C", "X", "0"])).sum())
    last = hot[hot.MONTHS_BALANCE == hot.MONTHS_BALANCE.max()].STATUS.max()
    assert got["STATUS"] == last


def test_wide_roll_ups_move_narrow_rows(spark):
    """Loans of a client lie anywhere: they come together as rows before the wide buffers are made, and a hot
    client still combines to a buffer a partition."""
    sl, _, loans, _ = _skewed(spark)
    bureau = sl.selectExpr("*", "'F' AS CREDIT_ACTIVE", "'1-URGENT' AS CREDIT_TYPE")
    out = fp.client_history(bureau, "h", {"CREDIT_ACTIVE": ["F", "O"]})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_") < plan.index("REBALANCE_PARTITIONS_BY_COL")  # the printed plan starts at its end
    assert "avg(" not in plan
    got = out.toPandas().set_index("SK_ID_CURR").sort_index()
    ref = loans.groupby("SK_ID_CURR")["AMT_CREDIT_SUM"].agg(["count", "mean", "max", "min", "sum"])
    for stat in ref.columns:
        assert np.allclose(got[f"h_AMT_CREDIT_SUM_{stat}"], ref[stat])
    assert (got["h_CREDIT_ACTIVE_F_count"] == ref["count"]).all() and (got["h_CREDIT_ACTIVE_F_count_norm"] == 1).all()


def test_rows_through_a_bridge_move_once(spark):
    """Nothing is combined per loan before the bridge: the narrow rows move to the join, which broadcasts nothing, and
    one combine per client follows.  A loan that the bridge has twice counts twice."""
    sl, sm, loans, months = _skewed(spark)
    rows = sm.withColumnRenamed("SK_ID_BUREAU", "SK_ID_PREV")
    bridge = sl.selectExpr("SK_ID_BUREAU AS SK_ID_PREV", "SK_ID_CURR")
    bridge = bridge.unionByName(bridge.where("SK_ID_PREV < 10"))
    out = aggregate_through(rows, "SK_ID_PREV", bridge, "SK_ID_CURR", "m", vocabulary={"STATUS": ["C"]})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "Broadcast" not in plan
    got = out.toPandas().set_index("SK_ID_CURR").sort_index()
    both = months.merge(bridge.toPandas(), left_on="SK_ID_BUREAU", right_on="SK_ID_PREV")
    ref = both.groupby("SK_ID_CURR")["MONTHS_BALANCE"].agg(["count", "mean", "max", "min", "sum"])
    for stat in ref.columns:
        assert np.allclose(got[f"m_MONTHS_BALANCE_{stat}"], ref[stat])
    assert (got["m_STATUS_C_count"] == both.assign(c=both.STATUS == "C").groupby("SK_ID_CURR")["c"].sum()).all()


def test_loans_move_as_sums(spark):
    """Monthly rows come together before they are combined, and a loan reaches its client as the sums that its columns
    follow from.  Unknown and missing statuses, missing months and a loan listed twice keep their meaning."""
    plan = catalog.default_plan()
    months = spark.createDataFrame([(1, -3, "0"), (1, -2, "2"), (1, None, "?"), (1, -1, None), (2, None, None), (3, -60, "5"),
                                    (3, -59, "C"), (4, None, "X")], "SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string")
    bureau = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (8, 3), (8, 3), (8, 4), (None, 1)], "SK_ID_CURR long, SK_ID_BUREAU long")
    loans = fp.loan_level(months, plan)
    assert "REBALANCE_PARTITIONS_BY_COL" in loans._jdf.queryExecution().executedPlan().toString()
    assert len(loans.columns) < 20
    full = fp.loan_features(months, plan).drop("STATUS").toPandas()
    got = fp.client_loan_rollups(loans, bureau, plan).toPandas().set_index("SK_ID_CURR").sort_index()
    ref = bureau.toPandas().dropna().merge(full, on="SK_ID_BUREAU").groupby("SK_ID_CURR")
    assert list(got.index) == [7, 8]
    for c in ("MONTHS_LOAN_DURATION", "DPD_FLAG", "MEAN_DAYS_PAST_DUE", "YEAR_LOAN_DURATION", "LOAN_TYPE_Long Term", "2_y", "C_y"):
        for stat in ("count", "mean", "max", "min", "sum"):
            assert np.allclose(got[f"client_bureau_balance_{c}_{stat}"].astype(float), ref[c].agg(stat).astype(float), equal_nan=True), c
    assert got.loc[7, "client_bureau_balance_DPD_FLAG_sum"] == 4 and got.loc[7, "client_bureau_balance_MEAN_DAYS_PAST_DUE_mean"] == 41.25
    assert got.loc[7, "client_bureau_balance_STATUS_0_count_norm_mean"] == 0.25 / 3 and got.loc[7, "client_bureau_balance_MONTHS_BALANCE_count_count"] == 3
