import pandas as pd

from riskfold.constants import DAYS_PAST_DUE
from riskfold.operators.credit import BureauRoles, bureau_manual_block, loan_block, proportion_repaid, run_block
from pyspark.sql import functions as F


def test_loan_block_matches_definition(spark):
    rows = [(1, -30, "0"), (1, -29, "1"), (1, -28, "C"), (1, -28, "X"), (2, -100, "5"), (2, -99, None),
            (3, -5, None)]
    df = spark.createDataFrame(rows, "SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string")
    out = {r["SK_ID_BUREAU"]: r for r in run_block(df, "SK_ID_BUREAU", loan_block()).collect()}
    assert set(out) == {1, 2}                    # loan 3 has no status at all
    a = out[1]
    assert a["MONTHS_LOAN_DURATION"] == 4
    assert a["STATUS"] == "X"                    # latest month, tie -> greater status
    assert a["DPD_FLAG"] == 1
    assert a["1_y"] == 1 and a["C_y"] == 1 and a["0_x"] == 0
    assert a["MEAN_DAYS_PAST_DUE"] == sum(DAYS_PAST_DUE[s] for s in "01CX") / 4
    assert a["YEAR_LOAN_DURATION"] == 2.5        # -30 / -12 = 2.5 (half-even keeps 2.5)
    assert a["LOAN_TYPE_Long Term"] == 0 and a["LOAN_TYPE_Short Term"] == 1
    b = out[2]
    assert b["DPD_FLAG"] == 2                    # a null status counts as past due
    assert b["STATUS"] == "5" and b["YEAR_LOAN_DURATION"] == 8.3 and b["LOAN_TYPE_Long Term"] == 1


def test_year_rounding_is_half_even(spark):
    df = spark.createDataFrame([(1, -3, "0"), (2, -27, "0"), (3, -9, "0")], "SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string")
    out = {r["SK_ID_BUREAU"]: r["YEAR_LOAN_DURATION"] for r in run_block(df, "SK_ID_BUREAU", loan_block()).collect()}
    assert out == {1: 0.2, 2: 2.2, 3: 0.8}       # 0.25 -> 0.2, 2.25 -> 2.2, 0.75 -> 0.8


def test_proportion_repaid_rules(spark):
    cases = [(0.0, 0.0, 1.0), (-5.0, 10.0, 1.0), (5.0, 0.0, 0.0), (2.0, 8.0, 0.75), (1.0, -3.0, None)]
    df = spark.createDataFrame([(d, t) for d, t, _ in cases], "d double, t double")
    got = [r[0] for r in df.select(proportion_repaid(F.col("d"), F.col("t"))).collect()]
    assert got == [c[2] for c in cases]


def test_bureau_manual_block(spark):
    rows = [(1, "Active", "Car", None, 1.0, 1, None, 100.0, -5, 2),
            (1, "Closed", "Car", 7.0, 3.0, None, 10.0, 50.0, 10, 4),
            (2, None, "Cash", None, None, None, None, 10.0, 1, 0),
            (3, "Active", "Cash", None, None, 2, 1.0, None, -1, 0)]
    schema = ("SK_ID_CURR long, CREDIT_ACTIVE string, CREDIT_TYPE string, AMT_CREDIT_MAX_OVERDUE double, "
              "AMT_CREDIT_SUM_OVERDUE double, CNT_CREDIT_PROLONG int, AMT_CREDIT_SUM_DEBT double, "
              "AMT_CREDIT_SUM double, DAYS_CREDIT_ENDDATE int, CREDIT_DAY_OVERDUE int")
    df = spark.createDataFrame(rows, schema)
    block = bureau_manual_block(["Active", "Closed"], ["Car", "Cash"], BureauRoles())
    out = {r["SK_ID_CURR"]: r for r in run_block(df, "SK_ID_CURR", block).collect()}
    assert set(out) == {1}          # 2: no status, 3: no credit amount
    r = out[1]
    assert (r["Active"], r["Closed"], r["CREDIT_TYPE_Car"]) == (1, 1, 2)
    assert r["AMT_CREDIT_MAX_OVERDUE"] == 7.0 and r["CNT_CREDIT_PROLONG"] == 1
    assert r["AMT_CREDIT_SUM_DEBT"] == 110.0    # null debt filled from the credit sum
    assert r["AMT_CREDIT_SUM"] == 150.0
    assert abs(r["PROPORTION_REPAID"] - (1 - 110 / 150)) < 1e-12
    assert r["LOAN_ACTIVE_PAST_DEADLINE"] == 1 and r["CREDIT_DAY_OVERDUE"] == 3.0
