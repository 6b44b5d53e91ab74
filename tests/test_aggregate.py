import math

import pandas as pd

from riskfold.operators.aggregate import (agg_numeric, aggregate_through, coded_value_at_latest, count_categorical,
                                          fit_vocabulary)
from pyspark.sql import functions as F


def test_agg_numeric_five_statistics_of_numbers_only(spark):
    rows = [(7, 1, 2.5, "x", 90), (7, 4, None, "y", 91), (8, -3, 0.5, None, 92)]
    df = spark.createDataFrame(rows, "client long, months int, paid double, status string, SK_ID_LOAN long")
    out = {r["client"]: r.asDict() for r in agg_numeric(df, "client", "h").collect()}
    stats = [f"h_{c}_{s}" for c in ("months", "paid") for s in ("count", "mean", "max", "min", "sum")]
    assert sorted(out[7]) == sorted(["client", *stats])
    assert [out[7][c] for c in stats] == [2, 2.5, 4, 1, 5, 1, 2.5, 2.5, 2.5, 2.5]
    assert [out[8][c] for c in stats] == [1, -3.0, -3, -3, -3, 1, 0.5, 0.5, 0.5, 0.5]


def test_agg_numeric_null_semantics(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0), (None, 9.0)], "k long, x double")
    out = {r["k"]: r for r in agg_numeric(df, "k", "t").collect()}
    assert set(out) == {1, 2}                       # null key dropped
    assert out[1]["t_x_count"] == 0 and out[1]["t_x_mean"] is None and out[1]["t_x_max"] is None
    assert out[1]["t_x_sum"] == 0                   # sum of all-null is 0


def test_count_categorical_null_counts_as_row(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (1, "b"), (2, "a")], "k long, c string")
    vocab = fit_vocabulary(df, ["c"])
    assert vocab == {"c": ["a", "b"]}
    out = {r["k"]: r for r in count_categorical(df, "k", "t", vocab).collect()}
    assert out[1]["t_c_a_count"] == 1 and math.isclose(out[1]["t_c_a_count_norm"], 1 / 3)
    assert out[2]["t_c_b_count"] == 0


def test_fit_vocabulary_bounds(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    try:
        fit_vocabulary(df, ["c"], max_values=10)
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_aggregate_through_equals_join_then_aggregate(spark):
    child = spark.createDataFrame([(10, 1.0, "x"), (10, None, "y"), (11, 5.0, "x"), (12, 2.0, None), (13, 7.0, "x")],
                                  "SK_ID_PREV long, v double, c string")
    bridge = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "SK_ID_PREV long, SK_ID_CURR long")
    fast = aggregate_through(child, "SK_ID_PREV", bridge, "SK_ID_CURR", "h", vocabulary={"c": ["x", "y"]})
    joined = child.join(bridge, "SK_ID_PREV")
    slow = agg_numeric(joined, "SK_ID_CURR", "h").join(
        count_categorical(joined, "SK_ID_CURR", "h", {"c": ["x", "y"]}), "SK_ID_CURR")
    a = fast.toPandas().set_index("SK_ID_CURR").sort_index()
    b = slow.toPandas().set_index("SK_ID_CURR").sort_index()[a.columns]
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_coded_value_at_latest_skips_null_and_breaks_ties(spark):
    df = spark.createDataFrame([(1, 5, "A"), (1, 5, "B"), (1, 7, None), (1, 2, "Z"), (2, None, "Q"), (3, 1, None)],
                               "k long, m int, s string")
    packed, decode = coded_value_at_latest("s", "m", ["A", "B", "Q", "Z"])
    out = df.groupBy("k").agg(packed.alias("p")).select("k", decode(F.col("p")).alias("last"))
    assert {r["k"]: r["last"] for r in out.collect()} == {1: "B", 2: "Q", 3: None}
