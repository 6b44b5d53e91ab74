import numpy as np
import pandas as pd

from riskfold.operators.profile import distinct_counts, exact_quantiles, missing_values, numeric_profile, top_values


def _frame(spark, n=5000):
    rng = np.random.default_rng(3)
    hot = np.where(rng.random(n) < 0.35, 0.0, rng.normal(10, 3, n))    # a third of rows share one value
    cont = rng.normal(0, 1, n)
    sparse = np.where(rng.random(n) < 0.5, np.nan, rng.integers(0, 5, n))
    pdf = pd.DataFrame({"hot": hot, "cont": cont, "sparse": sparse})
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "hot double, cont double, sparse double"), pdf


def test_exact_quantiles_match_numpy_with_selection_rounds(spark):
    df, pdf = _frame(spark)
    for q in (0.5, 0.37, 0.9):
        got = {r["feature"]: r["quantile"] for r in
               exact_quantiles(df, ["hot", "cont", "sparse"], q, final_size=50, grid=20, accuracy=200).collect()}
        for c in ("hot", "cont", "sparse"):
            ref = float(np.quantile(pdf[c].dropna(), q))
            assert abs(got[c] - ref) < 1e-9, (c, q, got[c], ref)


def test_numeric_profile_and_missing(spark):
    df, pdf = _frame(spark)
    prof = {r["feature"]: r for r in numeric_profile(df).collect()}
    assert abs(prof["cont"]["mean"] - pdf["cont"].mean()) < 1e-9
    assert abs(prof["cont"]["std"] - pdf["cont"].std()) < 1e-9     # sample std
    assert abs(prof["hot"]["median"] - pdf["hot"].median()) < 1e-9
    miss = {r["feature"]: r for r in missing_values(df).collect()}
    assert set(miss) == {"sparse"}
    assert miss["sparse"]["missing_values"] == int(pdf["sparse"].isna().sum())
    assert miss["sparse"]["percentage"] == round(100 * pdf["sparse"].isna().mean(), 2)


def test_distinct_and_top_values(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("c",), ("c",), ("a",)], "x string")
    assert distinct_counts(df).first()["n_unique"] == 3
    assert [(r["x"], r["count"]) for r in top_values(df, "x", 2).collect()] == [("a", 3), ("c", 2)]


def test_column_overview(spark):
    from riskfold.operators.profile import column_overview

    rows = [(k % 7, None if k % 3 else "ab"[k % 2], float(k)) for k in range(3000)]
    df = spark.createDataFrame(rows, "a long, b string, `c d` double")
    got = {r["feature"]: r for r in column_overview(df, 1).collect()}
    assert [(r["rows"], r["missing"], r["n_unique"], r["top_values"]) for r in (got["a"], got["b"], got["c d"])] == [
        (3000, 0, 7, None), (3000, 2000, 2, "a: 500"), (3000, 0, 3000, None)]
    sketch = {r["feature"]: r["n_unique"] for r in column_overview(df, 1, rsd=0.02).collect()}
    assert sketch["a"] == 7 and abs(sketch["c d"] - 3000) <= 3000 * 0.08  # four standard deviations
    assert column_overview(df.limit(0)).where("rows = 0 AND n_unique = 0").count() == 3
