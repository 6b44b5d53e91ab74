import os

import duckdb
import pytest

import __spark_entry__ as entry
from riskfold.plans import catalog
from riskfold.plans import model as md
from riskfold.constants import DECISION_THRESHOLD
from riskfold.sources.binding import binding_vocabulary
from riskfold.sources.tables import TABLES
from riskfold.operators.aggregate import fit_vocabulary
from riskfold.sources.binding import credit_tables
from conftest import SF_SMALL

import sys
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from oracle_check import frame_equal  # noqa: E402


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "SK_ID_CURR" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_declared_vocabulary_equals_fitted(spark):
    t = credit_tables(spark, SF_SMALL)
    declared = binding_vocabulary()
    for table in ("bureau", "previous_application", "credit_card_balance"):
        fitted = fit_vocabulary(t[table], list(declared[table]))
        for col, values in fitted.items():
            assert set(values) <= set(declared[table][col])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    ref = con.execute(entry.oracle_sql()[name]).df()
    assert frame_equal(got, ref) == []


def test_model_scores_and_routing(spark):
    scored = catalog.model_scores(spark, SF_SMALL)
    rows = scored.collect()
    assert rows and all(0 <= r["score"] <= 100 for r in rows)
    for r in rows:
        assert r["decision"] == (md.NOT_LIKELY if r["score"] >= DECISION_THRESHOLD else md.LIKELY)
    assert catalog.model_global_explanation(spark, SF_SMALL).count() == 15


def test_stream_scoring(spark, scratch):
    from riskfold.plans import features as fp
    from riskfold.streaming.scoring import application_stream, scored_stream, start_scoring
    t = credit_tables(spark, SF_SMALL)
    plan = catalog.default_plan()
    model = catalog.trained_model(spark, SF_SMALL)
    history = fp.bureau_block(t, plan).join(fp.history_block(t, plan), "SK_ID_CURR", "left")
    src = os.path.join(scratch, "in")
    t["current_app"].write.json(src)
    stream = application_stream(spark, src, t["current_app"].schema)
    q = start_scoring(scored_stream(stream, history, plan, model), os.path.join(scratch, "out"),
                      os.path.join(scratch, "ckpt"), once=True)
    q.awaitTermination(300)
    out = spark.read.parquet(os.path.join(scratch, "out"))
    batch = {r["SK_ID_CURR"]: r["score"] for r in catalog.model_scores(spark, SF_SMALL).collect()}
    assert {r["SK_ID_CURR"]: r["score"] for r in out.collect()} == pytest.approx(batch)
    assert set(out.columns) >= {"SK_ID_CURR", "score", "decision"}


def test_cross_validation_and_early_stopping(spark):
    from pyspark.sql import functions as F
    from riskfold.operators.sample import kfold
    data, manifest = catalog._bureau_features(spark, SF_SMALL)  # the whole bureau block
    found = md.cross_validate(kfold(data, "SK_ID_CURR", "TARGET", k=2), manifest, [{"C": 1.0}])
    assert len(found) == 1 and 0 <= found[0][1] <= 1
    flagged = data.withColumn("is_val", F.col("split") == "test")
    gbt = md.fit(flagged, manifest, kind="gbt", gbt_params={"maxIter": 5, "maxDepth": 3}, validation_col="is_val")
    imp = md.feature_importances(gbt)
    assert imp.count() == len(manifest)


def test_leaderboard_needs_no_query_before_it(spark):
    catalog._MODELS.clear()
    assert catalog.run_leaderboard(spark, SF_SMALL).count() == 2


def test_tree_model_is_whole(spark):
    """The model behind run_leaderboard and zero_importance_features grows until 200 rounds have brought
    no larger validation AUC (or 2000 are done), and ends with the best of them."""
    import numpy as np
    from riskfold.operators import trees as tr
    from riskfold.operators.quantiles import as_array
    catalog._TREES.clear()
    model = catalog.tree_model(spark, SF_SMALL)
    data = catalog._labelled(spark, SF_SMALL)
    best = len(model.booster.trees)
    whole = tr.fit_trees(data.where("split = 'train'"), model.features, "TARGET", catalog.TREE_PARAMS, min(best + 200, 2000))
    rows = data.where("split = 'test'").select("TARGET", as_array(model.features)).collect()
    bins = tr.to_bins(np.array([[np.nan if v is None else v for v in r["values"]] for r in rows]), whole.edges)
    label, margin, aucs = np.array([r["TARGET"] for r in rows]), np.full(len(rows), whole.booster.base), []
    for tree in whole.booster.trees:
        margin = margin + tree.values(bins)
        pos, neg = margin[label == 1][:, None], margin[label == 0][None, :]
        aucs.append(((pos > neg) + (pos == neg) / 2).mean())
    aucs = np.array(aucs).round(12)
    assert len(aucs) == min(best + 200, 2000) and aucs.argmax() + 1 == best
    used = {model.features[f] for t in whole.booster.trees[:best] for f in t.feature if f >= 0}
    zero = {r["feature"] for r in catalog.zero_importance_features(spark, SF_SMALL).collect()}
    assert zero == set(model.features) - used
    board = {r["run_id"]: r for r in catalog.run_leaderboard(spark, SF_SMALL).collect()}
    assert abs(float(board["trees"]["val_roc_auc"]) - aucs[best - 1]) < 1e-9


def test_leaderboard_scores_once(spark, monkeypatch):
    """Every metric of a model reads stored probabilities, and does not score the wide rows again."""
    seen, auc = [], catalog.ev.roc_auc
    monkeypatch.setattr(catalog.ev, "roc_auc", lambda df, *a: seen.append(df) or auc(df, *a))
    assert catalog.run_leaderboard(spark, SF_SMALL).count() == 2 and len(seen) == 2
    for df in seen:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "Generate" not in plan and df.columns == ["TARGET", "probability"]


def test_checkpoint_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace as N
    from riskfold.session import checkpoint_dir
    none = N(get=lambda key, default=None: default)
    far = N(conf=none, sparkContext=N(getConf=lambda: none, getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(far)


def test_fused_imputer_scaler_equals_two_pass(spark):
    import numpy as np
    import pandas as pd
    from riskfold.operators.model_prep import Imputer, Standardizer, fit_imputer_and_scaler
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": np.where(rng.random(500) < 0.3, np.nan, rng.normal(5, 2, 500)),
                        "b": rng.integers(0, 3, 500).astype(float),
                        "c": np.full(500, np.nan)})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double")
    imp, sc = fit_imputer_and_scaler(df, ["a", "b", "c"])
    imp2 = Imputer.fit_median(df, ["a", "b", "c"])
    sc2 = Standardizer.fit(imp2.transform(df), ["a", "b", "c"])
    for c in "abc":
        assert abs(imp.values[c] - imp2.values[c]) < 1e-12
        assert abs((sc.means[c] or 0) - (sc2.means[c] or 0)) < 1e-9
        assert abs(sc.stds[c] - sc2.stds[c]) < 1e-9


def test_labelled_features_lie_stored(spark):
    """Jobs over the labelled feature table only scan: no join, and no exchange of the wide rows in every pass."""
    from riskfold.plans import catalog
    data, feats = catalog._labelled(spark, SF_SMALL), catalog.feature_table(spark, SF_SMALL)
    plan = data._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    labels = catalog._tables(spark, SF_SMALL)["client_labels"]
    assert data.columns == [*feats.columns, "TARGET", "split"]
    got = {(r["SK_ID_CURR"], r["TARGET"]) for r in data.select("SK_ID_CURR", "TARGET").collect()}
    assert got == {tuple(r) for r in labels.select("SK_ID_CURR", "TARGET").collect()} and len(got) == data.count() == feats.count()
