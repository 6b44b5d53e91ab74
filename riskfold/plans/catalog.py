"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator family, each over the whole bound tables, plus the SQL oracle of
every query that has an SQL formulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window

from riskfold.plans import features as fp
from riskfold.plans import sql_oracle as so
from riskfold.operators.aggregate import agg_numeric, count_categorical
from riskfold.operators.credit import BureauRoles, bureau_manual_columns
from riskfold.session import cut_by_key, cut_lineage
from riskfold.sources.binding import ACTIVE_LOAN_STATUS, binding_vocabulary, credit_tables


def default_plan() -> fp.FeaturePlan:
    return fp.FeaturePlan(vocabulary=binding_vocabulary(), roles=BureauRoles(active_value=ACTIVE_LOAN_STATUS))


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return credit_tables(spark, sf_dir)


def agg_numeric_bureau(spark, sf_dir):
    """D1 over the loans of each client."""
    return agg_numeric(_tables(spark, sf_dir)["bureau"], "SK_ID_CURR", "bureau")


def count_categorical_bureau_balance(spark, sf_dir):
    """D2 over the monthly statuses of each loan."""
    plan = default_plan()
    return count_categorical(_tables(spark, sf_dir)["bureau_balance"], "SK_ID_BUREAU", "bureau_balance",
                             plan.vocab("bureau_balance"))


def loan_features(spark, sf_dir):
    """J1-J8."""
    return fp.loan_features(_tables(spark, sf_dir)["bureau_balance"], default_plan())


def bureau_manual(spark, sf_dir):
    """J9-J17."""
    return fp.bureau_client(_tables(spark, sf_dir)["bureau"], default_plan(), generic=False, manual=True)


def bureau_client(spark, sf_dir):
    """J18 fused with J9-J17."""
    return fp.bureau_client(_tables(spark, sf_dir)["bureau"], default_plan())


def client_bureau_balance_generic(spark, sf_dir):
    """Month -> loan -> client generic roll-up."""
    t, plan = _tables(spark, sf_dir), default_plan()
    loans = fp.loan_level(t["bureau_balance"], plan)
    return fp.client_loan_rollups(loans, t["bureau"], plan, generic=True, manual=False)


def client_bureau_balance_manual(spark, sf_dir):
    """Roll-up of the loan block per client."""
    t, plan = _tables(spark, sf_dir), default_plan()
    loans = fp.loan_level(t["bureau_balance"], plan)
    return fp.client_loan_rollups(loans, t["bureau"], plan, generic=False, manual=True)


def bureau_block(spark, sf_dir):
    """J21."""
    return fp.bureau_block(_tables(spark, sf_dir), default_plan())


def history_block(spark, sf_dir):
    """C2 + J22-J25."""
    return fp.history_block(_tables(spark, sf_dir), default_plan())


def encoded_application(spark, sf_dir):
    """I1 + I2."""
    return fp.encode_application(_tables(spark, sf_dir)["current_app"], default_plan())


def client_features(spark, sf_dir):
    """J26 (flagship)."""
    return fp.client_features(_tables(spark, sf_dir), default_plan())


QUERIES = {
    "agg_numeric_bureau": agg_numeric_bureau,
    "count_categorical_bureau_balance": count_categorical_bureau_balance,
    "loan_features": loan_features,
    "bureau_manual": bureau_manual,
    "bureau_client": bureau_client,
    "client_bureau_balance_generic": client_bureau_balance_generic,
    "client_bureau_balance_manual": client_bureau_balance_manual,
    "bureau_block": bureau_block,
    "history_block": history_block,
    "encoded_application": encoded_application,
    "client_features": client_features,
}

ORACLE_SQL = {
    "agg_numeric_bureau": so.agg_numeric_sql("bureau", "SK_ID_CURR", "bureau"),
    "count_categorical_bureau_balance": so.count_categorical_sql("bureau_balance", "SK_ID_BUREAU", "bureau_balance"),
    "loan_features": so.loan_features_sql(),
    "bureau_manual": so.bureau_client_sql(generic=False, manual=True),
    "bureau_client": so.bureau_client_sql(),
    "client_bureau_balance_generic": so.client_loan_rollups_sql(generic=True, manual=False),
    "client_bureau_balance_manual": so.client_loan_rollups_sql(generic=False, manual=True),
    "bureau_block": so.bureau_block_sql(),
    "history_block": so.history_block_sql(),
    "encoded_application": so.encoded_app_sql(),
    "client_features": so.client_features_sql(),
}


# --- profiles, sampling, evaluation, selection ------------------------------------

from pyspark.sql import functions as F  # noqa: E402

from riskfold.functions.names import numeric_columns  # noqa: E402
from riskfold.operators import evaluate as ev  # noqa: E402
from riskfold.operators import profile as pr  # noqa: E402
from riskfold.operators import sample as sa  # noqa: E402
from riskfold.operators.select import spearman_with_target  # noqa: E402

RELATION_SAMPLE_FRACTION = 0.05


def client_scores(t: dict[str, DataFrame]) -> DataFrame:
    """A transparent score in [0, 1] for evaluation queries: the share of a
    client's loans in the delinquent status (0 for clients without loans)."""
    share = (t["bureau"].groupBy("SK_ID_CURR")
             .agg(F.avg(F.when(F.col("CREDIT_ACTIVE") == "P", F.lit(1.0)).otherwise(F.lit(0.0))).alias("bad_share")))
    return (t["client_labels"].join(share, "SK_ID_CURR", "left")
            .select("SK_ID_CURR", "TARGET", F.coalesce(F.col("bad_share"), F.lit(0.0)).alias("score")))


def missing_values_client_features(spark, sf_dir):
    """D16 over the client feature table."""
    return pr.missing_values(client_features(spark, sf_dir))


def numeric_profile_bureau(spark, sf_dir):
    """D17 (exact median) over the loans table."""
    b = _tables(spark, sf_dir)["bureau"]
    return pr.numeric_profile(b, [c for c in numeric_columns(b) if not c.startswith("SK_ID")])


def distinct_counts_application(spark, sf_dir):
    """D14."""
    return pr.distinct_counts(_tables(spark, sf_dir)["current_app"])


def top_values_credit_type(spark, sf_dir):
    """Top five loan types."""
    return pr.top_values(_tables(spark, sf_dir)["bureau"], "CREDIT_TYPE", 5)


def application_overview(spark, sf_dir):
    """D18 with D14 and D15: type, missing, distinct and most frequent values of every application column."""
    return pr.column_overview(_tables(spark, sf_dir)["current_app"])


def label_balance(spark, sf_dir):
    """Label balance."""
    return _tables(spark, sf_dir)["client_labels"].groupBy("TARGET").agg(F.count(F.lit(1)).alias("count"))


def _relation_sample(spark, sf_dir):
    return sa.relation_sample(_tables(spark, sf_dir), RELATION_SAMPLE_FRACTION)


def sample_clients(spark, sf_dir):
    """L1."""
    return _relation_sample(spark, sf_dir)["current_app"]


def sample_bureau_balance(spark, sf_dir):
    """C8 cascade: clients -> loans -> monthly history."""
    return _relation_sample(spark, sf_dir)["bureau_balance"]


def sample_installments(spark, sf_dir):
    """Client in sample OR previous application in sample."""
    return _relation_sample(spark, sf_dir)["installments_payments"]


def stratified_split(spark, sf_dir):
    """L2."""
    return sa.stratified_split(_tables(spark, sf_dir)["client_labels"], "SK_ID_CURR", "TARGET")


def kfold_assignment(spark, sf_dir):
    """L3."""
    return sa.kfold(_tables(spark, sf_dir)["client_labels"], "SK_ID_CURR", "TARGET")


def train_fold_sizes(spark, sf_dir):
    """L2 then L3: clients per class and fold of the training split."""
    train = stratified_split(spark, sf_dir).where(F.col("split") == "train")
    return sa.kfold(train, "SK_ID_CURR", "TARGET").groupBy("TARGET", "fold").agg(F.count(F.lit(1)).alias("clients"))


def _bureau_features(spark, sf_dir):
    """Bureau features of labelled clients with label and split, and the feature
    names in table order: generic blocks, then the hand-made ones as J9-J16 list them."""
    t = _tables(spark, sf_dir)
    feats = fp.bureau_client(t["bureau"], default_plan())
    split = sa.stratified_split(t["client_labels"], "SK_ID_CURR", "TARGET").select("SK_ID_CURR", "TARGET", "split")
    vocab = default_plan().vocab("bureau")
    manual = bureau_manual_columns(vocab["CREDIT_ACTIVE"], vocab["CREDIT_TYPE"])
    generic = [c for c in numeric_columns(feats) if c != "SK_ID_CURR" and c not in manual]
    return feats.join(split, "SK_ID_CURR"), generic + manual


def _table_features(spark, sf_dir):
    """The feature table of labelled clients with label and split, and its feature names in
    order.  Values are rounded to ``COMPARED_DIGITS`` decimals: sums of doubles differ in
    their last bits with the order of rows, and equal values must tie."""
    data = _labelled(spark, sf_dir)
    cols = sorted(md.feature_manifest(data.drop("split")))
    return data.select("SK_ID_CURR", "TARGET", "split", *[F.round(F.col(c).cast("double"), so.COMPARED_DIGITS).alias(c) for c in cols]), cols


def spearman_target(spark, sf_dir):
    """K1: Spearman correlation of every feature of the table with the label, on the training split."""
    feats, cols = _table_features(spark, sf_dir)
    return spearman_with_target(feats.where(F.col("split") == "train"), cols, "TARGET")


def threshold_sweep(spark, sf_dir):
    """M12 sweep table."""
    return ev.threshold_sweep(client_scores(_tables(spark, sf_dir)), "TARGET", "score")


def best_threshold(spark, sf_dir):
    """M12 decision."""
    return ev.best_threshold(threshold_sweep(spark, sf_dir))


def classification_report(spark, sf_dir):
    """M13 at the cost-optimal threshold."""
    return ev.classification_metrics(best_threshold(spark, sf_dir))


def roc_auc(spark, sf_dir):
    """M14."""
    return ev.roc_auc(client_scores(_tables(spark, sf_dir)), "TARGET", "score")


def business_cost_default(spark, sf_dir):
    """M11 + D19 at the default 0.5 threshold."""
    scored = ev.predict_at(client_scores(_tables(spark, sf_dir)), "score", 0.5)
    return ev.business_cost(scored, "TARGET", "prediction")


QUERIES.update({
    "missing_values_client_features": missing_values_client_features,
    "numeric_profile_bureau": numeric_profile_bureau,
    "distinct_counts_application": distinct_counts_application,
    "top_values_credit_type": top_values_credit_type,
    "application_overview": application_overview,
    "label_balance": label_balance,
    "sample_clients": sample_clients,
    "sample_bureau_balance": sample_bureau_balance,
    "sample_installments": sample_installments,
    "stratified_split": stratified_split,
    "kfold_assignment": kfold_assignment,
    "train_fold_sizes": train_fold_sizes,
    "spearman_target": spearman_target,
    "threshold_sweep": threshold_sweep,
    "best_threshold": best_threshold,
    "classification_report": classification_report,
    "roc_auc": roc_auc,
    "business_cost_default": business_cost_default,
})

ORACLE_SQL.update({
    "missing_values_client_features": so.missing_values_sql(),
    "numeric_profile_bureau": so.numeric_profile_sql("bureau"),
    "distinct_counts_application": so.distinct_counts_sql("current_app", ["NAME_SEGMENT", "NAME_NATION",
                                                                          "FLAG_HOUSEHOLD"]),
    "top_values_credit_type": so.top_values_sql("bureau", "CREDIT_TYPE", 5),
    "application_overview": so.application_overview_sql(),
    "label_balance": so.label_balance_sql(),
    "sample_clients": so.sample_sql("current_app", RELATION_SAMPLE_FRACTION),
    "sample_bureau_balance": so.sample_sql("bureau_balance", RELATION_SAMPLE_FRACTION),
    "sample_installments": so.sample_sql("installments_payments", RELATION_SAMPLE_FRACTION),
    "stratified_split": so.split_sql("split"),
    "kfold_assignment": so.split_sql("fold"),
    "train_fold_sizes": so.train_fold_sizes_sql(),
    "spearman_target": so.spearman_target_sql(),
    "threshold_sweep": so.threshold_sweep_sql(),
    "best_threshold": so.best_threshold_sql(),
    "classification_report": so.classification_report_sql(),
    "roc_auc": so.roc_auc_sql(),
    "business_cost_default": so.business_cost_sql(0.5),
})


# --- model training, scoring and explanation (no SQL oracle) ---------------------

from riskfold.plans import model as md  # noqa: E402

_MODELS: dict[tuple, md.ScoringModel] = {}


_FEATURE_TABLES: dict[tuple, DataFrame] = {}


def _stored_features(spark, sf_dir) -> DataFrame:
    """The client feature table materialised once per session and input
    folder (in the shared folder), as a production pipeline writes it once and
    lets every model job read it.  Each row carries its ``_labels``, a list of
    (TARGET, split): they meet while the rows lie by client anyway, so that no
    job moves the wide rows again."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FEATURE_TABLES:
        t = _tables(spark, sf_dir)
        split = sa.stratified_split(t["client_labels"], "SK_ID_CURR", "TARGET")
        labels = split.groupBy("SK_ID_CURR").agg(F.collect_list(F.struct("TARGET", "split")).alias("_labels"))
        _FEATURE_TABLES[key] = cut_lineage(fp.client_features(t, default_plan()).join(labels, "SK_ID_CURR", "left"), "zstd")
    return _FEATURE_TABLES[key]


def feature_table(spark, sf_dir) -> DataFrame:
    """The client feature table, one row per client."""
    return _stored_features(spark, sf_dir).drop("_labels")


def _labelled(spark, sf_dir) -> DataFrame:
    """The feature table of the labelled clients with label and split."""
    stored = _stored_features(spark, sf_dir)
    feats = [c for c in stored.columns if c != "_labels"]
    return stored.select(*[F.col(f"`{c}`") for c in feats], F.inline("_labels"))


def trained_model(spark, sf_dir, kind: str = "logistic") -> md.ScoringModel:
    """The model of ``kind``, fitted on the training split by whichever query
    asks for it first and kept for the session and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _MODELS:
        data = _labelled(spark, sf_dir)
        manifest = md.feature_manifest(data.drop("split"))
        _MODELS[key] = md.fit(data.where(F.col("split") == "train"), manifest, kind=kind)
    return _MODELS[key]


def model_scores(spark, sf_dir):
    """M10 + M17 + M18: score and route every client."""
    return trained_model(spark, sf_dir).score(feature_table(spark, sf_dir))


def model_validation_sweep(spark, sf_dir):
    """M12 on the validation split with model probabilities."""
    data = _labelled(spark, sf_dir).where(F.col("split") == "test")
    scored = trained_model(spark, sf_dir).score(data, keep=("SK_ID_CURR", "TARGET"))
    return ev.threshold_sweep(scored, "TARGET", "probability")


def model_validation_auc(spark, sf_dir):
    """M14 on the validation split."""
    data = _labelled(spark, sf_dir).where(F.col("split") == "test")
    scored = trained_model(spark, sf_dir).score(data, keep=("SK_ID_CURR", "TARGET"))
    return ev.roc_auc(scored, "TARGET", "probability")


def model_global_explanation(spark, sf_dir):
    """M15."""
    return md.global_explanation(trained_model(spark, sf_dir), feature_table(spark, sf_dir))


def model_local_explanation(spark, sf_dir):
    """M16."""
    return md.local_explanation(trained_model(spark, sf_dir), feature_table(spark, sf_dir))


QUERIES.update({
    "model_scores": model_scores,
    "model_validation_sweep": model_validation_sweep,
    "model_validation_auc": model_validation_auc,
    "model_global_explanation": model_global_explanation,
    "model_local_explanation": model_local_explanation,
})


# --- more selection / drift operators ---------------------------------------------

from riskfold.constants import CORRELATION_THRESHOLD  # noqa: E402
from riskfold.operators.drift import psi_drift  # noqa: E402
from riskfold.operators.correlate import strong_pairs  # noqa: E402
from riskfold.operators.select import prune_greedy  # noqa: E402


def loan_prefixed_rollup(spark, sf_dir):
    """D13."""
    t = _tables(spark, sf_dir)
    return fp.prefixed_loan_rollup(t["bureau_balance"], t["bureau"], default_plan())


def top_bottom_correlated(spark, sf_dir, n: int = 10):
    """K6: the n most positively and n most negatively target-correlated features."""
    # one correlation per feature: materialise the small table once and
    # rank it twice, instead of running the correlation plan twice
    sp = cut_lineage(spearman_target(spark, sf_dir).where(F.col("rho").isNotNull()))
    top = sp.orderBy(F.desc("rho"), "feature").limit(n).withColumn("side", F.lit("top"))
    bottom = sp.orderBy(F.asc("rho"), "feature").limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def correlated_feature_pairs(spark, sf_dir):
    """K2 + K3: pairs of features of the table with |Spearman| above the threshold, on the training split."""
    feats, cols = _table_features(spark, sf_dir)
    return strong_pairs(feats.where(F.col("split") == "train"), cols, "SK_ID_CURR", CORRELATION_THRESHOLD)


_EDGES: dict[tuple, tuple] = {}


def _correlation_edges(spark, sf_dir):
    """Correlated pairs and target correlations of the feature table:
    small driver-side metadata (bounded by the feature count squared),
    computed once per session and input folder for the pruning passes."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _EDGES:
        _, cols = _table_features(spark, sf_dir)
        pairs = [(r["feature_i"], r["feature_j"]) for r in correlated_feature_pairs(spark, sf_dir).collect()]
        target = {r["feature"]: r["abs_rho"] for r in spearman_target(spark, sf_dir).collect()}
        _EDGES[key] = (cols, pairs, target)
    return _EDGES[key]


def selected_features(spark, sf_dir):
    """K5: the greedy pruning decision for every feature of the table."""
    cols, pairs, target = _correlation_edges(spark, sf_dir)
    dropped = prune_greedy(pairs, cols, target)
    return spark.createDataFrame([(c, c not in dropped) for c in cols], "feature string, kept boolean")


def drift_train_vs_test(spark, sf_dir):
    """K9: PSI and null-rate change of every feature of the table, train vs test split."""
    d, cols = _table_features(spark, sf_dir)
    return psi_drift(d.where(F.col("split") == "train"), d.where(F.col("split") == "test"), cols)


# --- leaf-wise boosted trees ----------------------------------------------------------

from dataclasses import replace  # noqa: E402

from riskfold.operators import trees as tr  # noqa: E402

#: Parameters of the tree model as the original sets them: up to 2000 rounds, ended once 200
#: have brought no larger AUC on the validation split.
TREE_PARAMS = tr.TreeParams(learning_rate=0.1, num_leaves=31, l1=0.1, l2=0.1, feature_share=0.9)
TREE_ROUNDS, TREE_PATIENCE = 2000, 200
GRID_ROUNDS, GRID_RATES, GRID_LEAVES = [1, 2, 3], [0.05, 0.1], [21, 31, 41, 51]

_TREES: dict[tuple, tr.TreeModel] = {}


def tree_model(spark, sf_dir) -> tr.TreeModel:
    """The leaf-wise model fitted on the training split up to its best round on the validation
    split, kept for the application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TREES:
        data = _labelled(spark, sf_dir)
        _TREES[key], _ = tr.early_stopping(data.where(F.col("split") == "train"), data.where(F.col("split") == "test"),
                                           md.feature_manifest(data.drop("split")), "TARGET", TREE_PARAMS, TREE_ROUNDS, TREE_PATIENCE,
                                           63, check_every=25)
    return _TREES[key]


def tree_scores(spark, sf_dir):
    """M6 + M10 + M18: score and route every client with the tree model."""
    scored = tree_model(spark, sf_dir).score(feature_table(spark, sf_dir), ("SK_ID_CURR",))
    return scored.withColumn("decision", md.route(F.col("score")))


def tree_early_stopping(spark, sf_dir, max_rounds: int = 8, patience: int = 3):
    """M7: exact validation AUC after each round, and whether the model keeps the round."""
    data = _labelled(spark, sf_dir)
    model, curve = tr.early_stopping(data.where(F.col("split") == "train"), data.where(F.col("split") == "test"),
                                     md.feature_manifest(data.drop("split")), "TARGET",
                                     replace(TREE_PARAMS, learning_rate=0.3, num_leaves=8), max_rounds, patience, 31, check_every=4)
    rows = [(n, auc, n <= len(model.booster.trees)) for n, auc in curve]
    return spark.createDataFrame(rows, "round int, validation_auc double, kept boolean")


def tree_grid_search(spark, sf_dir):
    """M8: every point of the tree grid with its exact AUC per fold, best mean first."""
    data = _labelled(spark, sf_dir).where(F.col("split") == "train")
    folds = sa.kfold(data.select("SK_ID_CURR", "TARGET"), "SK_ID_CURR", "TARGET").distinct()
    found = tr.grid_search(data, md.feature_manifest(data.drop("split")), "TARGET", "fold", GRID_ROUNDS, GRID_RATES, GRID_LEAVES,
                           TREE_PARAMS, folds=folds)
    points: dict[tuple, list] = {}
    for n, rate, leaves, _, auc in found:
        points.setdefault((n, rate, leaves), []).append(auc)
    rows = [(*p, sum(a) / len(a) if None not in a else None, a) for p, a in points.items()]
    rows.sort(key=lambda r: (-(r[3] or 0.0), r[0], r[2], r[1]))
    return spark.createDataFrame([(k + 1, *r) for k, r in enumerate(rows)], "place int, n_estimators int, learning_rate double, "
                                 "num_leaves int, mean_roc_auc double, fold_roc_auc array<double>")


def tree_global_explanation(spark, sf_dir, top: int = 15):
    """Mean absolute Shapley value per feature, the largest ``top``."""
    found = tree_model(spark, sf_dir).mean_abs_contributions(feature_table(spark, sf_dir))
    return found.orderBy(F.desc("mean_abs_contribution"), "feature").limit(top)


def tree_local_explanation(spark, sf_dir, n: int = 3, top: int = 15):
    """The largest ``top`` Shapley values of the ``n`` highest and ``n`` lowest scored clients."""
    model, feats = tree_model(spark, sf_dir), feature_table(spark, sf_dir)
    scored = cut_lineage(model.margins(feats, ("SK_ID_CURR",)))
    high = scored.orderBy(F.desc("margin"), "SK_ID_CURR").limit(n).withColumn("group", F.lit("highest"))
    low = scored.orderBy("margin", "SK_ID_CURR").limit(n).withColumn("group", F.lit("lowest"))
    chosen = cut_lineage(high.unionByName(low))
    found = model.contributions(feats.join(F.broadcast(chosen.select("SK_ID_CURR")), "SK_ID_CURR", "left_semi"), "SK_ID_CURR")
    order = Window.partitionBy("SK_ID_CURR").orderBy(F.desc(F.abs("contribution")), "feature")
    return (found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)
            .join(F.broadcast(chosen), "SK_ID_CURR").withColumn("expected", F.lit(model.expected)))


def model_feature_importance(spark, sf_dir):
    """K7: share of the gain and number of splits of every feature in the tree model."""
    rows = tree_model(spark, sf_dir).importances()
    return spark.createDataFrame(rows, "feature string, importance double, splits long").orderBy(F.desc("importance"), "feature")


QUERIES.update({
    "loan_prefixed_rollup": loan_prefixed_rollup,
    "top_bottom_correlated": top_bottom_correlated,
    "correlated_feature_pairs": correlated_feature_pairs,
    "selected_features": selected_features,
    "drift_train_vs_test": drift_train_vs_test,
    "model_feature_importance": model_feature_importance,
    "tree_scores": tree_scores,
    "tree_early_stopping": tree_early_stopping,
    "tree_grid_search": tree_grid_search,
    "tree_global_explanation": tree_global_explanation,
    "tree_local_explanation": tree_local_explanation,
})

ORACLE_SQL.update({
    "loan_prefixed_rollup": so.prefixed_loan_rollup_sql(),
    "top_bottom_correlated": so.top_bottom_correlated_sql(10),
    "correlated_feature_pairs": so.correlated_pairs_sql(CORRELATION_THRESHOLD),
    "drift_train_vs_test": so.drift_sql(),
})


# --- remaining selection and baseline operators ------------------------------------

from riskfold.operators.select import prune_by_group  # noqa: E402


def selected_features_by_group(spark, sf_dir):
    """K4: keep the best target-correlated feature of each correlated group."""
    cols, pairs, target = _correlation_edges(spark, sf_dir)
    dropped = prune_by_group(pairs, cols, target)
    return spark.createDataFrame([(c, c not in dropped) for c in cols], "feature string, kept boolean")


def zero_importance_features(spark, sf_dir):
    """K8: features the tree model never used."""
    return model_feature_importance(spark, sf_dir).where(F.col("importance") == 0).select("feature")


def baseline_cost(spark, sf_dir):
    """M9 + M11: stratified random baseline (predicts 1 with the class prior)."""
    labels = _tables(spark, sf_dir)["client_labels"]
    prior = labels.agg(F.avg("TARGET")).first()[0] or 0.0
    return ev.business_cost(md.stratified_baseline(labels, prior), "TARGET", "prediction")


QUERIES.update({
    "selected_features_by_group": selected_features_by_group,
    "zero_importance_features": zero_importance_features,
    "baseline_cost": baseline_cost,
})
ORACLE_SQL["baseline_cost"] = so.baseline_cost_sql()


# --- sources / sinks / streaming round trips ----------------------------------------

import os  # noqa: E402
import uuid  # noqa: E402

from riskfold.operators.model_prep import align_to_manifest  # noqa: E402
from riskfold.sources import io as sio  # noqa: E402
from riskfold.session import checkpoint_dir  # noqa: E402


def _shared_folder(spark, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location."""
    base = spark.sparkContext.getCheckpointDir() or checkpoint_dir(spark)
    return f"{base.rstrip('/')}/riskfold-{name}-{uuid.uuid4().hex[:12]}"


def manifest_alignment(spark, sf_dir):
    """A6 + A7 + B5 + B15: write the model-input manifest, read it back and
    align the client feature table to it (safe names, manifest order)."""
    model = trained_model(spark, sf_dir)
    path = _shared_folder(spark, "manifest")
    sio.write_manifest(spark, model.safe_names, path)
    manifest = sio.read_manifest(spark, path)
    feats = feature_table(spark, sf_dir)
    renamed = feats.select("SK_ID_CURR", *[F.col(c).alias(model.names[c]) for c in model.manifest])
    return align_to_manifest(renamed, manifest, keep=["SK_ID_CURR"])


def decision_exports(spark, sf_dir):
    """Scored clients written as CSV partitioned by decision, read back."""
    path = _shared_folder(spark, "decisions")
    sio.write_decisions(model_scores(spark, sf_dir), path)
    back = spark.read.option("header", True).schema(
        "SK_ID_CURR long, probability double, score double, decision string").csv(path)
    return back.groupBy("decision").agg(F.count(F.lit(1)).alias("clients"))


def run_leaderboard(spark, sf_dir):
    """Validation metrics of the logistic and tree models logged to a
    run ledger and read back as a leaderboard."""
    path = _shared_folder(spark, "ledger")
    data = _labelled(spark, sf_dir).where(F.col("split") == "test")
    for kind in ("logistic", "trees"):
        model = trained_model(spark, sf_dir) if kind == "logistic" else tree_model(spark, sf_dir)
        # scored once; every metric reads the narrow result
        scored = cut_lineage(model.score(data, keep=("SK_ID_CURR", "TARGET")).select("TARGET", "probability"))
        auc = ev.roc_auc(scored, "TARGET", "probability").first()["roc_auc"]
        best = ev.best_threshold(ev.threshold_sweep(scored, "TARGET", "probability")).first()
        sio.log_run(spark, path, kind, params={"best_gs_kind": kind},
                    metrics={"val_roc_auc": auc, "best_business_cost_obtained": best["business_cost"],
                             "best_threshold_to_minimize_business_cost": best["threshold"]})
    return sio.leaderboard(spark, path, ["val_roc_auc", "best_business_cost_obtained",
                                         "best_threshold_to_minimize_business_cost"], order_by="val_roc_auc")


def model_cv_auc(spark, sf_dir):
    """M8: 3-fold stratified grid search of the logistic model (exact ROC AUC per grid point)."""
    data = _labelled(spark, sf_dir).where(F.col("split") == "train")
    manifest = md.feature_manifest(data.drop("split"))
    grid = [{"C": 1.0}, {"C": 0.01}]
    found = md.cross_validate(sa.kfold(data, "SK_ID_CURR", "TARGET"), manifest, grid)
    return spark.createDataFrame([(p["C"], m) for p, m in found], "c double, mean_roc_auc double")


def request_verdicts(spark, sf_dir):
    """A3 + A4: every client sends a JSON request with its application and loans.  Of each
    fifty requests one lacks the loans, one has no application and one breaks off; they are
    refused with a reason, the others accepted with the rows that their tables hold."""
    requests, schemas = _requests(spark, sf_dir)
    return sio.request_verdicts(requests, "request_id", "payload", schemas)


def request_loans(spark, sf_dir):
    """A3: loans of the accepted requests, counted and summed per request."""
    requests, schemas = _requests(spark, sf_dir)
    loans = sio.accepted_tables(requests, "request_id", "payload", schemas)["bureau"]
    return loans.groupBy("request_id").agg(F.count(F.lit(1)).alias("loans"), F.round(F.sum("AMT_CREDIT_SUM"), 2).alias("credit"))


def _requests(spark, sf_dir):
    t = _tables(spark, sf_dir)
    app, bureau = t["current_app"], t["bureau"].select("SK_ID_CURR", "SK_ID_BUREAU", "CREDIT_TYPE", "AMT_CREDIT_SUM")
    loans = bureau.groupBy("SK_ID_CURR").agg(F.collect_list(F.struct(*bureau.columns)).alias("bureau"))
    kind = F.col("SK_ID_CURR") % 50
    both = app.select("SK_ID_CURR", F.array(F.struct(*app.columns)).alias("current_app")).join(loans, "SK_ID_CURR", "left")
    none = F.array().cast(both.schema["bureau"].dataType)
    payload = F.to_json(F.struct(F.when(kind == 1, F.slice("current_app", 1, 0)).otherwise(F.col("current_app")).alias("current_app"),
                                 F.when(kind != 0, F.coalesce("bureau", none)).alias("bureau")))
    text = both.select(F.col("SK_ID_CURR").alias("request_id"), payload.alias("p"), (kind == 2).alias("breaks"))
    requests = text.select("request_id", F.when(F.col("breaks"), F.expr("left(p, length(p) - 2)")).otherwise(F.col("p")).alias("payload"))
    return requests, {"current_app": app.schema, "bureau": bureau.schema}


def ledger_board(spark, sf_dir):
    """One run per market segment, logged, logged again by a retry, and corrected;
    the board has the latest metrics, the tag and the description of every run."""
    path = _shared_folder(spark, "segment-ledger")
    _log_segments(spark, sf_dir, path)
    return sio.leaderboard(spark, path, ["clients", "default_rate"], tags=["segment"], description=True)


def ledger_best_params(spark, sf_dir):
    """The tuned parameters of every run read back without their prefixes."""
    path = _shared_folder(spark, "segment-ledger")
    _log_segments(spark, sf_dir, path)
    return sio.best_params(spark, path)


def _log_segments(spark, sf_dir, path) -> None:
    t = _tables(spark, sf_dir)
    rates = (t["current_app"].join(t["client_labels"], "SK_ID_CURR").groupBy("NAME_SEGMENT")
             .agg(F.count(F.lit(1)).alias("n"), F.avg("TARGET").alias("rate"), F.max("SK_ID_CURR").alias("top")))
    run = F.concat(F.lit("run-"), F.lower("NAME_SEGMENT"))

    def cell(kind: str, key: str, value):
        return F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"), value.cast("string").alias("value"))

    def cells(clients, rate):
        return (cell("metric", "clients", clients), cell("metric", "default_rate", rate), cell("tag", "segment", F.col("NAME_SEGMENT")),
                cell("note", "description", F.concat(F.lit("clients up to "), F.col("top").cast("string"))),
                cell("param", "best_gs_classifier__C", F.col("n") % 7), cell("param", "kind", F.lit("x")))

    def rows(*some):
        return rates.select(run.alias("run_id"), F.explode(F.array(*some)).alias("c")).select("run_id", "c.*")

    for attempt, clients in (("a", F.lit(0)), ("a", F.lit(0)), ("b", F.col("n"))):
        sio.log_runs(rows(*cells(clients, F.col("rate"))), path, attempt)


def encoded_nulls(spark, sf_dir):
    """I1 + I2 on columns with nulls: null is a value, so that {Y, null} gets
    codes and {high, low, null} becomes dummies."""
    from riskfold.operators.encode import CategoryEncoding
    from riskfold.sources.tables import read_table
    account = F.col("c_acctbal")
    df = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"]).select(
        "c_custkey", F.when(account >= 0, "Y").alias("in_credit"),
        F.when(account > 5000, "high").when(account > 0, "low").alias("level"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
        F.when(account > 0, "N").otherwise("M").alias("sign"))
    return CategoryEncoding.fit(df).transform(df)


def _given_model(spark, sf_dir):
    """Bureau features and a linear model with literal coefficients, prepared on the training split."""
    feats, cols = _bureau_features(spark, sf_dir)
    return feats, md.LinearScorer.prepared_on(feats.where(F.col("split") == "train"), cols, so.given_coefficients(), so.GIVEN_INTERCEPT)


def given_model_scores(spark, sf_dir):
    """M2 + M3 + M10 + M17 + M18 with given coefficients."""
    feats, model = _given_model(spark, sf_dir)
    return model.score(feats)


def given_model_global(spark, sf_dir):
    """M15 with given coefficients."""
    feats, model = _given_model(spark, sf_dir)
    return md.global_explanation(model, feats)


def given_model_local(spark, sf_dir):
    """E3 + M16 with given coefficients."""
    feats, model = _given_model(spark, sf_dir)
    return md.local_explanation(model, feats)


def history_direct(spark, sf_dir):
    """J24 + J25 + C2: histories that carry the client key themselves, driven by
    the instalments."""
    from dataclasses import replace
    t = _tables(spark, sf_dir)
    bridge = t["prev_to_client"]
    direct = {n: t[n].join(bridge, "SK_ID_PREV", "left") for n in ("installments_payments", "credit_card_balance")}
    return fp.history_block({**t, **direct}, replace(default_plan(), driver_block="installments_payments"))


def empty_bureau_features(spark, sf_dir):
    """A5 + C6 + C7: the client table when no loan and no monthly history is known."""
    t = _tables(spark, sf_dir)
    none = {n: sio.empty_table(spark, t[n].schema) for n in ("bureau", "bureau_balance")}
    return fp.client_features({**t, **none}, default_plan())


def sample_pos(spark, sf_dir):
    """Monthly rows of a sampled client or of a sampled previous loan."""
    return sa.relation_sample(_tables(spark, sf_dir), RELATION_SAMPLE_FRACTION)["POS_CASH_balance"]


def stream_scores(spark, sf_dir):
    """Application rows arrive as JSON files; a Structured Streaming job
    joins them with the clients' history features, scores and appends them
    to a Parquet sink (run to completion with an available-now trigger)."""
    from riskfold.streaming.scoring import application_stream, scored_stream, start_scoring
    t, plan = _tables(spark, sf_dir), default_plan()
    model = trained_model(spark, sf_dir)
    root = _shared_folder(spark, "stream")
    t["current_app"].write.json(f"{root}/in")
    # the static side of the stream-static join is materialised once, by client, not
    # recomputed or shuffled by every micro-batch
    history = cut_by_key(fp.bureau_block(t, plan).join(fp.history_block(t, plan), "SK_ID_CURR", "left"), "SK_ID_CURR")
    stream = application_stream(spark, f"{root}/in", t["current_app"].schema, max_files_per_trigger=4)
    query = start_scoring(scored_stream(stream, history, plan, model), f"{root}/out", f"{root}/checkpoint",
                          once=True)
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out")


QUERIES.update({
    "manifest_alignment": manifest_alignment,
    "decision_exports": decision_exports,
    "run_leaderboard": run_leaderboard,
    "model_cv_auc": model_cv_auc,
    "encoded_nulls": encoded_nulls,
    "request_verdicts": request_verdicts,
    "request_loans": request_loans,
    "ledger_board": ledger_board,
    "ledger_best_params": ledger_best_params,
    "given_model_scores": given_model_scores,
    "given_model_global": given_model_global,
    "given_model_local": given_model_local,
    "history_direct": history_direct,
    "empty_bureau_features": empty_bureau_features,
    "sample_pos": sample_pos,
    "stream_scores": stream_scores,
})

ORACLE_SQL["given_model_scores"] = so.given_model_sql("scores")
ORACLE_SQL["given_model_global"] = so.given_model_sql("global")
ORACLE_SQL["given_model_local"] = so.given_model_sql("local")
ORACLE_SQL["history_direct"] = so.history_direct_sql()
ORACLE_SQL["empty_bureau_features"] = so.empty_bureau_features_sql()
ORACLE_SQL["sample_pos"] = so.sample_sql("POS_CASH_balance", RELATION_SAMPLE_FRACTION)
ORACLE_SQL["encoded_nulls"] = so.encoded_nulls_sql()
ORACLE_SQL["selected_features"] = so.selected_features_sql(CORRELATION_THRESHOLD)
ORACLE_SQL["selected_features_by_group"] = so.selected_features_by_group_sql(CORRELATION_THRESHOLD)
ORACLE_SQL["request_verdicts"] = so.request_verdicts_sql()
ORACLE_SQL["request_loans"] = so.request_loans_sql()
ORACLE_SQL["ledger_board"] = so.ledger_board_sql()
ORACLE_SQL["ledger_best_params"] = so.ledger_best_params_sql()
