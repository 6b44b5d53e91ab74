"""Model training, scoring, routing and explanation on Spark ML.

Training data is the client feature table joined with the labels.  The
input contract is an ordered manifest of feature names (A6/B15); names are
made model-safe (B5); nulls are imputed with exact medians (M3); features
are standardised with the population std (M2); the classifier is a
class-weighted L2 logistic regression (M1, M5) or gradient-boosted trees
(M6).  Scores are ``100 * P(class 1)`` (M10, M17) and clients are routed by
the decision threshold (M18).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskfold.constants import DECISION_THRESHOLD, SEED
from riskfold.functions.names import numeric_columns
from riskfold.operators.logistic import LogisticTask, fit_logistic
from riskfold.operators.model_prep import (Imputer, Standardizer, class_weights, fit_imputer_and_scaler,
                                           fit_imputers_and_scalers, sanitized_manifest, with_weight)
from riskfold.operators.quantiles import PACKED, as_array
from riskfold.operators.sample import hash_uniform
from riskfold.operators.trees import grouped_auc
from riskfold.session import cut_lineage

CLIENT = "SK_ID_CURR"
LABEL = "TARGET"
LIKELY = "likely to repay"
NOT_LIKELY = "not likely to repay"
ROWS_PER_PART = 20_000


def feature_manifest(df: DataFrame, exclude: tuple[str, ...] = (CLIENT, LABEL)) -> list[str]:
    """Ordered numeric feature names of a feature table."""
    return [c for c in numeric_columns(df) if c not in exclude]


@dataclass
class ScoringModel:
    manifest: list[str]
    names: dict[str, str]
    imputer: Imputer
    scaler: Standardizer
    pipeline: PipelineModel
    kind: str = "logistic"
    threshold: float = DECISION_THRESHOLD
    weights: dict[int, float] = field(default_factory=dict)

    @property
    def safe_names(self) -> list[str]:
        return [self.names[c] for c in self.manifest]

    def prepare(self, df: DataFrame, keep: tuple[str, ...] = (CLIENT,)) -> DataFrame:
        """Manifest alignment, safe names, imputation and scaling."""
        present = set(df.columns)
        cols = [F.col(k) for k in keep if k in present]
        cols += [(F.col(c) if c in present else F.lit(None)).cast("double").alias(self.names[c])
                 for c in self.manifest]
        return self.scaler.transform(self.imputer.transform(df.select(*cols)))

    def score(self, df: DataFrame, keep: tuple[str, ...] = (CLIENT,)) -> DataFrame:
        """keep..., probability (class 1), score (0-100), decision."""
        out = self.pipeline.transform(self.prepare(df, keep))
        p = vector_to_array(F.col("probability")).getItem(1)
        return out.select(*[F.col(k) for k in keep if k in df.columns], p.alias("probability"),
                          (p * 100).alias("score")).withColumn("decision", route(F.col("score"), self.threshold))

    def coefficients(self) -> dict[str, float]:
        lr = self.pipeline.stages[-1]
        return dict(zip(self.safe_names, lr.coefficients.toArray().tolist()))


@dataclass
class LinearScorer(ScoringModel):
    """A scoring model whose coefficients are given (say, read from a ledger)
    instead of fitted: the same preparation, score, route and explanations."""
    weight_of: dict[str, float] = field(default_factory=dict)  # by safe name
    intercept: float = 0.0

    @classmethod
    def prepared_on(cls, train: DataFrame, manifest: list[str], coefficients: list[float], intercept: float) -> "LinearScorer":
        """Imputer and scaler fitted on ``train``, coefficients as given, in manifest order."""
        names = sanitized_manifest(manifest)
        base = cut_lineage(train.select(*[F.col(c).cast("double").alias(names[c]) for c in manifest]))
        imputer, scaler = fit_imputer_and_scaler(base, [names[c] for c in manifest])
        return cls(manifest, names, imputer, scaler, None, "linear",
                   weight_of={names[c]: w for c, w in zip(manifest, coefficients)}, intercept=intercept)

    def coefficients(self) -> dict[str, float]:
        return self.weight_of

    def score(self, df: DataFrame, keep: tuple[str, ...] = (CLIENT,)) -> DataFrame:
        parts = F.array(*[F.col(c) * F.lit(w) for c, w in self.weight_of.items()])
        margin = F.aggregate(parts, F.lit(float(self.intercept)), lambda acc, x: acc + x)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
        out = self.prepare(df, keep).select(*[F.col(k) for k in keep if k in df.columns], p.alias("probability"))
        return out.withColumn("score", F.col("probability") * 100).withColumn(
            "decision", route(F.col("score"), self.threshold))


def route(score, threshold: float = DECISION_THRESHOLD):
    """score >= threshold -> not likely to repay; below -> likely; null -> null."""
    return F.when(score >= F.lit(threshold), F.lit(NOT_LIKELY)).when(score < F.lit(threshold), F.lit(LIKELY))


def fit(train: DataFrame, manifest: list[str] | None = None, kind: str = "logistic",
        class_weight="balanced", C: float = 1.0, max_iter: int = 1000, tol: float = 1e-4,
        gbt_params: dict | None = None, impute: str = "median", validation_col: str | None = None,
        learnt: tuple[Imputer, Standardizer] | None = None) -> ScoringModel:
    """Fit imputer, scaler and classifier on ``train`` (features + TARGET); ``learnt``: an
    imputer and scaler, by safe names, that are known already."""
    manifest = manifest or feature_manifest(train)
    names = sanitized_manifest(manifest)
    safe = [names[c] for c in manifest]
    # one reliable lineage cut: the feature plan runs once, and the fitting
    # passes (medians, moments, optimiser iterations) read the checkpoint
    extra = [F.col(validation_col)] if validation_col else []
    if kind == "logistic" and impute == "median":  # all passes want whole rows
        base = cut_lineage(train.select(F.col(LABEL), as_array(manifest, PACKED)), "zstd")
    else:
        base = cut_lineage(train.select(F.col(LABEL), *extra, *[F.expr(f"cast(`{c}` as double) as `{names[c]}`") for c in manifest]))
    if learnt:
        imputer, scaler = learnt
    elif impute == "median":
        imputer, scaler = fit_imputer_and_scaler(base, safe)
    else:
        imputer = Imputer.zeros(safe)
        scaler = Standardizer.fit(imputer.transform(base), safe)
    weights = class_weights(base, LABEL, class_weight)
    if kind == "logistic":
        task = _logistic_task(safe, imputer, scaler, weights, C)
        fit_logistic(base, safe, LABEL, [task], max_iter=max_iter, tol=tol)
        return _linear_model(manifest, names, imputer, scaler, task)
    # one vector a row, made by one expression and stored: an optimiser reads it in every
    # iteration, in parts of a useful size and not those of the plan
    cells = [f"(coalesce(cast(`{c}` as double), {float(imputer.values[c])!r}D) - {float(scaler.means[c] or 0.0)!r}D) / {float(scaler.stds[c])!r}D"
             for c in safe]
    vector = array_to_vector(F.expr(f"array({', '.join(cells)})")).alias("features")
    parts = max(1, -(-base.count() // ROWS_PER_PART))
    weighted = cut_lineage(with_weight(base.select(LABEL, *extra, vector), LABEL, weights).coalesce(parts)
                           .withColumn("label", F.col(LABEL).cast("double")))
    assembler = VectorAssembler(inputCols=safe, outputCol="features", handleInvalid="keep")
    if kind == "gbt":
        params = {"maxIter": 50, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8,
                  "featureSubsetStrategy": "sqrt", "seed": SEED}
        params.update(gbt_params or {})
        if validation_col:   # early stopping on a held-out indicator column (M7)
            params.setdefault("validationIndicatorCol", validation_col)
            params.setdefault("validationTol", 0.01)
        clf = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", **params)
    else:
        raise ValueError(kind)
    pipeline = PipelineModel(stages=[assembler, clf.fit(weighted)])
    return ScoringModel(manifest, names, imputer, scaler, pipeline, kind, weights=weights)


def _logistic_task(safe: list[str], imputer: Imputer, scaler: Standardizer, weights: dict[int, float], C: float,
                   held_out: int | None = None) -> LogisticTask:
    """sklearn's objective ``C * sum(w * loss) + |b|^2 / 2`` on the imputed and standardised columns."""
    fill, mean, std = (np.array([float(known[c] or 0.0) for c in safe]) for known in (imputer.values, scaler.means, scaler.stds))
    return LogisticTask(fill, mean, std, weights, C, held_out)


def _linear_model(manifest: list[str], names: dict[str, str], imputer: Imputer, scaler: Standardizer, task: LogisticTask) -> LinearScorer:
    fitted = [float(x) for x in task.point]
    return LinearScorer(manifest, names, imputer, scaler, None, "logistic", weights=task.weights,
                        weight_of=dict(zip((names[c] for c in manifest), fitted)), intercept=fitted[-1])


def cross_validate(train: DataFrame, manifest: list[str], grid: list[dict], kind: str = "logistic",
                   fold_col: str = "fold") -> list[tuple[dict, float]]:
    """(parameters, mean ROC AUC) of every grid point, best first (M8).

    ``train`` must carry ``fold_col`` (see operators.sample.kfold).  The rows are stored
    once.  Medians and moments are learnt once for every fold, from the other folds alone;
    the logistic models of all points and folds then grow in the same passes, others are fitted
    one by one by :func:`fit`.  The AUCs on the held-out folds are exact and counted in one
    go.  ``grid`` holds keyword arguments of :func:`fit`."""
    names = sanitized_manifest(manifest)
    safe = [names[c] for c in manifest]
    packed = cut_lineage(train.select(CLIENT, LABEL, fold_col, as_array(manifest, PACKED)), "zstd")
    data = packed.select(CLIENT, LABEL, fold_col, *[F.expr(f"{PACKED}[{k}] as `{c}`") for k, c in enumerate(manifest)])
    folds = sorted(r[0] for r in packed.select(fold_col).distinct().collect())
    learnt = fit_imputers_and_scalers(packed, safe, fold_col, folds)
    models: dict[tuple[int, int], ScoringModel] = {}
    if kind == "logistic" and all(set(params) <= {"C"} for params in grid):
        weights = {fold: class_weights(packed.where(F.col(fold_col) != fold), LABEL) for fold in folds}
        tasks = {(point, place): _logistic_task(safe, *learnt[fold], weights[fold], params.get("C", 1.0), fold)
                 for point, params in enumerate(grid) for place, fold in enumerate(folds)}
        fit_logistic(packed, safe, LABEL, list(tasks.values()), fold_col)
        models = {at: _linear_model(manifest, names, *learnt[folds[at[1]]], task) for at, task in tasks.items()}
    held = None
    for point, params in enumerate(grid):
        for place, fold in enumerate(folds):
            model = models.get((point, place)) or fit(data.where(F.col(fold_col) != fold), manifest, kind=kind, learnt=learnt[fold], **params)
            scored = model.score(data.where(F.col(fold_col) == fold), keep=(CLIENT, LABEL)).select(
                LABEL, "probability", F.lit(point * len(folds) + place).alias("run"))
            held = scored if held is None else held.unionByName(scored)
    if held is None:
        return []
    aucs = {r["run"]: r["auc"] for r in grouped_auc(held, "run", LABEL, "probability").collect()}
    out = []
    for point, params in enumerate(grid):
        known = [a for k in range(len(folds)) if (a := aucs.get(point * len(folds) + k)) is not None]
        out.append((params, sum(known) / len(known) if known else float("nan")))
    return sorted(out, key=lambda x: -x[1])


def stratified_baseline(df: DataFrame, prior: float, seed: int = SEED) -> DataFrame:
    """Random classifier that predicts 1 with the class-1 prior (M9)."""
    u = hash_uniform([CLIENT], seed, "baseline")
    return df.withColumn("probability", u).withColumn("prediction", (u < F.lit(prior)).cast("int"))


def contributions(model: ScoringModel, df: DataFrame) -> DataFrame:
    """Long table (SK_ID_CURR, feature, contribution) of a linear model:
    coefficient x standardised value (0 for an imputed-at-mean value)."""
    coef = model.coefficients()
    prepared = model.prepare(df)
    parts = F.explode(F.array(*[F.struct(F.lit(orig).alias("feature"),
                                         (F.col(model.names[orig]) * F.lit(coef[model.names[orig]])).alias("contribution"))
                                for orig in model.manifest]))
    return prepared.select(CLIENT, parts.alias("c")).select(CLIENT, "c.feature", "c.contribution")


def global_explanation(model: ScoringModel, df: DataFrame, top: int = 15) -> DataFrame:
    """Mean absolute contribution per feature, top ``top``."""
    return (contributions(model, df).groupBy("feature")
            .agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
            .orderBy(F.desc("mean_abs_contribution"), F.asc("feature")).limit(top))


def local_explanation(model: ScoringModel, df: DataFrame, n: int = 3, top: int = 15) -> DataFrame:
    """Top ``top`` contributions of the ``n`` highest and ``n`` lowest scored clients."""
    # scored once; both ends are taken from the narrow result
    scored = cut_lineage(model.score(df).select(CLIENT, "score"))
    high = scored.orderBy(F.desc("score"), F.asc(CLIENT)).limit(n).withColumn("group", F.lit("highest"))
    low = scored.orderBy(F.asc("score"), F.asc(CLIENT)).limit(n).withColumn("group", F.lit("lowest"))
    chosen = cut_lineage(high.unionByName(low).select(CLIENT, "score", "group"))
    contrib = contributions(model, df.join(chosen.select(CLIENT), CLIENT, "left_semi"))
    w = Window.partitionBy(CLIENT).orderBy(F.desc(F.abs("contribution")), F.asc("feature"))
    return (contrib.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top)
            .join(chosen, CLIENT))


def feature_importances(model: ScoringModel) -> DataFrame:
    """feature, importance of a tree model, sorted descending (K7)."""
    spark = SparkSession.getActiveSession()
    imp = model.pipeline.stages[-1].featureImportances.toArray().tolist()
    rows = [(orig, float(v)) for orig, v in zip(model.manifest, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
