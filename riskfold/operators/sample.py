"""Seeded sampling and splitting and relation-preserving
sampling with semi-join cascades (2.C C8/C9).

Randomness is a hash of (seed, key): the same row is picked whatever the
partitioning, the executor count or a task retry -- a lost executor cannot
change a sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.constants import CV_FOLDS, SEED, TEST_FRACTION
from riskfold.operators.rank import prefix_counts

_SCALE = float(16 ** 15)


def _salted(keys: list[str], purpose: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[F.col(k).cast("string") for k in keys]))


def hash_uniform(keys: list[str], seed: int = SEED, purpose: str = "sample") -> Column:
    """Deterministic pseudo-uniform value in [0, 1) from md5(seed|purpose|keys).

    Each purpose draws from its own stream, so that a sample, a split, folds and
    a random baseline over the same keys are independent of each other."""
    return F.conv(F.substring(_salted(keys, purpose, seed), 1, 15), 16, 10).cast("bigint").cast("double") / F.lit(_SCALE)


def salted_sql(keys: list[str], purpose: str, seed: int = SEED) -> str:
    return "md5(" + " || '|' || ".join([f"'{seed}'", f"'{purpose}'"] + [f"CAST({k} AS VARCHAR)" for k in keys]) + ")"


def hash_uniform_sql(keys: list[str], seed: int = SEED, purpose: str = "sample") -> str:
    return f"(CAST(('0x' || substr({salted_sql(keys, purpose, seed)}, 1, 15)) AS BIGINT)::DOUBLE / {_SCALE!r})"


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int = SEED) -> DataFrame:
    """Rows whose key hash falls below ``fraction`` (L1)."""
    return df.where(hash_uniform([key], seed) < F.lit(fraction))


def _places_in_class(df: DataFrame, key: str, label: str, purpose: str, seed: int) -> DataFrame:
    """(key, label, _place, _size): the 0-based place of each distinct key in its
    class, in the order of a salted hash, and the size of the class.

    Places are prefix counts over range partitions (no task holds a class); there
    is one size per class."""
    keys = df.where(F.col(label).isNotNull()).select(key, label).distinct()
    keys = keys.withColumn("_draw", _salted([key], purpose, seed)).withColumn("_one", F.lit(1))
    placed = prefix_counts(keys, [label], "_draw", ["_one"])
    sizes = keys.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    return placed.join(sizes, label).select(key, label, F.col("_one_before").alias("_place"), "_size")


def stratified_split(df: DataFrame, key: str, label: str, test_fraction: float = TEST_FRACTION,
                     seed: int = SEED) -> DataFrame:
    """Adds ``split`` = 'test' / 'train' (L2): of every class exactly the rounded
    ``test_fraction`` of its keys is test.  Rows without a label get null."""
    placed = _places_in_class(df, key, label, "split", seed)
    split = F.when(F.col("_place") < F.floor(F.col("_size") * test_fraction + 0.5), "test").otherwise("train")
    return df.join(placed.select(key, label, split.alias("split")), [key, label], "left").select(*df.columns, "split")


def kfold(df: DataFrame, key: str, label: str, k: int = CV_FOLDS, seed: int = SEED) -> DataFrame:
    """Adds ``fold`` in 0..k-1 (L3): in every class the folds differ by at most
    one key, and do not follow any earlier split."""
    placed = _places_in_class(df, key, label, "fold", seed)
    folds = placed.select(key, label, (F.col("_place") % k).cast("int").alias("fold"))
    return df.join(folds, [key, label], "left").select(*df.columns, "fold")


def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` appears in ``keys`` (left semi join, C8)."""
    return df.join(keys.select(on), on, "left_semi")


def semi_either(df: DataFrame, keys_a: DataFrame, on_a: str, keys_b: DataFrame, on_b: str) -> DataFrame:
    """Rows whose ``on_a`` is in ``keys_a`` OR whose ``on_b`` is in ``keys_b``.

    Two equi left joins against the de-duplicated key sets give two flags;
    no nested-loop join on an OR condition, no union and no re-dedupe."""
    a = keys_a.select(on_a).distinct().withColumn("_in_a", F.lit(True))
    b = keys_b.select(on_b).distinct().withColumn("_in_b", F.lit(True))
    return (df.join(a, on_a, "left").join(b, on_b, "left")
            .where(F.coalesce(F.col("_in_a"), F.lit(False)) | F.coalesce(F.col("_in_b"), F.lit(False)))
            .drop("_in_a", "_in_b"))


def relation_sample(tables: dict[str, DataFrame], fraction: float, seed: int = SEED) -> dict[str, DataFrame]:
    """Sample clients, then keep every related row of the other tables (L4).

    clients -> bureau -> bureau_balance; clients -> previous_application;
    histories keep rows of a sampled client OR of a sampled previous
    application.  Histories keyed only by SK_ID_PREV get SK_ID_CURR from
    the ``prev_to_client`` bridge first.
    """
    app = sample_fraction(tables["current_app"], "SK_ID_CURR", fraction, seed)
    clients = app.select("SK_ID_CURR")
    bureau = semi(tables["bureau"], clients, "SK_ID_CURR")
    bureau_balance = semi(tables["bureau_balance"], bureau.select("SK_ID_BUREAU"), "SK_ID_BUREAU")
    prev = semi(tables["previous_application"], clients, "SK_ID_CURR")
    prev_ids = prev.select("SK_ID_PREV")
    out = {"current_app": app, "bureau": bureau, "bureau_balance": bureau_balance, "previous_application": prev}
    for name in ("POS_CASH_balance", "installments_payments", "credit_card_balance"):
        df = tables[name]
        if "SK_ID_CURR" not in df.columns:
            df = df.join(tables["prev_to_client"], "SK_ID_PREV", "inner")
        out[name] = semi_either(df, clients, "SK_ID_CURR", prev_ids, "SK_ID_PREV")
    return out
