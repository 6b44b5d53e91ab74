"""Group-by aggregations with pandas ``groupby`` semantics, expressed as one
``groupBy().agg()`` per call so Spark plans a single partial + final
aggregation (map-side combine absorbs hot keys before the shuffle).

Null semantics reproduced (SURVEY 1.4):
  N1  count counts non-nulls; mean/min/max of all-null is null; sum of all-null is 0
  N2  rows whose group key is null are dropped
  N3  "first" is the first non-null value in the requested order
  N4  a null category is all-zero in every dummy but still counts as a row
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.constants import NUMERIC_STATS
from riskfold.functions.names import numeric_columns, string_columns


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull())


def gathered(df: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` with those of a ``key`` together.  Where the rows of a key lie
    anywhere, a map-side combine finds next to nothing to combine: every row becomes a
    buffer of all statistics, held in the task's map and shuffled.  So the narrow rows move
    first, and the combine that follows leaves about one buffer a key.  The ``key`` returned is
    an expression of the one they lie by, which a group-by does not take for the key itself:
    so AQE may cut the partition of a hot key, whose parts the combine reduces to a buffer each."""
    return df.hint("rebalance", F.col(key)).withColumn(key, F.greatest(key, key))


def numeric_stat(c: str, stat: str) -> Column:
    col = F.col(c)
    if stat == "count":
        return F.count(col)
    if stat == "mean":  # avg would carry a second sum and count in the buffer
        return F.when(F.count(col) > 0, F.sum(col) / F.count(col))
    if stat == "max":
        return F.max(col)
    if stat == "min":
        return F.min(col)
    if stat == "sum":
        return F.coalesce(F.sum(col), F.lit(0))
    raise ValueError(stat)


def numeric_feature_columns(df: DataFrame, group_var: str, id_marker: str = "SK_ID") -> list[str]:
    return [c for c in numeric_columns(df) if c != group_var and id_marker not in c]


def agg_numeric_exprs(columns: list[str], df_name: str, stats=NUMERIC_STATS) -> list[Column]:
    return [numeric_stat(c, s).alias(f"{df_name}_{c}_{s}") for c in columns for s in stats]


def agg_numeric(df: DataFrame, group_var: str, df_name: str, columns: list[str] | None = None,
                id_marker: str = "SK_ID") -> DataFrame:
    """count, mean, max, min and sum of every numeric non-id column per key.

    Output columns: ``group_var`` and ``{df_name}_{column}_{stat}``.
    """
    cols = columns if columns is not None else numeric_feature_columns(df, group_var, id_marker)
    return _keyed(df, group_var).groupBy(group_var).agg(*agg_numeric_exprs(cols, df_name))


def count_categorical_exprs(vocabulary: dict[str, list[str]], df_name: str) -> list[Column]:
    exprs = []
    for c, values in vocabulary.items():
        for v in values:
            hits = F.count_if(F.col(c) == F.lit(v))
            exprs.append(hits.alias(f"{df_name}_{c}_{v}_count"))
            exprs.append((hits / F.count(F.lit(1))).alias(f"{df_name}_{c}_{v}_count_norm"))
    return exprs


def count_categorical(df: DataFrame, group_var: str, df_name: str,
                      vocabulary: dict[str, list[str]]) -> DataFrame:
    """Count and share of rows in each category of each string column per key.

    ``vocabulary`` maps column -> category list (fitted once with
    :func:`fit_vocabulary` or declared), so the plan needs no extra job to
    discover categories and its schema does not depend on the batch.
    Output: ``{df_name}_{column}_{value}_count`` and ``..._count_norm``.
    """
    return _keyed(df, group_var).groupBy(group_var).agg(*count_categorical_exprs(vocabulary, df_name))


def fit_vocabulary(df: DataFrame, columns: list[str] | None = None, max_values: int = 1000) -> dict[str, list[str]]:
    """Sorted distinct non-null values of each string column.

    Distinct (column, value) pairs are found with a distributed aggregation
    (map-side combine, so a hot value costs one row per task).  Their number
    per column is checked before anything reaches the driver; a column with
    more than ``max_values`` categories raises instead of being collected.
    """
    columns = columns if columns is not None else string_columns(df)
    if not columns:
        return {}
    pairs = (df.select(F.explode(F.array(*[
                F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
             ])).alias("p"))
             .select("p.column", "p.value")
             .where(F.col("value").isNotNull())
             .distinct())
    sizes = {r["column"]: r["n"] for r in pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    too_big = {c: n for c, n in sizes.items() if n > max_values}
    if too_big:
        raise ValueError(f"categorical columns exceed {max_values} values: {too_big}")
    vocab: dict[str, list[str]] = {c: [] for c in columns}
    for r in pairs.collect():
        vocab[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in vocab.items()}


def aggregate_through(df: DataFrame, inner_key: str, bridge: DataFrame, outer_key: str, df_name: str,
                      columns: list[str] | None = None, vocabulary: dict[str, list[str]] | None = None,
                      id_marker: str = "SK_ID") -> DataFrame:
    """:func:`agg_numeric` and :func:`count_categorical` per ``outer_key`` of
    rows that carry only ``inner_key`` (e.g. payments keyed by loan, rolled
    up to the client through a loan -> client bridge).

    The narrow rows move once, to the join with the bridge.  Statistics per
    inner key are not made before it: where the rows of a key lie anywhere, a
    map-side combine finds next to nothing to combine, and a buffer of all
    statistics is several times as wide as a row.  Behind the join the rows of
    an inner key lie together, so the combine per ``outer_key`` moves at most
    about one buffer an inner key.  The bridge grows with the rows and is not
    broadcast; AQE splits the join's partition of a hot inner key, and a hot
    outer key collapses map-side.
    """
    cols = columns if columns is not None else numeric_feature_columns(df, inner_key, id_marker)
    vocabulary = vocabulary or {}
    rows = _keyed(df, inner_key).select(*dict.fromkeys([inner_key, *cols, *vocabulary]))
    joined = rows.join(bridge.select(inner_key, outer_key).hint("merge"), inner_key, "inner")
    return _keyed(joined, outer_key).groupBy(outer_key).agg(*agg_numeric_exprs(cols, df_name),
                                                            *count_categorical_exprs(vocabulary, df_name))


def coded_value_at_latest(value: str, order: str, codes: list[str]) -> tuple[Column, Column]:
    """The value at the greatest ``order``, for a value with a declared vocabulary;
    rows with a null value are skipped, a null order comes last.

    Returns ``(aggregate, decode)``: the aggregate is ``max`` of one long
    that packs (order present, order, rank of the value in the sorted
    vocabulary), so the group-by keeps a fixed-width buffer and stays a
    hash aggregate (a string buffer would force a sort-based aggregate over
    every input row); ``decode`` turns the aggregated long back into the
    value.  Same tie rule: the greater value wins.  A value outside the
    vocabulary decodes to null (like every vocabulary-based block)."""
    vocab = sorted(codes)
    o, v = F.col(order), F.col(value)
    idx = F.array_position(F.array(*[F.lit(c) for c in vocab]), v)          # 1-based, 0 if absent
    key = (F.when(o.isNotNull(), F.lit(1 << 41)).otherwise(F.lit(0))
           + (F.coalesce(o.cast("long"), F.lit(0)) + F.lit(1 << 31)) * F.lit(256) + idx)
    agg = F.max(F.when(v.isNotNull(), key))

    def decode(packed: Column) -> Column:
        return F.when(packed % 256 > 0, F.element_at(F.array(*[F.lit(c) for c in vocab]),
                                                     (packed % 256).cast("int")))
    return agg, decode


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """tn, fp, fn, tp of a binary prediction with label order [0, 1]."""
    y, p = F.col(label), F.col(prediction)
    return df.agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))
