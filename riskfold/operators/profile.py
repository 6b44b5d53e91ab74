"""Data profiles: missing values, numeric summaries,
distinct counts and top values, each as a small Spark DataFrame.

Wide statistics are taken in one aggregation (partial aggregates only are
shuffled) and turned into one row per column with ``unpivot``.  The exact
median is a radix selection (:mod:`riskfold.operators.quantiles`): counters of a
fixed number only, at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskfold.functions.names import numeric_columns, string_columns
from riskfold.operators.quantiles import column_moments, quantile_values


def _long(df: DataFrame, columns: list[str], value_type: str = "double") -> DataFrame:
    """(column, value) rows of the non-null values of ``columns``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(value_type).alias("value"))
                                for c in columns]))
    return df.select(pairs.alias("p")).select("p.feature", "p.value").where(F.col("value").isNotNull())


def missing_values(df: DataFrame, digits: int = 2, nonzero_only: bool = True) -> DataFrame:
    """feature, missing_values, percentage (of all rows), sorted by percentage desc.

    One aggregate with a count per column; its single row is then turned into
    a row per column."""
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_n{k}") for k, c in enumerate(df.columns)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col("_rows") - F.col(f"_n{k}")).alias("missing_values"))
                               for k, c in enumerate(df.columns)]))
    stacked = (counted.select("_rows", each.alias("p")).select("p.*", "_rows").where("_rows > 0")
               .select("feature", "missing_values",
                       F.bround(F.col("missing_values") * 100.0 / F.col("_rows"), digits).alias("percentage")))
    if nonzero_only:
        stacked = stacked.where(F.col("missing_values") > 0)
    return stacked.orderBy(F.desc("percentage"), F.asc("feature"))


def exact_quantiles(df: DataFrame, columns: list[str], q: float = 0.5, **_tuning) -> DataFrame:
    """Exact interpolated ``q``-quantile of every column: (feature, quantile).  Tuning
    arguments of the selection by brackets that was here before are accepted without effect."""
    values = _quantile_values(df, columns, [q])
    return df.sparkSession.createDataFrame([(c, values[(c, q)]) for c in columns], "feature string, quantile double")


def exact_quantile_table(df: DataFrame, columns: list[str], qs: list[float]) -> DataFrame:
    """Exact interpolated quantiles: (feature, q, quantile), one selection run for all."""
    values = _quantile_values(df, columns, list(qs))
    return df.sparkSession.createDataFrame([(c, float(q), values[(c, q)]) for c in columns for q in qs],
                                           "feature string, q double, quantile double")


def _quantile_values(df: DataFrame, columns: list[str], qs: list[float], moments: dict | None = None) -> dict:
    """Exact interpolated quantiles keyed (column, q); ``moments`` receives (count, mean,
    population std) of every column with values."""
    if moments is not None:
        moments.update(column_moments(df, columns))
    return quantile_values(df, columns, qs)


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """feature, mean, median (exact, interpolated), std (sample), min, max."""
    cols = columns if columns is not None else numeric_columns(df)
    spark = df.sparkSession
    moments = (_long(df, cols).groupBy("feature")
               .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                    F.min("value").alias("min"), F.max("value").alias("max")))
    names = spark.createDataFrame([(c,) for c in cols], "feature string")
    medians = exact_quantiles(df, cols, 0.5).withColumnRenamed("quantile", "median")
    return (names.join(moments, "feature", "left").join(medians, "feature", "left")
            .select("feature", "mean", "median", "std", "min", "max"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n_unique (nulls excluded), exact, via distinct (column, value) pairs."""
    cols = columns if columns is not None else string_columns(df)
    return (_long(df, cols, "string").distinct().groupBy("feature")
            .agg(F.count(F.lit(1)).alias("n_unique")))


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent non-null values (ties: smaller value first)."""
    return (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc(column)).limit(n))


def column_overview(df: DataFrame, top: int = 5, rsd: float | None = None) -> DataFrame:
    """One row a column (D18): feature, is_text, rows, missing, n_unique and, for text columns,
    the ``top`` most frequent values as ``value: count`` (ties: smaller value first).

    Distinct values are counted exactly from (column, value) pairs, or, with ``rsd``, by
    mergeable sketches of that relative standard deviation in the one pass that counts
    rows (D14).  The most frequent values are cut to ``top`` a task before they are shuffled."""
    cols, text = df.columns, string_columns(df)
    aggs = [F.count(F.lit(1)).alias("rows")] + [F.count(F.col(f"`{c}`")).alias(f"n{k}") for k, c in enumerate(cols)]
    if rsd is not None:
        aggs += [F.approx_count_distinct(F.col(f"`{c}`"), rsd).alias(f"d{k}") for k, c in enumerate(cols)]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(c in text).alias("is_text"), (F.col("rows") - F.col(f"n{k}")).alias("missing"),
                                        *([F.col(f"d{k}").alias("n_unique")] if rsd is not None else [])) for k, c in enumerate(cols)]))
    out = df.agg(*aggs).select("rows", each.alias("c")).select("c.feature", "c.is_text", "rows", *[f"c.{n}" for n in ("missing", "n_unique")[:2 if rsd is not None else 1]])
    if rsd is None:
        out = out.join(distinct_counts(df, cols), "feature", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0).cast("long")))
    if not text:
        return out.withColumn("top_values", F.lit(None).cast("string"))
    counts = _long(df, text, "string").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    best = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    said = F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat("value", F.lit(": "), F.col("n").cast("string")).alias("said")))),
                       lambda x: x["said"])
    tops = best.groupBy("feature").agg(F.array_join(said, ", ").alias("top_values"))
    return out.join(tops, "feature", "left").select("feature", "is_text", "rows", "missing", "n_unique", "top_values")


def dataset_overview(df: DataFrame) -> dict[str, DataFrame]:
    """Shape, column types, missing values, numeric profile, distinct counts."""
    spark = df.sparkSession
    shape = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))
    types = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields],
                                  "feature string, type string")
    return {"shape": shape, "types": types, "missing": missing_values(df),
            "numeric": numeric_profile(df), "distinct": distinct_counts(df)}
