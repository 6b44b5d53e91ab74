"""Exact order statistics of many columns by radix selection.

A double's bits, with the lower 63 turned round where the sign is set, order like the
double itself.  Every pass reads the rows once and counts, for all columns at once, the
next ``DIGIT`` bits of those values whose leading bits are still those of a wanted order
statistic: at most 2 ** DIGIT counters a column and wanted prefix, whatever the number of
rows.  Running counts then pick each statistic's next digit, so that after 64 bits the
values are known.  The passes are the same at every size, and hot values are no case of
their own.

Nulls are not counted; NaN is above every number; -0.0 is 0.0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskfold.session import ship_package

DIGIT = 13
TOP = -(1 << 63)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Longs that order like the doubles ``values``."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def from_ordered(bits: int) -> float:
    raw = bits ^ ((1 << 63) - 1) if bits < 0 else bits
    return float(np.array([raw], np.int64).view(np.float64)[0])


#: Column of a stored table that holds the doubles of a row's features in order.  A scan of one
#: array column costs a fraction of one of hundreds of columns, which every pass would pay.
PACKED = "_packed"


def as_array(columns: list[str], name: str = "values"):
    """One array of doubles of all columns, parsed in one go: hundreds of separate
    expressions take longer to build than to run."""
    names = ["`" + c.replace("`", "``") + "`" for c in columns]
    return F.expr("array(" + ", ".join(f"cast({c} as double)" for c in names) + ")").alias(name)


def row_values(df: DataFrame, columns: list[str]):
    """The ``columns`` of a row as one array: the stored one where ``df`` is packed by them."""
    return F.col(PACKED).alias("values") if PACKED in df.columns else as_array(columns)


def _digit_counts(rows: DataFrame, columns: list[str], shift: int, width: int, prefixes: list[list[int]]) -> DataFrame:
    """(f, prefix, digit, n): how many values of column f with the leading bits ``prefix``
    have ``digit`` in the ``width`` bits above ``shift``."""
    import pyarrow as pa

    top = shift + width

    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            flat = batch.column(0).flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(columns))
            values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(columns))
            for f, wanted in enumerate(prefixes):
                if not wanted:
                    continue
                bits = ordered_bits(np.ascontiguousarray(values[there[:, f], f]))
                digits = ((bits >> shift) & ((1 << width) - 1)) if top < 64 else (bits >> shift) + (1 << (width - 1))
                for prefix in wanted:
                    mine = digits if top >= 64 else digits[(bits >> top) == prefix]
                    got = np.bincount(mine, minlength=1 << width)
                    held[f, prefix] = held[f, prefix] + got if (f, prefix) in held else got
        for (f, prefix), counts in held.items():
            digit = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(np.full(len(digit), f, np.int32)), pa.array(np.full(len(digit), prefix, np.int64)),
                                   pa.array(digit.astype(np.int32)), pa.array(counts[digit].astype(np.int64))], ["f", "prefix", "digit", "n"])

    return (rows.mapInArrow(run, "f int, prefix long, digit int, n long")
            .groupBy("f", "prefix", "digit").agg(F.sum("n").alias("n")))


def column_moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, float, float]]:
    """(count, mean, population std) of every column that has values: each task's counts,
    means and squared deviations, put together around the common mean."""
    import pyarrow as pa

    ship_package(df.sparkSession)

    def run(batches):
        n, mean, m2 = (np.zeros(len(columns)) for _ in range(3))
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(0).flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(columns))
            values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(columns))
            k = there.sum(axis=0)
            own = np.divide(np.where(there, values, 0.0).sum(axis=0), k, out=np.zeros(len(columns)), where=k > 0)
            part = (np.where(there, values - own, 0.0) ** 2).sum(axis=0)
            both = n + k
            share = np.divide(k, both, out=np.zeros(len(columns)), where=both > 0)
            m2 += part + (own - mean) ** 2 * n * share
            mean += (own - mean) * share
            n = both
        f = np.flatnonzero(n)
        yield pa.record_batch([pa.array(f.astype(np.int32)), pa.array(n[f].astype(np.int64)), pa.array(mean[f]), pa.array(m2[f])],
                              ["f", "n", "mean", "m2"])

    each = df.select(row_values(df, columns)).mapInArrow(run, "f int, n long, mean double, m2 double")
    every = Window.partitionBy("f")
    centre = F.sum(F.col("n") * F.col("mean")).over(every) / F.sum("n").over(every)
    total = (each.withColumn("centre", centre).groupBy("f")
             .agg(F.sum("n").alias("n"), F.first("centre").alias("mean"),
                  F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("centre")) * (F.col("mean") - F.col("centre"))).alias("m2")))
    return {columns[r["f"]]: (r["n"], r["mean"], float(np.sqrt(r["m2"] / r["n"]))) for r in total.collect()}


def order_statistics(df: DataFrame, columns: list[str], qs: list[float]) -> tuple[list[int], dict[tuple[int, int], float]]:
    """The number of values of every column, and (column number, rank) -> value for the ranks
    (from 0) that the interpolated quantiles ``qs`` need."""
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(row_values(df, columns))
    counts = [0] * len(columns)
    # (column, rank) -> (leading bits, rank among the values that have them)
    wanted: dict[tuple[int, int], tuple[int, int]] = {}
    shift = 64
    while shift:
        width = min(DIGIT, shift)
        shift -= width
        first = shift + width == 64
        prefixes = [[0] if first else [] for _ in columns]
        for (f, _), (prefix, _) in wanted.items():
            if prefix not in prefixes[f]:
                prefixes[f].append(prefix)
        found = _digit_counts(rows, columns, shift, width, prefixes)
        if first:
            found = found.persist()
            try:
                for r in found.groupBy("f").agg(F.sum("n").alias("n")).collect():
                    counts[r["f"]] = r["n"]
                wanted = {(f, k): (0, k) for f, n in enumerate(counts) for q in qs if n for k in _ranks(q, n)}
                picked = _pick(spark, found, wanted)
            finally:
                found.unpersist()
        else:
            picked = _pick(spark, found, wanted)
        for f, rank, digit, within in picked:
            prefix = wanted[f, rank][0]
            wanted[f, rank] = (digit - (1 << (width - 1)) if first else (prefix << width) + digit), within
        if not wanted:
            break
    return counts, {key: from_ordered(bits) for key, (bits, _) in wanted.items()}


def _ranks(q: float, n: int) -> set[int]:
    low = int(q * (n - 1))
    return {low, min(low + 1, n - 1)}


def _pick(spark, found: DataFrame, wanted: dict) -> list[tuple[int, int, int, int]]:
    """(column, rank, next digit, rank among the values with that digit) of every wanted statistic."""
    if not wanted:
        return []
    asked = spark.createDataFrame([(f, prefix, rank, within) for (f, rank), (prefix, within) in wanted.items()],
                                  "f int, prefix long, rank long, within long")
    before = Window.partitionBy("f", "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    running = found.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = (running.join(F.broadcast(asked), ["f", "prefix"])  # two statistics a column and quantile
            .where((F.col("within") >= F.col("before")) & (F.col("within") < F.col("before") + F.col("n"))).collect())
    return [(r["f"], r["rank"], r["digit"], r["within"] - r["before"]) for r in rows]


def quantile_values(df: DataFrame, columns: list[str], qs: list[float]) -> dict[tuple[str, float], float | None]:
    """Exact interpolated quantiles, keyed (column, q); None for a column without values."""
    counts, values = order_statistics(df, columns, qs)
    out: dict[tuple[str, float], float | None] = {}
    for f, c in enumerate(columns):
        for q in qs:
            n = counts[f]
            if not n:
                out[c, q] = None
                continue
            place = q * (n - 1)
            low = int(place)
            a, b = values[f, low], values[f, min(low + 1, n - 1)]
            out[c, q] = a if a == b else float(a + (b - a) * (place - low))
    return out
