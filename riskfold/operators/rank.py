"""Exact ranks at scale: average ranks (ties share the mean rank) per group
without a global sort in one task (SURVEY E2, used by K1 / K2 / M14).

The values are first collapsed to distinct (group, value) rows with counts
(map-side combine: a value held by a third of the rows becomes one row per
task).  The distinct rows are range-partitioned on (group, value), sorted and
counted on inside each range, and stored so; per-partition totals are
collected (one row per partition and group) and turned into offsets, which are
added to the running counts.  No task sees more than its range partition; the
driver sees only partition totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.session import cut_lineage, ship_package


def prefix_counts(counts: DataFrame, groups: list[str], order: str, weights: list[str],
                  partitions: int | None = None) -> DataFrame:
    """For distinct rows (groups..., order, weights...) add ``{w}_before``:
    the sum of ``w`` over rows of the same group with a smaller ``order``."""
    spark = counts.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ship_package(spark)
    # sorted inside the range and summed there before it is stored: the rows move once
    sorted_rows = (counts.repartitionByRange(n, *groups, order).sortWithinPartitions(*groups, order)
                   .withColumn("_pid", F.spark_partition_id()))
    inside = [F.col(f"_in_{w}").cast("long") for w in weights]
    schema = T.StructType([*sorted_rows.schema.fields, *[T.StructField(f"_in_{w}", T.LongType()) for w in weights]])
    ranged = cut_lineage(sorted_rows.mapInArrow(_running(groups, weights), schema))
    totals = (ranged.groupBy("_pid", *groups).agg(*[F.sum(w).alias(w) for w in weights])
              .orderBy("_pid").collect())
    running: dict[tuple, list[int]] = {}
    offsets = []
    for r in totals:
        g = tuple(r[c] for c in groups)
        acc = running.setdefault(g, [0] * len(weights))
        offsets.append((r["_pid"], *g, *acc))
        running[g] = [a + (r[w] or 0) for a, w in zip(acc, weights)]
    group_fields = [f for f in ranged.schema.fields if f.name in groups]
    off_schema = T.StructType([T.StructField("_pid", T.IntegerType())] + group_fields
                              + [T.StructField(f"_off_{w}", T.LongType()) for w in weights])
    off = spark.createDataFrame(offsets, off_schema)
    # the offsets add the earlier ranges
    joined = ranged.join(F.broadcast(off), ["_pid", *groups], "left")
    return joined.select(*counts.columns, *[(own + F.coalesce(F.col(f"_off_{w}"), F.lit(0))).cast("long").alias(f"{w}_before")
                                            for own, w in zip(inside, weights)])


def _running(groups: list[str], weights: list[str]):
    """Adds ``_in_{w}`` to the sorted rows of a range: the sum of ``w`` over the rows of the
    same group before each."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        last, carry = None, [0] * len(weights)
        for batch in batches:
            if not batch.num_rows:
                continue
            # equal values, nulls and NaN included, have one code
            codes = [pc.dictionary_encode(batch.column(g), null_encoding="encode").indices.to_numpy() for g in groups]
            change = np.zeros(batch.num_rows, bool)
            for c in codes:
                change[1:] |= c[1:] != c[:-1]
            starts = np.r_[0, np.flatnonzero(change)]
            lengths = np.diff(np.r_[starts, batch.num_rows])
            first, end = (repr([batch.column(g)[k].as_py() for g in groups]) for k in (0, batch.num_rows - 1))
            added = []
            for k, w in enumerate(weights):
                own = pc.fill_null(batch.column(w).cast(pa.int64()), 0).to_numpy()
                before = np.cumsum(own) - own
                before = before - np.repeat(before[starts], lengths)
                if first == last:
                    before[:lengths[0]] += carry[k]
                carry[k] = int(before[-1] + own[-1])
                added.append(pa.array(before, pa.int64()))
            last = end
            yield pa.record_batch([*batch.columns, *added], [*batch.schema.names, *[f"_in_{w}" for w in weights]])

    return run


def average_ranks(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Distinct (groups, value) with ``rank``: 1-based average rank of the
    value inside its group (non-null values only)."""
    counts = (df.where(F.col(value).isNotNull()).groupBy(*groups, value)
              .agg(F.count(F.lit(1)).alias("_n")))
    pre = prefix_counts(counts, groups, value, ["_n"])
    return pre.select(*groups, value, (F.col("_n_before") + (F.col("_n") + 1) / 2.0).alias("rank"))
