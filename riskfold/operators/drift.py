"""Train-versus-serving drift per feature.

The original only exports the two feature tables for a drift study; the
measure here is the population stability index over reference-quantile
bins plus the change in null rate.  Bin edges are exact reference deciles
(radix selection, no sampling); both sides are binned in one pass
each and only (feature, bin) counts are aggregated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskfold.operators.profile import exact_quantile_table
from riskfold.operators.quantiles import as_array
from riskfold.session import ship_package


def bin_edges(reference: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """feature, edges: sorted distinct exact reference quantiles at 1/bins .. (bins-1)/bins."""
    qs = [i / bins for i in range(1, bins)]
    table = exact_quantile_table(reference, features, qs).where(F.col("quantile").isNotNull())
    return table.groupBy("feature").agg(F.array_sort(F.array_distinct(F.collect_list("quantile"))).alias("edges"))


def _bin_counts(df: DataFrame, features: list[str], edges: dict[str, list[float]]) -> DataFrame:
    """(f, bin, n): the rows of feature number f by how many of its edges lie below the value,
    counted inside the tasks; bin is null where there is no value, or no edge to compare with."""
    import pyarrow as pa

    ship_package(df.sparkSession)
    cuts = [np.array(edges[c], np.float64) if c in edges else None for c in features]

    def run(batches):
        held = [np.zeros(2 + (0 if e is None else len(e)), np.int64) for e in cuts]  # the first: no bin
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(0).flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(features))
            values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(features))
            for f, e in enumerate(cuts):
                known = there[:, f]
                if e is None:
                    held[f][0] += batch.num_rows
                    continue
                held[f][0] += batch.num_rows - np.count_nonzero(known)
                held[f][1:] += np.bincount(np.searchsorted(e, values[known, f], side="left"), minlength=len(e) + 1)
        for f, counts in enumerate(held):
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(np.full(len(at), f, np.int32)), pa.array([k - 1 if k else None for k in at.tolist()], pa.int32()),
                                   pa.array(counts[at])], ["f", "bin", "n"])

    return df.select(as_array(features)).mapInArrow(run, "f int, bin int, n long").groupBy("f", "bin").agg(F.sum("n").alias("n"))


def _binned_shares(df: DataFrame, features: list[str], edges: dict[str, list[float]], side: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in features])
    counts = _bin_counts(df, features, edges).withColumn("feature", F.get(names, F.col("f")))
    # totals from the counts: one row a bin, the null bin among them
    every = Window.partitionBy("feature")
    rows, there = F.sum("n").over(every), F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))).over(every)
    shares = counts.select("feature", "bin", (F.col("n") / there).alias(f"share_{side}"), (1 - there / rows).alias(f"null_rate_{side}"))
    return shares.where(F.col("bin").isNotNull())


def psi_drift(reference: DataFrame, current: DataFrame, features: list[str], bins: int = 10,
              eps: float = 1e-4) -> DataFrame:
    """feature, psi, null_rate_reference, null_rate_current, null_rate_diff."""
    # at most bins - 1 edges a feature
    edges = {r["feature"]: r["edges"] for r in bin_edges(reference, features, bins).collect()}
    ref = _binned_shares(reference, features, edges, "reference")
    cur = _binned_shares(current, features, edges, "current")
    both = ref.join(cur, ["feature", "bin"], "full")
    pr = F.greatest(F.coalesce(F.col("share_reference"), F.lit(0.0)), F.lit(eps))
    pc = F.greatest(F.coalesce(F.col("share_current"), F.lit(0.0)), F.lit(eps))
    return (both.groupBy("feature")
            .agg(F.sum((pc - pr) * F.log(pc / pr)).alias("psi"),
                 F.max("null_rate_reference").alias("null_rate_reference"),
                 F.max("null_rate_current").alias("null_rate_current"))
            .withColumn("null_rate_diff", F.col("null_rate_current") - F.col("null_rate_reference")))
