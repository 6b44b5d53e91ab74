"""Strongly correlated feature pairs of a wide table.

Spearman correlation over the pairwise-complete rows, for hundreds of features:

1. Every feature is ranked once over its own rows: blocks of rows exchange their distinct
   values for ranks (:mod:`riskfold.operators.runs`), no cell moves as a row.
2. One pass over the blocks' rank matrices adds up, for all pairs at once, the moments of
   the two ranks over the rows that have both (``_moments``): a product of matrices a
   block, summed by blocks of features.
3. Where two features are null in the same rows, that is the correlation.  Elsewhere the
   ranks among the common rows S differ from the own ranks r by at most the k rows that
   S lacks, so the centred rank vectors lie within an angle of ``asin(k / 2 * sqrt(|S|) / |r|)``
   of each other (a variable within [0, k] has no larger deviation than k / 2).  A pair whose
   angle cannot be small enough for the threshold, whatever the two errors are, is settled.
4. Features of the pairs left are ranked again over the common rows of their two null
   patterns, and correlated there.

Defined results: a feature that is constant over the common rows has no correlation;
fewer than two common rows give none; an empty table gives no pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.operators.runs import BLOCKS, RunTotals, blocks, column_run, pieces, ranges, run_ranks
from riskfold.session import cut_lineage, ship_package

BLOCK = 64


def _moments(records: DataFrame, sets: list[list[int]], edges: dict, totals: RunTotals) -> DataFrame:
    """(set, lo, sums): for the features i from ``lo`` and all j of a set, over the rows that
    have both: rows, sum r_i, sum r_j, sum r_i^2, sum r_j^2, sum r_i r_j; r are average ranks
    inside the set, less their mean.  Every task sends its sums."""
    import pyarrow as pa

    places = [{f: k for k, f in enumerate(members)} for members in sets]

    def add_up(batches):
        held: dict[int, np.ndarray] = {}
        now, codes, ranks = None, {}, {}

        def add():
            s, own = now[0], places[now[0]]
            matrix = np.zeros((len(next(iter(codes.values()))), len(own)))
            has = np.zeros_like(matrix)
            for f, code in codes.items():
                there = code > 0
                if there.any():
                    matrix[there, own[f]] = np.concatenate(ranks[f])[code[there] - 1]
                    has[there, own[f]] = 1.0
            square = matrix * matrix
            a, b = matrix.T @ has, square.T @ has
            part = np.stack([has.T @ has, a, a.T, b, b.T, matrix.T @ matrix])
            held[s] = held[s] + part if s in held else part

        for batch in batches:
            for s, block, f, at, data in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                if (s, block) != now:
                    if now is not None:
                        add()
                    now, codes, ranks = (s, block), {}, {}
                if at < 0:
                    codes[f] = np.frombuffer(data.as_py(), np.uint16).astype(np.int64)
                else:
                    shift = totals.before[s, f, at] - (totals.sizes[s, f] + 1) / 2.0
                    ranks.setdefault(f, []).append(np.frombuffer(data.as_py(), np.int64) / 2.0 + shift)
        if now is not None:
            add()
        for s, sums in held.items():
            los = range(0, len(sets[s]), BLOCK)
            yield pa.record_batch([pa.array([s] * len(los), pa.int32()), pa.array(list(los), pa.int32()),
                                   pa.array([np.ascontiguousarray(sums[:, lo:lo + BLOCK]).tobytes() for lo in los], pa.binary())],
                                  ["set", "lo", "sums"])

    codes = records.select("set", "block", "f", F.lit(-1).alias("range"), F.col("codes").alias("data"))
    met = codes.unionByName(run_ranks(pieces(records, edges))).repartition("set", "block").sortWithinPartitions("set", "block", "f", "range")
    return met.mapInArrow(add_up, "set int, lo int, sums binary")


def _pairs(records: DataFrame, sets: list[list[int]], rows: int, threshold: float) -> DataFrame:
    """(set, i, j, rho, settled) of the pairs i < j of every set that may reach the threshold;
    rho is exact where settled.  Where settled is null, j is the first feature that has the
    same rows as i."""
    import pyarrow as pa

    edges = ranges(records, rows)
    totals = RunTotals.of(pieces(records, edges))
    sizes = [np.array([totals.sizes.get((s, f), 0) for f in members], float) for s, members in enumerate(sets)]

    def judge(s: int, lo: int, sums: np.ndarray):
        members = np.array(sets[s])
        n, si, sj, sii, sjj, sij = sums.reshape(6, -1, len(members))
        i, j = members[lo:lo + len(n), None], members[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            vi, vj = sii - si * si / n, sjj - sj * sj / n
            flat = (vi <= 1e-9 * np.maximum(sii, 1)) | (vj <= 1e-9 * np.maximum(sjj, 1))
            rho = np.where(flat | (n < 2), np.nan, (sij - si * sj / n) / np.sqrt(vi * vj))
            lacks_i = sizes[s][lo:lo + len(n), None] - n
            return n, i, j, vi, vj, rho, lacks_i

    def run(batches):
        now, total = None, None

        def found():
            s, lo = now
            n, i, j, vi, vj, rho, lacks_i = judge(s, lo, total)
            lacks_j = sizes[s][None, :] - n
            settled = (lacks_i == 0) & (lacks_j == 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                wide = [np.where(k == 0, 0.0, np.arcsin(np.minimum(1.0, np.nan_to_num(k / 2 * np.sqrt(n / v), nan=1.0, posinf=1.0))))
                        for k, v in ((lacks_i, vi), (lacks_j, vj))]
            angle = np.arccos(np.clip(np.abs(np.nan_to_num(rho)), 0.0, 1.0))
            most = np.cos(np.maximum(0.0, angle - wide[0] - wide[1]))
            keep = (i < j) & (n >= 2) & np.where(settled, np.abs(np.nan_to_num(rho)) > threshold, most > threshold)
            a, b = np.nonzero(keep)
            same = np.argmax(settled, axis=1)
            left, right = (np.r_[np.broadcast_to(k, n.shape)[a, b], more].astype(np.int32) for k, more in ((i, i[:, 0]), (j, j[0, same])))
            return pa.record_batch([pa.array(np.full(len(left), s, np.int32)), pa.array(left), pa.array(right),
                                    pa.array(np.r_[rho[a, b], np.zeros(len(same))]), pa.array([*settled[a, b].tolist(), *[None] * len(same)], pa.bool_())],
                                   ["set", "i", "j", "rho", "settled"])

        for batch in batches:
            for s, lo, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                part = np.frombuffer(sums.as_py(), np.float64)
                if (s, lo) != now:
                    if now is not None:
                        yield found()
                    now, total = (s, lo), part.copy()
                else:
                    total += part
        if now is not None:
            yield found()

    return (_moments(records, sets, edges, totals).repartition("set", "lo").sortWithinPartitions("set", "lo")
            .mapInArrow(run, "set int, i int, j int, rho double, settled boolean"))


def _restricted(records: DataFrame, sets: list[tuple[list[int], tuple[int, int]]]) -> DataFrame:
    """The records of the members of every set over those rows that have both of its two
    features, stored."""
    import pyarrow as pa

    def bits(batches):
        for batch in batches:
            masks = [np.packbits(np.frombuffer(c, np.uint16) > 0).tobytes() for c in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(masks, pa.binary())], ["block", "f", "rows"])

    def run(batches):
        for batch in batches:
            out = []
            for codes, x, a, b in zip(*(batch.column(k).to_pylist() for k in range(3, 7))):
                codes, x = np.frombuffer(codes, np.uint16), np.frombuffer(x, np.float64)
                both = np.frombuffer(a, np.uint8) & np.frombuffer(b, np.uint8)
                there = (codes > 0) & np.unpackbits(both, count=len(codes)).astype(bool)
                values = np.zeros(len(codes))
                values[there] = x[codes[there] - 1]
                out.append(column_run(values, there, np.zeros(len(codes), bool)))
            if out:
                yield pa.record_batch([*(batch.column(k) for k in range(3)), *[pa.array(c, pa.binary()) for c in zip(*out)]],
                                      ["set", "block", "f", "codes", "x", "n", "n1"])

    spark = records.sparkSession
    wanted = spark.createDataFrame([(s, f, *pattern) for s, (members, pattern) in enumerate(sets) for f in members], "set int, f int, p int, q int")
    leaders = sorted({f for _, pattern in sets for f in pattern})
    # a bit a row and null pattern
    masks = cut_lineage(records.where(F.col("f").isin(leaders)).select("block", "f", "codes").mapInArrow(bits, "block long, f int, rows binary"))
    one, two = (masks.select("block", F.col("f").alias(k), F.col("rows").alias(f"rows_{k}")) for k in "pq")
    joined = records.drop("set").join(F.broadcast(wanted), "f").join(one, ["block", "p"]).join(two, ["block", "q"])
    return cut_lineage(joined.select("set", "block", "f", "codes", "x", "rows_p", "rows_q").mapInArrow(run, BLOCKS), "zstd")


def strong_pairs(df: DataFrame, features: list[str], key: str, threshold: float) -> DataFrame:
    """feature_i, feature_j, i, j, rho of the pairs i < j with |rho| > threshold; ``key``
    names the rows."""
    ship_package(df.sparkSession)
    records = blocks(df, features)
    rows = records.where("f = 0").agg(F.sum(F.length("codes")) / 2).first()[0]
    everything = [list(range(len(features)))]
    total = int(rows or 0)
    found = cut_lineage(_pairs(records, everything, total, threshold))
    exact = found.where("settled").select("i", "j", "rho")
    left = found.where("not settled").select("i", "j").collect()  # at most one row a pair of features
    if left:
        group = {r["i"]: r["j"] for r in found.where("settled is null").collect()}
        needed: dict[tuple[int, int], set[int]] = {}
        for r in left:
            needed.setdefault(tuple(sorted((group[r["i"]], group[r["j"]]))), set()).update((r["i"], r["j"]))
        sets = [(sorted(members), pattern) for pattern, members in needed.items()]
        again = _pairs(_restricted(records, sets), [members for members, _ in sets], total, threshold).where("settled")
        # a set also pairs features of one pattern, which are settled already
        pattern = F.array(*[F.lit(group.get(f, -1)) for f in range(len(features))])
        again = again.where(F.get(pattern, F.col("i")) != F.get(pattern, F.col("j"))).select("i", "j", "rho")
        exact = exact.unionByName(again)
    names = F.array(*[F.lit(c) for c in features])
    return exact.select(F.get(names, F.col("i")).alias("feature_i"), F.get(names, F.col("j")).alias("feature_j"), "i", "j", "rho")
