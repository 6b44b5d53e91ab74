"""Ranks of all cells of a wide table by exchanging sorted runs.

A row for every (row, feature) cell costs several times its value in each shuffle.  Here rows
are cut into blocks (``blocks``), and every feature of a block is one record: the sorted
distinct values with their counts, and per row the number of its value.  Only the distinct
values of a block travel, cut at quantiles of the feature (``ranges``), so that whoever puts
together the runs of a (feature, range) holds some ``RANGE_ROWS`` values, however many rows
there are.  Ranks inside a range become ranks of the feature by the number of values in
earlier ranges (``RunTotals``).

Records have the number ``set`` of the set of rows that they belong to, 0 for all rows.
Nulls have no value; NaN is one above every number; -0.0 is 0.0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.operators.quantiles import as_array
from riskfold.session import cut_lineage, ship_package

CELLS = 1 << 21  # of a block
RANGE_ROWS = 1 << 20
POINTS = 4  # that a block sends for every range

BLOCKS = "set int, block long, f int, codes binary, x binary, n binary, n1 binary"
PIECES = "set int, block long, f int, range int, total long, total1 long, x binary, n binary, n1 binary"


def column_run(values: np.ndarray, there: np.ndarray, ones: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """codes (0: null, k + 1: the k-th value), distinct values in order, how many rows have
    each, and how many of them are ``ones``."""
    x, of, n = np.unique(values[there], return_inverse=True, return_counts=True)
    codes = np.zeros(len(values), np.uint16)
    codes[there] = of + 1
    n1 = np.bincount(of[ones[there]], minlength=len(x))
    return codes.tobytes(), x.tobytes(), n.astype(np.uint16).tobytes(), n1.astype(np.uint16).tobytes()


def blocks(df: DataFrame, features: list[str], flag=None) -> DataFrame:
    """The records of all features over all rows, stored; ``flag`` is the condition of the rows
    that ``n1`` counts."""
    import pyarrow as pa

    ship_package(df.sparkSession)
    width = len(features)
    most = max(1, min((1 << 16) - 1, CELLS // max(1, width)))

    def run(batches):
        held, rows = [], 0

        def packed():
            values, there = (np.concatenate([part[k] for part in held]) for k in (0, 1))
            ones = np.concatenate([part[2] for part in held])
            records = [column_run(values[:, f], there[:, f], ones) for f in range(width)]
            codes, x, n, n1 = zip(*records)
            return pa.record_batch([pa.array(range(width), pa.int32()), *[pa.array(c, pa.binary()) for c in (codes, x, n, n1)]],
                                   ["f", "codes", "x", "n", "n1"])

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                flat = part.column(0).flatten()
                there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
                values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
                ones = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                if rows + part.num_rows > most:
                    yield packed()
                    held, rows = [], 0
                held.append((values, there, ones))
                rows += part.num_rows
        if rows:
            yield packed()

    counted = F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))
    if not features:
        return df.sparkSession.createDataFrame([], BLOCKS)
    made = (df.select(as_array(features), counted.alias("one"))
            .mapInArrow(run, "f int, codes binary, x binary, n binary, n1 binary")
            # the records of a block are neighbours, each as far from the first as its number
            .withColumn("block", F.monotonically_increasing_id() - F.col("f")))
    return cut_lineage(made.select(F.lit(0).alias("set"), "block", "f", "codes", "x", "n", "n1"), "zstd")


def ranges(records: DataFrame, rows: int) -> dict[tuple[int, int], np.ndarray]:
    """(set, f) -> upper edges of its ranges but the last: quantiles of evenly spaced values
    of every block, so that a range holds about ``RANGE_ROWS`` of the ``rows``."""
    import pyarrow as pa

    count = -(-rows // RANGE_ROWS)
    if count < 2:
        return {}
    points = POINTS * count

    def run(batches):
        for batch in batches:
            for s, f, x, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
                x, n = np.frombuffer(x, np.float64), np.frombuffer(n, np.uint16).astype(np.int64)
                reached = np.cumsum(n)
                if not len(x):
                    continue
                picked = x[np.searchsorted(reached, np.arange(1, points + 1) * (reached[-1] / points) - 1e-6)]
                picked = picked[np.isfinite(picked)]
                yield pa.record_batch([pa.array(np.full(len(picked), s, np.int32)), pa.array(np.full(len(picked), f, np.int32)),
                                       pa.array(picked)], ["set", "f", "x"])

    cuts = F.array(*[F.lit(k / count) for k in range(1, count)])
    found = (records.select("set", "f", "x", "n").mapInArrow(run, "set int, f int, x double")
             .groupBy("set", "f").agg(F.percentile_approx("x", cuts, 1000).alias("edges")).collect())
    return {(r["set"], r["f"]): np.unique(np.array(r["edges"], np.float64)) for r in found}


def pieces(records: DataFrame, edges: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """The values of the ``records`` cut at the edges, with how many rows have them."""
    import pyarrow as pa

    none = np.zeros(0)

    def run(batches):
        for batch in batches:
            out = []
            for s, block, f, x, n, n1 in zip(*(batch.column(k).to_pylist() for k in range(6))):
                values, n, n1 = np.frombuffer(x, np.float64), np.frombuffer(n, np.uint16), np.frombuffer(n1, np.uint16)
                of = np.searchsorted(edges.get((s, f), none), values, side="left")
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
                for lo, hi in zip(starts, [*starts[1:], len(of)]):
                    out.append((s, block, f, int(of[lo]), int(n[lo:hi].sum(dtype=np.int64)), int(n1[lo:hi].sum(dtype=np.int64)),
                                values[lo:hi].tobytes(), n[lo:hi].tobytes(), n1[lo:hi].tobytes()))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = ["set", "block", "f", "range", "total", "total1", "x", "n", "n1"]
    return records.select("set", "block", "f", "x", "n", "n1").mapInArrow(run, PIECES)


@dataclass
class RunTotals:
    """How many values each (set, f) has, and how many its earlier ranges have."""

    sizes: dict[tuple[int, int], int]
    before: dict[tuple[int, int, int], int]

    @classmethod
    def of(cls, cut: DataFrame) -> "RunTotals":
        sizes: dict[tuple[int, int], int] = {}
        before: dict[tuple[int, int, int], int] = {}
        # one row a feature and range
        for r in sorted(cut.groupBy("set", "f", "range").agg(F.sum("total").alias("n")).collect()):
            at = (r["set"], r["f"])
            before[*at, r["range"]] = sizes.get(at, 0)
            sizes[at] = sizes.get(at, 0) + r["n"]
        return cls(sizes, before)


def merged(table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the pieces of one (set, f, range): lengths of the pieces; for all their values in
    one row the place among the distinct values; how often each distinct value occurs; twice
    its average rank inside the range."""
    x = [np.frombuffer(b, np.float64) for b in table.column("x").to_pylist()]
    n = np.concatenate([np.frombuffer(b, np.uint16) for b in table.column("n").to_pylist()]).astype(np.int64)
    distinct, at = np.unique(np.concatenate(x), return_inverse=True)
    counts = np.zeros(len(distinct), np.int64)
    np.add.at(counts, at, n)
    return np.array([len(b) for b in x]), at, counts, 2 * np.cumsum(counts) - counts + 1


def run_ranks(cut: DataFrame) -> DataFrame:
    """(set, block, f, range, data): twice the average ranks inside the range of a piece's values."""
    import pyarrow as pa

    def rank(table):
        lengths, at, _, twice = merged(table)
        each = np.split(twice[at], np.cumsum(lengths)[:-1])
        return table.select(["set", "block", "f", "range"]).append_column("data", pa.array([r.tobytes() for r in each], pa.binary()))

    return (cut.select("set", "block", "f", "range", "x", "n").groupBy("set", "f", "range")
            .applyInArrow(rank, "set int, block long, f int, range int, data binary"))
