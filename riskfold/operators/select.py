"""Feature analysis and selection.

Spearman correlation is Pearson correlation of average ranks computed on
the pairwise-complete rows (N7).  Ranks come from the distributed exact
rank operator; the correlations are ordinary ``corr`` aggregates, so only
one number per feature (or feature pair) reaches the driver.  The greedy
pruning passes then run over that small edge list, never over data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.constants import CORRELATION_THRESHOLD
from riskfold.operators.rank import average_ranks
from riskfold.operators.runs import RunTotals, blocks, merged, pieces, ranges
from riskfold.session import cut_lineage


def _pearson(x: str, y: str):
    """Pearson correlation; null when either side is constant (no ranks spread)."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), F.covar_pop(x, y) / (sx * sy))


def spearman_with_target(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature, rho, abs_rho: Spearman correlation of each feature with a 0/1
    target over the rows where both are non-null (K1).

    Blocks of rows send every distinct value of a feature once, with its rows and those of
    class 1 (:mod:`riskfold.operators.runs`); where a range of values comes together they are
    ranked, and the correlation is taken from weighted moments.  The rank of the target has
    two values, which follow from the class counts.  Nothing goes back to the rows."""
    import numpy as np
    import pyarrow as pa

    known = df.where(F.col(target).isNotNull())
    records = blocks(known, features, F.col(target) == 1)
    rows = records.where("f = 0").agg(F.sum(F.length("codes")) / 2).first()[0]
    cut = pieces(records, ranges(records, int(rows or 0)))
    totals = RunTotals.of(cut)

    def sums(table):
        lengths, at, counts, twice = merged(table)
        ones = np.zeros(len(counts), np.int64)
        np.add.at(ones, at, np.concatenate([np.frombuffer(b, np.uint16) for b in table.column("n1").to_pylist()]).astype(np.int64))
        f, k = table.column("f")[0].as_py(), table.column("range")[0].as_py()
        r = twice / 2.0 + totals.before[0, f, k] - (totals.sizes[0, f] + 1) / 2.0  # the rank, less the mean of all
        found = [counts.sum(), ones.sum(), (counts * r).sum(), (counts * r * r).sum(), (ones * r).sum()]
        return pa.table([pa.array([f], pa.int32()), *[pa.array([float(v)]) for v in found]], ["f", "n", "n1", "s", "ss", "s1"])

    each = (cut.select("f", "range", "x", "n", "n1").groupBy("f", "range")
            .applyInArrow(sums, "f int, n double, n1 double, s double, ss double, s1 double"))
    n, n1 = F.col("n"), F.col("n1")
    share = n1 / n
    # the rank of the target is a line in the target: its slope cancels out
    spread = (F.col("ss") / n - (F.col("s") / n) * (F.col("s") / n)) * share * (1 - share)
    rho = F.when(spread > 0, (F.col("s1") / n - (F.col("s") / n) * share) / F.sqrt(spread))
    names = F.array(*[F.lit(c) for c in features])
    total = each.groupBy("f").agg(*[F.sum(c).alias(c) for c in ("n", "n1", "s", "ss", "s1")])
    return total.select(F.get(names, F.col("f")).alias("feature"), rho.alias("rho")).withColumn("abs_rho", F.abs("rho"))


def correlated_pairs(corr: DataFrame, threshold: float = CORRELATION_THRESHOLD) -> DataFrame:
    """Upper-triangle pairs (i < j in feature order) with |rho| > threshold (K3).

    ``corr`` has columns feature_i, feature_j, i, j, rho."""
    return corr.where((F.col("i") < F.col("j")) & (F.abs("rho") > threshold))


# Target correlations are compared after rounding to this many decimals:
# identical features must tie, and a distributed sum can differ from
# another in the last bits depending on arrival order.
CORRELATION_DIGITS = 12


def _rounded(target_corr: dict[str, float]) -> dict[str, float]:
    return {k: (None if v is None else round(v, CORRELATION_DIGITS)) for k, v in target_corr.items()}


@dataclass(frozen=True)
class CorrelationGraph:
    """Correlated pairs as later neighbours of each position in feature order,
    with the strength (rounded target correlation) of each position."""

    names: list[str]
    later: dict[int, list[int]]
    strength: list[float | None]

    @classmethod
    def build(cls, pairs: list[tuple[str, str]], features: list[str], target_corr: dict[str, float]) -> "CorrelationGraph":
        at = {name: k for k, name in enumerate(features)}
        later: dict[int, set[int]] = {}
        for pair in pairs:
            low, high = sorted(at[name] for name in pair)
            later.setdefault(low, set()).add(high)
        known = _rounded(target_corr)
        return cls(features, {k: sorted(v) for k, v in later.items()}, [known.get(f) for f in features])


def prune_by_group(pairs: list[tuple[str, str]], features: list[str], target_corr: dict[str, float]) -> set[str]:
    """Prune A (K4): a feature with correlated predecessors forms a group with
    them; all but the group's strongest (the earliest on ties; the feature
    itself where no strength is known) are dropped."""
    graph = CorrelationGraph.build(pairs, features, target_corr)
    groups: dict[int, list[int]] = {}
    for low, highs in graph.later.items():
        for high in highs:
            groups.setdefault(high, [high]).append(low)
    dropped: set[int] = set()
    for own, group in groups.items():
        known = [k for k in group if graph.strength[k] is not None]
        best = min(known, key=lambda k: (-graph.strength[k], k)) if known else own
        dropped |= set(group) - {best}
    return {features[k] for k in dropped}


def prune_greedy(pairs: list[tuple[str, str]], features: list[str], target_corr: dict[str, float]) -> set[str]:
    """Prune B (K5): the features are visited in order.  One that is still kept
    takes out its kept later neighbours that are not stronger, and goes itself
    when any of them is stronger (it takes out the weaker ones all the same)."""
    graph = CorrelationGraph.build(pairs, features, target_corr)
    strength = [s or 0.0 for s in graph.strength]
    dropped: set[int] = set()
    for own, neighbours in sorted(graph.later.items()):
        if own not in dropped:
            rivals = [k for k in neighbours if k not in dropped]
            weaker = {k for k in rivals if strength[k] <= strength[own]}
            dropped |= weaker | ({own} if len(weaker) < len(rivals) else set())
    return {features[k] for k in dropped}


def null_pattern_groups(df: DataFrame, features: list[str], key: str) -> list[list[str]]:
    """Partition ``features`` into groups with identical null rows.

    A signature (null count, sum of a 64-bit row hash over null rows) is
    taken per feature in one narrow pass; candidates sharing a signature are
    then verified exactly (no row may be null in one member and not in
    another); a group failing verification is split into singletons."""
    h = F.xxhash64(F.col(key)).cast("decimal(38,0)")
    flags = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).isNull().alias("isnull"))
                                for c in features]))
    sig = (df.select(h.alias("h"), flags.alias("p"))
           .groupBy(F.col("p.feature").alias("feature"))
           .agg(F.count_if("p.isnull").alias("n"), F.sum(F.when(F.col("p.isnull"), F.col("h"))).alias("s"))
           .collect())
    by_sig: dict[tuple, list[str]] = {}
    for r in sig:
        by_sig.setdefault((r["n"], str(r["s"])), []).append(r["feature"])
    groups = [sorted(g, key=features.index) for g in by_sig.values()]
    multi = [g for g in groups if len(g) > 1]
    if multi:
        checks = [F.count_if(F.greatest(*[F.col(c).isNull() for c in g]) != F.least(*[F.col(c).isNull() for c in g]))
                  .alias(f"g{i}") for i, g in enumerate(multi)]
        bad = df.agg(*checks).first()
        out = [g for g in groups if len(g) == 1]
        for i, g in enumerate(multi):
            out += [[c] for c in g] if bad[f"g{i}"] else [g]
        groups = out
    return sorted(groups, key=lambda g: features.index(g[0]))


def spearman_matrix(df: DataFrame, features: list[str], key: str) -> DataFrame:
    """feature_i, feature_j, i, j, rho for every pair i < j (K2).

    Exact pairwise-complete Spearman.  Features are grouped by null
    pattern; a pair of features from groups (a, b) is complete exactly on
    the rows complete for both groups, so each group pair is one ranking
    problem.  All group pairs are ranked in a single distributed rank pass
    (rank groups = (group pair, feature)), pivoted back to one rank vector
    per (group pair, row), checkpointed, and each group pair's correlation
    matrix is a distributed Gram matrix (``Correlation.corr``).  Ranks are
    never recomputed per feature pair; a row is repeated once per pair of
    null patterns, so this suits tables with few of them."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    spark = df.sparkSession
    df = cut_lineage(df.select(key, *features))
    groups = null_pattern_groups(df, features, key)
    index = {c: i for i, c in enumerate(features)}
    group_of = {c: g for g, members in enumerate(groups) for c in members}
    pairs = []
    for a in range(len(groups)):
        for b in range(a, len(groups)):
            members = groups[a] + (groups[b] if b != a else [])
            if len(members) >= 2:
                pairs.append((a, b, members))
    if not pairs:
        return spark.createDataFrame([], "feature_i string, feature_j string, i int, j int, rho double")
    complete = {g: F.col(members[0]).isNotNull() for g, members in enumerate(groups)}
    entries = []
    for p, (a, b, members) in enumerate(pairs):
        both = complete[a] & complete[b]
        for c in members:
            entries.append(F.when(both, F.struct(F.lit(p).alias("pair"), F.lit(c).alias("feature"),
                                                 F.col(c).cast("double").alias("x"))))
    long = (df.select(key, F.explode(F.array(*entries)).alias("e")).where(F.col("e").isNotNull())
            .select(key, "e.pair", "e.feature", "e.x"))
    ranks = average_ranks(long, ["pair", "feature"], "x")
    ranked = long.join(ranks, ["pair", "feature", "x"])
    wide = cut_lineage(ranked.groupBy("pair", key)
                       .agg(*[F.max(F.when(F.col("feature") == c, F.col("rank"))).alias(c) for c in features]))
    sizes = {r["pair"]: r["n"] for r in wide.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for p, (a, b, members) in enumerate(pairs):
        if not sizes.get(p):
            continue
        vec = VectorAssembler(inputCols=members, outputCol="v").transform(
            wide.where(F.col("pair") == p).select(*members)).select("v")
        mat = Correlation.corr(vec, "v", "pearson").first()[0].toArray()
        for u, ci in enumerate(members):
            for v, cj in enumerate(members):
                if index[ci] >= index[cj]:
                    continue
                if b != a and group_of[ci] == group_of[cj]:
                    continue
                rho = float(mat[u][v])
                rows.append((ci, cj, index[ci], index[cj], None if rho != rho else rho))
    return spark.createDataFrame(rows, "feature_i string, feature_j string, i int, j int, rho double")
