"""Operator 8: quality classifier by naive Bayes support vectors.

1. Features of a text: which byte n-grams (1 to ``MAX_GRAM`` bytes) and which
   runs of equal words it has -- indicators, hashed into ``BUCKETS`` buckets.
2. Corpus counts over all labelled training rows give every bucket its class
   log-count ratio; each task adds up its own rows before anything is shuffled,
   and the driver receives at most ``BUCKETS`` rows.
3. A linear hinge-loss model over the ratio-scaled indicators is fitted by dual
   coordinate descent on at most ``SAMPLE_ROWS`` training rows, drawn evenly by
   a hash of doc_id (the only bounded sample).
4. A fifth of that sample, kept out of the fit, turns margins into probabilities.
5. Scoring is one pass over all texts, without a shuffle; the model that is
   broadcast has a fixed size.

Labels of rows with crc32(doc_id as text) mod 4 = 2 are never read.  Only texts
enter a score.

Defined results: a null text is an empty text, which has the score of the bias
alone; a null doc_id is never a training row nor held out; labels that are null
are ignored, of several for one doc_id the mean decides (0.5 counts as good);
without rows of both classes every score is the smoothed share of good ones; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.llm.common import ship_package, text_of

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
MAX_GRAM = 4
MAX_RUN = 4
SAMPLE_ROWS = 4000
EPOCHS = 15
COST = 1.0
KEEP_AT = 0.7
#: Labels of up to so many documents are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_LABELS = 4_000_000


def features(text: str) -> np.ndarray:
    """The sorted distinct buckets of a text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    found = []
    for n in range(1, min(MAX_GRAM, len(raw)) + 1):
        h = np.full(len(raw) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ raw[k:len(raw) - n + 1 + k]
        found.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS))
    words = text.split()
    run = longest = 0
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 0
        longest = max(longest, run)
    # n-grams of one word over and over, whichever word it is
    found.append(np.arange(min(longest, MAX_RUN), dtype=np.uint64))
    return np.unique(np.concatenate(found)).astype(np.int32)


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Per bucket the ratio and the weight; the bias; slope and offset of the probability."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, text: str) -> float:
        x = features(text)
        r = self.ratio[x]
        return float(self.weight[x] @ r / np.sqrt(max(1.0, float(r @ r))) + self.bias)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, good) of the rows whose labels may be learnt."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~is_held_out())
             .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good")))
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.select("doc_id", text_of().alias("text")).join(known, "doc_id")


def log_count_ratios(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """Ratios of the shares of good and of bad rows that have a bucket; numbers of
    good and bad rows.  The numbers travel as bucket ``BUCKETS``."""
    def count(batches):
        good, bad = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text, is_good in zip(batch["text"], batch["good"]):
                side = good if is_good else bad
                side[features(text)] += 1
                side[BUCKETS] += 1
        seen = np.flatnonzero(good + bad)
        yield pd.DataFrame({"bucket": seen, "good": good[seen], "bad": bad[seen]})

    counts = (rows.select("text", "good").mapInPandas(count, "bucket int, good long, bad long")
              .groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow())
    good, bad = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    at = counts["bucket"].to_numpy()
    good[at], bad[at] = counts["good"].to_numpy(), counts["bad"].to_numpy()
    n_good, n_bad = int(good[BUCKETS]), int(bad[BUCKETS])
    ratio = np.log((good[:BUCKETS] + 1) / (n_good + 2)) - np.log((bad[:BUCKETS] + 1) / (n_bad + 2))
    ratio[good[:BUCKETS] + bad[:BUCKETS] == 0] = 0.0  # never seen in training: says nothing
    return ratio, n_good, n_bad


def _descend(rows: list[np.ndarray], ratio: np.ndarray, norm: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the bias is one more constant feature."""
    weight, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([(ratio[x] @ ratio[x]) / (n * n) + 1.0 for x, n in zip(rows, norm)])
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            scaled = ratio[rows[i]] / norm[i]
            slack = y[i] * (weight[rows[i]] @ scaled + bias) - 1.0
            step = min(max(alpha[i] - slack / square[i], 0.0), COST) - alpha[i]
            if step:
                alpha[i] += step
                weight[rows[i]] += step * y[i] * scaled
                bias += step * y[i]
    return weight, bias


def _calibrate(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, by Newton steps
    with a small ridge."""
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        g = np.array([(margin * (p - good)).sum() + 1e-2 * slope, (p - good).sum() + 1e-2 * offset])
        v = p * (1 - p)
        h = np.array([[(margin * margin * v).sum() + 1e-2, (margin * v).sum()], [(margin * v).sum(), v.sum() + 1e-2]])
        move = np.linalg.solve(h, g)
        slope, offset = slope - move[0], offset - move[1]
        if abs(move).max() < 1e-8:
            break
    return float(max(slope, 1e-3)), float(offset)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    ship_package(docs.sparkSession)
    rows = _training_rows(docs, labels)
    ratio, n_good, n_bad = log_count_ratios(rows)
    if not n_good or not n_bad:
        share = (n_good + 1) / (n_good + n_bad + 2)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share))))
    n = n_good + n_bad

    def extract(batches):
        for batch in batches:
            yield pd.DataFrame({"draw": batch["draw"], "good": batch["good"], "x": [features(t).tobytes() for t in batch["text"]]})

    draw = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1 << 30))
    sample = rows.withColumn("draw", draw).where(F.col("draw") < int((1 << 30) * min(1.0, 0.95 * SAMPLE_ROWS / n)))
    got = (sample.select("draw", "good", "text").mapInPandas(extract, "draw long, good int, x binary")
           .limit(SAMPLE_ROWS).toArrow().sort_by([("draw", "ascending"), ("x", "ascending")]))
    xs = [np.frombuffer(x.as_buffer(), np.int32) for x in got["x"]]
    norm = np.array([np.sqrt(max(1.0, float(ratio[x] @ ratio[x]))) for x in xs])
    good = got["good"].to_numpy()
    late = np.arange(len(xs)) % 5 == 4
    if len(set(good[~late])) < 2 or len(set(good[late])) < 2:
        late[:] = False  # too few rows of a class to keep any out
    at = np.flatnonzero(~late)
    weight, bias = _descend([xs[i] for i in at], ratio, norm[at], np.where(good[at] == 1, 1.0, -1.0))
    test = np.flatnonzero(late) if late.any() else at
    margin = np.array([weight[xs[i]] @ ratio[xs[i]] / norm[i] + bias for i in test])
    slope, offset = _calibrate(margin, good[test].astype(float))
    return Model(ratio, weight, bias, slope, offset)


def with_score(docs: DataFrame, model: Model, column: str) -> DataFrame:
    """``docs`` with the probability of being good as a new ``column``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series(m.probability(np.array([m.margin(t) for t in texts], float)))

    return docs.withColumn(column, score(text_of()))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    model = fit(docs, labels)
    return with_score(docs, model, "__llm_score").where(F.col("__llm_score") >= KEEP_AT).select(*docs.columns)
