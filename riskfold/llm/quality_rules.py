"""Operator 3: quality rules by weak supervision (DataFrame functions only).

1. Base measures of every whole text are staged as narrow rows.
2. Each rule of ``RULES`` votes keep (1), drop (0) or abstains (null).
3. Vote patterns are counted: at most 3 ** len(RULES) rows at any input size.
4. Expectation-maximisation over the counted patterns estimates, per rule, the
   chances of its votes on good and on bad documents (its accuracy), and the
   share of good ones.  Each step is one small aggregate; only
   6 * len(RULES) + 2 sums reach the driver.
5. The posterior probability of being good, an expression over the votes, gives
   the verdict: kept when it is at least ``KEEP_AT`` and the base did not fail.

Words are runs of ``[^\\x20\\x09-\\x0D]``.  Repeated 3-word windows are found
inside the row: window hashes are sorted with their places, neighbours compared,
and the places covered are counted; nothing is exploded or shuffled.

Defined results: null or empty text has no words and fails the base (fewer than
``MIN_WORDS`` words); repeated rows each get their row; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import WHITE_CLASS, WORD_CLASS, stage, text_of

SYMBOLS = "#*$%&|<>"
MARKS = SYMBOLS + "A-Z!.?"  # all that is counted by character
MIN_WORDS = 50
KEEP_AT = 0.5
EM_STEPS = 25
EM_STOP = 1e-4
#: Start of the estimates, which also acts as PRIOR_VOTES documents of each kind:
#: share of good documents; chances of a drop and a keep vote on good and on bad ones.
START_GOOD, START_ON_GOOD, START_ON_BAD, PRIOR_VOTES = 0.8, (0.01, 0.9), (0.25, 0.1), 10.0


@dataclass(frozen=True)
class Rule:
    """Votes drop where ``value`` >= ``bad``, keep where it is <= ``good``, else
    abstains.  A rule without one of the bounds never casts that vote: a text
    without one defect may still have another."""

    name: str
    value: Callable[[], Column]
    good: float | None = None
    bad: float | None = None


def _share(part: str, whole: str) -> Callable[[], Column]:
    return lambda: F.col(part) / F.greatest(F.col(whole), F.lit(1))


SYMBOL_SHARE, REPEAT_SHARE = _share("n_symbols", "n_words"), _share("n_repeat_words", "n_words")
CAPITAL_SHARE = _share("n_capitals", "word_chars")
SHOUT_SHARE, BAR_SHARE = _share("n_shouts", "n_words"), _share("n_bars", "n_words")


def _line_share() -> Column:  # three more lines, so that one copy in a short text is no defect
    return F.col("n_dup_lines") / (F.col("n_lines") + 3)


def _worst_defect() -> Column:
    """The largest defect as a multiple of what plain prose may have."""
    return F.greatest(SYMBOL_SHARE() / 0.15, REPEAT_SHARE() / 0.3, _line_share() / 0.25, CAPITAL_SHARE() / 0.15,
                      SHOUT_SHARE() / 0.1)


def _sentence_words() -> Column:
    return F.col("n_words") / F.greatest(F.col("n_stops"), F.lit(1))


RULES = (
    Rule("symbols", SYMBOL_SHARE, bad=0.25),
    Rule("repeats", REPEAT_SHARE, bad=0.4),
    Rule("line_copies", _line_share, bad=0.3),
    Rule("capitals", CAPITAL_SHARE, bad=0.3),
    Rule("shouting", SHOUT_SHARE, bad=0.2),
    Rule("bars", BAR_SHARE, bad=0.2),
    Rule("plain", _worst_defect, good=1.0),
    Rule("sentences", _sentence_words, good=40.0, bad=150.0),
)


def _number(marks: Column, chars: str) -> Column:
    """How many of the characters ``chars`` there are in ``marks``."""
    return F.length(F.regexp_replace(marks, f"[^{chars}]+", "")).cast("long")


def base_measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the measures of every row, with ``base_failed``.

    Arrays that a later step looks at twice are columns of their own select, so
    that each is computed once."""
    text = text_of()
    one = docs.select(
        *keep, F.array_remove(F.split(text, WHITE_CLASS + "+"), "").alias("__llm_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS)).alias("__llm_lines"),
        F.regexp_replace(text, f"[^{MARKS}]+", "").alias("__llm_marks"))
    words, lines, marks = F.col("__llm_words"), F.col("__llm_lines"), F.col("__llm_marks")
    triples = F.transform(
        F.slice(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b"),
                             F.slice(words, 3, F.size(words)).alias("c")), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    two = one.select(
        *keep, F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _number(marks, SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        _number(marks, "A-Z").alias("n_capitals"), _number(marks, "!").alias("n_shouts"),
        _number(marks, "|").alias("n_bars"), _number(marks, ".?!").alias("n_stops"), triples.alias("__llm_triples"))
    measures = [c for c in two.columns if c != "__llm_triples"]
    h = F.col("__llm_triples")
    placed = F.when(F.size(F.array_distinct(h)) < F.size(h),
                    F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    three = two.select(*measures, placed.alias("__llm_sorted"))
    s = F.col("__llm_sorted")
    beside = F.arrays_zip(s.alias("s"), F.concat(F.array(F.lit(None).cast("long")), s["h"]).alias("p"),
                          F.slice(s["h"], 2, F.size(s)).alias("n"))
    found = F.filter(beside, lambda x: (x["s"]["h"] == x["p"]) | (x["s"]["h"] == x["n"]))
    four = three.select(*measures, F.sort_array(F.transform(found, lambda x: x["s"]["i"])).alias("__llm_at"))
    at = F.col("__llm_at")
    gaps = F.transform(F.arrays_zip(at.alias("a"), F.slice(at, 2, F.size(at)).alias("b")),
                       lambda x: F.least(F.lit(3), F.coalesce(x["b"] - x["a"], F.lit(3))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x), F.lit(0).cast("long"))
    five = four.select(*measures, covered.alias("n_repeat_words"))
    return five.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                           | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words")))


def votes(measures: DataFrame) -> DataFrame:
    """``measures`` with one column ``vote_<rule>`` per rule: 0 drop, 1 keep, 2 abstain."""
    def vote(rule: Rule) -> Column:
        drop = rule.value() >= rule.bad if rule.bad is not None else F.lit(False)
        keep = rule.value() <= rule.good if rule.good is not None else F.lit(False)
        return F.when(drop, 0).when(keep, 1).otherwise(2)
    return measures.withColumns({f"vote_{r.name}": vote(r) for r in RULES})


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and for each rule the chances of (drop, keep,
    abstain) on good and on bad documents."""

    good: float
    on_good: tuple[tuple[float, ...], ...]
    on_bad: tuple[tuple[float, ...], ...]

    def numbers(self) -> list[float]:
        return [self.good, *[x for rule in (*self.on_good, *self.on_bad) for x in rule]]

    def posterior(self) -> Column:
        """Probability of being good given the votes."""
        # array literals keep the generated code the same from step to step
        odds = F.get(F.lit([math.log(self.good / (1 - self.good))]), F.col(f"vote_{RULES[0].name}") * 0)
        for rule, g, b in zip(RULES, self.on_good, self.on_bad):
            odds = odds + F.get(F.lit([math.log(x / y) for x, y in zip(g, b)]), F.col(f"vote_{rule.name}"))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def start_model() -> LabelModel:
    """Before any data: a drop vote is rare on good documents, and each defect
    is one of several ways to be bad."""
    def chances(rule: Rule, drop: float, keep: float) -> tuple[float, ...]:
        drop, keep = (drop if rule.bad is not None else 1e-3), (keep if rule.good is not None else 1e-3)
        return drop, keep, 1 - drop - keep
    return LabelModel(START_GOOD, tuple(chances(r, *START_ON_GOOD) for r in RULES),
                      tuple(chances(r, *START_ON_BAD) for r in RULES))


def fit(voted: DataFrame) -> LabelModel:
    """Expectation-maximisation over the counted vote patterns of all rows."""
    names = [f"vote_{r.name}" for r in RULES]
    patterns = stage(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns")
    model = begin = start_model()
    q, n = F.col("q"), F.col("n")
    sums = [F.sum(n * q).alias("good"), F.sum(n).alias("all")]
    for name in names:
        for v in range(3):
            cast = F.when(F.col(name) == v, n)
            sums += [F.sum(cast * q).alias(f"{name}_g{v}"), F.sum(cast * (1 - q)).alias(f"{name}_b{v}")]
    for _ in range(EM_STEPS):
        row = patterns.withColumn("q", model.posterior()).agg(*sums).first()
        if not row["all"]:
            return model

        def chances(name: str, side: str, start: tuple[float, ...]) -> tuple[float, ...]:
            cast = [(row[f"{name}_{side}{v}"] or 0.0) + PRIOR_VOTES * s for v, s in enumerate(start)]
            return tuple(c / sum(cast) for c in cast)

        new = LabelModel((row["good"] + PRIOR_VOTES * START_GOOD) / (row["all"] + PRIOR_VOTES),
                         tuple(chances(x, "g", s) for x, s in zip(names, begin.on_good)),
                         tuple(chances(x, "b", s) for x, s in zip(names, begin.on_bad)))
        moved = max(abs(a - b) for a, b in zip(new.numbers(), model.numbers()))
        model = new
        if moved < EM_STOP:
            break
    return model


def score_quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, ``base_failed``, ``quality`` (posterior) and ``kept``."""
    voted = votes(stage(base_measures(docs), "measures"))
    model = fit(voted)
    return voted.withColumn("quality", model.posterior()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT))
