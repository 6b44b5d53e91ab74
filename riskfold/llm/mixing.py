"""Operator 5: mixing sources to target weights.

1. Sizes (words per document) are staged once as narrow rows.
2. Per source: total size, and its target by water filling -- sources weigh 5,
   2, 1, repeating in code-point order (null last), share ``BUDGET`` times all
   sizes, and stop at ``CAP`` times their own size, the excess being reshared by
   weight among the others.
3. Every document gets a keyed hash; rows are range-partitioned by (source,
   hash, doc_id), so that a hot source spreads over many partitions; sizes are
   summed before each row: inside its range partition by a window, plus the
   totals of the partitions before it.
4. A source with target t and size s is taken ``t div s`` times whole, and then
   in hash order up to its exact remaining budget; the document on the cut is
   taken in part.

Defined results: null text has size 0; sources without words have target 0 and
nothing taken; repeated rows are rows of their own (equal rows are interchangeable
in the order); equal seeds give equal mixes; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfold.llm.common import WHITE_CLASS, WORD_CLASS, prefix_sums, stage, text_of, word_count

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2
SEED = 17


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source.

    With the sources in the order of size / weight, those that reach their cap
    are a prefix; the rest share what is left in proportion to their weights.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    per = per.select("source", "source_size",
                     F.get(weights, ((F.row_number().over(by_name) - 1) % len(WEIGHTS))).alias("w"))
    order = [(F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    budget = F.lit(BUDGET) * F.sum("source_size").over(everything)
    # the level if every earlier source were capped and none from here on
    level = (budget - F.lit(CAP) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(onward)
    capped = F.lit(CAP) * F.col("source_size") <= level * F.col("w")
    marked = per.select("*", level.alias("level"), capped.alias("capped"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("w"), "level"))).over(everything)
    return marked.select("source", "source_size", "w", final["level"].alias("final")).select(
        "source", "source_size",
        F.least(F.lit(float(CAP)) * F.col("source_size"),
                F.coalesce(F.col("final") * F.col("w"), F.lit(float(CAP)) * F.col("source_size"))).alias("target"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, __llm_size, source_size, target, __llm_taken) for every row of ``docs``."""
    sized = stage(_sized(docs, seed), "sizes")
    targets = stage(source_targets(sized.select("source", F.col("__llm_size").alias("size"))), "targets")
    targets = targets.withColumnsRenamed({"source": "__llm_source", "source_size": "__llm_source_size", "target": "__llm_target"})
    placed = prefix_sums(sized, "source", ["__llm_key", "doc_id"], "__llm_size")
    both = placed.join(targets, F.col("source").eqNullSafe(F.col("__llm_source")))
    size = F.col("__llm_size")
    taken = _epochs() * size + F.least(F.greatest(_rest() - F.col("__llm_before"), F.lit(0)), size)
    return both.select("doc_id", "source", size.alias("__llm_size"), F.col("__llm_source_size").alias("source_size"),
                       F.col("__llm_target").alias("target"), taken.cast("long").alias("__llm_taken"))


def _cuts(docs: DataFrame, seed: int) -> DataFrame:
    """(__llm_source, __llm_source_size, __llm_target, __llm_epochs, __llm_cut, __llm_given) per
    source: every document is taken whole ``epochs`` times, and once more where its (__llm_key,
    doc_id) is before ``cut``, which gives ``given`` words; the rows at the cut itself share what
    is left.  Only keys and sizes are sorted, no text."""
    sized = stage(_sized(docs, seed), "sizes")
    targets = stage(source_targets(sized.select("source", F.col("__llm_size").alias("size"))), "targets")
    targets = targets.select(F.col("source").alias("__llm_source"), F.col("source_size").alias("__llm_source_size"),
                             F.col("target").alias("__llm_target"))
    placed = prefix_sums(sized, "source", ["__llm_key", "doc_id"], "__llm_size")
    beyond = (placed.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("__llm_source")))  # one row a source
              .where(F.col("__llm_before") + F.col("__llm_size") > _rest())
              .groupBy(F.col("source").alias("__llm_s")).agg(F.min(F.struct("__llm_key", "doc_id")).alias("__llm_at")))
    cuts = (targets.join(beyond, F.col("__llm_source").eqNullSafe(F.col("__llm_s")), "left")
            .select("__llm_source", "__llm_source_size", "__llm_target", _epochs().alias("__llm_epochs"),
                    F.when(F.col("__llm_at").isNotNull(), F.struct("__llm_at.__llm_key", "__llm_at.doc_id")).alias("__llm_cut")))
    cuts = stage(cuts, "cuts")
    before = F.struct("__llm_key", "doc_id") < F.col("__llm_cut")
    given = (sized.join(F.broadcast(cuts), F.col("source").eqNullSafe(F.col("__llm_source"))).where(before)
             .groupBy(F.col("source").alias("__llm_s")).agg(F.sum("__llm_size").alias("__llm_given")))
    return stage(cuts.join(given, F.col("__llm_source").eqNullSafe(F.col("__llm_s")), "left")
                 .withColumn("__llm_given", F.coalesce("__llm_given", F.lit(0))).drop("__llm_s"), "given")


def _sized(docs: DataFrame, seed: int, carry: tuple[str, ...] = ()) -> DataFrame:
    text = text_of()
    return docs.select("doc_id", "source", *[c for c in carry if c not in ("doc_id", "source")],
                       word_count(text).cast("long").alias("__llm_size"),
                       F.xxhash64(F.lit(seed), "doc_id", F.xxhash64(text)).alias("__llm_key"))


def _epochs():
    return F.when(F.col("__llm_source_size") > 0,
                  F.expr("cast(floor(__llm_target) as bigint) div __llm_source_size")).otherwise(F.lit(0).cast("long"))


def _rest():
    """Words of a source that are taken beyond its whole epochs."""
    return F.floor("__llm_target").cast("long") - _epochs() * F.col("__llm_source_size")


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row per repetition; the
    document on the cut keeps as many of its first words as the budget has left.
    ``n_chars``, where there is one, follows the text.  What a row gives follows from its
    source's cut, so texts stay where they are; only the rows at a cut (one document a
    source, and rows that repeat it) are sorted whole."""
    cuts = F.broadcast(_cuts(docs, seed))  # one row a source
    known = _sized(docs, seed, tuple(docs.columns)).join(cuts, F.col("source").eqNullSafe(F.col("__llm_source")))
    here = F.struct("__llm_key", "doc_id")
    size, epochs = F.col("__llm_size"), F.col("__llm_epochs")
    at_cut = F.coalesce(here.eqNullSafe(F.col("__llm_cut")), F.lit(False))
    taken = epochs * size + F.when(here < F.col("__llm_cut"), size).otherwise(F.lit(0))
    off = known.where(~at_cut).withColumn("__llm_taken", taken)
    on = prefix_sums(known.where(at_cut).drop("__llm_cut"), "source", ["__llm_key", "doc_id"], "__llm_size")
    more = _rest() - F.col("__llm_given") - F.col("__llm_before")
    on = on.withColumn("__llm_taken", epochs * size + F.least(F.greatest(more, F.lit(0)), size))
    names = [*docs.columns, "__llm_size", "__llm_taken"]
    rows = off.select(*names).unionByName(on.select(*names)).where("__llm_taken > 0")
    turns = F.sequence(F.lit(0).cast("long"), F.expr("(__llm_taken - 1) div __llm_size"))
    rows = rows.withColumn("__llm_turn", F.explode(turns))
    words = F.least(F.col("__llm_size"), F.col("__llm_taken") - F.col("__llm_turn") * F.col("__llm_size"))
    pieces = F.regexp_extract_all("text", F.lit(WHITE_CLASS + "*" + WORD_CLASS), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")
    rows = rows.withColumn("text", F.when(words == F.col("__llm_size"), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
