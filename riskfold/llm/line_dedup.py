"""Operator 1: line dedup by a suffix array over line ids (DataFrame functions only).

A document is its sequence of lines (split at \\n) that have a non-white
character; blank lines take no part and always stay.  All sequences are laid out
one after another in the order of doc_id (null last, then input order), so that
every line has a global place, and "earlier" means a smaller place.

1. Lines become ids: their rank in the order of their 128-bit digests.
2. Prefix doubling: the rank of the suffix at a place by its first h lines, and
   the rank h places on, are a pair; ranking the pairs ranks it by 2h lines.
   Ranks are sums of counts before a pair: distinct pairs are counted with
   map-side combine, range-partitioned, and summed range by range.  Suffixes
   whose rank is their own are final and leave the rounds; so are suffixes that
   have reached the end of their document.
3. A rank shared by several suffixes after a round is an interval of the suffix
   array with a longest common prefix of at least h lines.  All its members but
   the earliest begin a later copy of h lines.
4. A line is deleted when it lies in a run of at least ``min_lines`` lines that
   also begins earlier; overlapping copies count.  Neighbouring deleted lines
   make up a maximal run.

Defined results: null or empty text has no lines and stays empty; documents that
repeat an id are documents of their own, the later rows copies of the earlier;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import WORD_CLASS, join_groups, prefix_sums, stage, text_of

MIN_LINES = 2


def _lines(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (row, begin, n_lines) and lines (row, line, end, place, digest); ``line``
    is the place among all lines of the text, ``end`` that after the last line."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("said")))
    solid = F.filter(numbered, lambda x: x["said"].rlike(WORD_CLASS))
    digests = F.transform(solid, lambda x: F.struct(x["line"].alias("line"), F.unhex(F.md5(x["said"])).alias("digest")))
    docs = stage(texts.select("row", "doc_id", digests.alias("lines")), "line-digests")
    sizes = docs.select("row", "doc_id", F.size("lines").cast("long").alias("n_lines"))
    order = sizes.select("row", "n_lines", F.col("doc_id").isNull().alias("no_id"), "doc_id")
    begins = prefix_sums(order, None, ["no_id", "doc_id", "row"], "n_lines").select(
        "row", F.col("__llm_before").alias("begin"), "n_lines")
    begins = stage(begins, "begins")
    lines = (docs.select("row", F.posexplode("lines").alias("nth", "at")).join(begins, "row")
             .select("row", F.col("at.line").alias("line"), (F.col("begin") + F.col("n_lines")).alias("end"),
                     (F.col("begin") + F.col("nth")).alias("place"), F.col("at.digest").alias("digest")))
    return begins, stage(lines, "lines")


def _first_ranks(lines: DataFrame, total: int) -> DataFrame:
    """(place, end, rank, n): ranks by one line; n suffixes share the rank."""
    ids = lines.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    ids = stage(prefix_sums(ids, None, ["digest"], "n").withColumnRenamed("__llm_before", "rank"), "line-ids")
    return join_groups(lines.select("place", "end", "digest"), ids, "digest", "n", total).select("place", "end", "rank", "n")


def suffix_array(lines: DataFrame, total: int) -> tuple[DataFrame, dict[int, DataFrame]]:
    """The suffix array and its intervals: (place, rank), where suffixes equal to
    the end share a rank, and for each h of 1, 2, 4, ... the suffixes (place, end,
    rank, n) whose rank by h lines is shared."""
    ranked = stage(_first_ranks(lines, total), "ranks")
    final, live, intervals, h = ranked.where("n = 1").select("place", "rank"), ranked.where("n > 1"), {}, 1
    while not live.isEmpty():
        intervals[h] = live
        ranks = final.unionByName(live.select("place", "rank"))
        pairs = (live.withColumn("next", F.when(F.col("place") + h < F.col("end"), F.col("place") + h))
                 .join(ranks.select(F.col("place").alias("next"), F.col("rank").alias("then")), "next", "left")
                 .select("place", "end", F.struct("rank", F.coalesce("then", F.lit(-1)).alias("then")).alias("pair")))
        pairs = stage(pairs, "pairs")
        kinds = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).select("pair", "n", "pair.rank", "pair.then")
        kinds = prefix_sums(kinds, "rank", ["then"], "n").select(
            "pair", "n", (F.col("rank") + F.col("__llm_before")).alias("rank"))
        ranked = stage(join_groups(pairs, stage(kinds, "kinds"), "pair", "n", total), "ranks")
        closed = (F.col("n") == 1) | (F.col("pair.then") == -1)
        final = final.unionByName(ranked.where(closed).select("place", "rank"))
        live, h = ranked.where(~closed).select("place", "end", "rank", "n"), 2 * h
    return final, intervals


def later_copies(intervals: dict[int, DataFrame], depth: int, total: int) -> DataFrame | None:
    """(place, source) of the suffixes that share ``depth`` lines with an earlier
    one, and the earliest such; None where no interval is that deep.

    For a depth between two powers of two, the prefix is two overlapping halves."""
    h = 1 << (depth.bit_length() - 1)
    if h not in intervals:
        return None
    members = intervals[h].where(F.col("place") + depth <= F.col("end"))
    if h == depth:
        members = members.select("place", F.struct("rank").alias("key"))
    else:
        halves = intervals[h].select((F.col("place") - (depth - h)).alias("place"), F.col("rank").alias("then"))
        members = members.join(halves, "place").select("place", F.struct("rank", "then").alias("key"))
    first = members.groupBy("key").agg(F.min("place").alias("source"), F.count(F.lit(1)).alias("n_members"))
    first = stage(first.where("n_members > 1"), "first-copies")
    return join_groups(members, first, "key", "n_members", total).where("place > source").select("place", "source")


def drop_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, n_runs) for every row: the text without
    the lines of later copies, the number of its lines with a character, of those
    deleted, and of maximal deleted runs."""
    texts = stage(docs.select("doc_id", text_of().alias("text"))
                  .withColumn("row", F.monotonically_increasing_id()), "texts", "zstd")
    sizes, lines = _lines(texts)
    total = lines.count()
    _, intervals = suffix_array(lines, total)
    copies = later_copies(intervals, min_lines, total)
    if copies is None:
        copies = lines.select("place").limit(0)
    covered = copies.select(F.explode(F.sequence("place", F.col("place") + (min_lines - 1))).alias("place")).distinct()
    gone = stage(lines.join(covered, "place").select("row", "line", "place"), "deleted-lines")
    before = gone.select("row", (F.col("place") + 1).alias("place"), F.lit(True).alias("joins"))
    runs = gone.join(before, ["row", "place"], "left")
    per_doc = runs.groupBy("row").agg(
        F.sort_array(F.collect_list("line")).alias("gone"),
        F.sum(F.when(F.col("joins"), 0).otherwise(1)).alias("n_runs"))
    all_docs = texts.join(sizes.select("row", "n_lines"), "row").join(per_doc, "row", "left")
    # one flag a line, built from the gaps between deleted lines: linear in the text
    gone_at, said = F.col("gone"), F.split("text", "\n")
    earlier = F.concat(F.array(F.lit(-1)), gone_at)
    gaps = F.transform(F.arrays_zip(gone_at.alias("at"), F.slice(earlier, F.lit(1), F.size(gone_at)).alias("last")),
                       lambda x: F.concat(F.array_repeat(F.lit(False), x["at"] - x["last"] - 1), F.array(F.lit(True))))
    marked = F.arrays_zip(said.alias("said"), F.flatten(gaps).alias("gone"))
    left = F.transform(F.filter(marked, lambda x: ~F.coalesce(x["gone"], F.lit(False))), lambda x: x["said"])
    return all_docs.select(
        "doc_id", F.when(gone_at.isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"), "n_lines",
        F.coalesce(F.size(gone_at).cast("long"), F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_runs", F.lit(0).cast("long")).alias("n_runs"))
