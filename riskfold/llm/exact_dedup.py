"""Operator 10: exact dedup by two-pass Bloom filtering (DataFrame functions only).

Texts are equal when they are identical after deleting ASCII white space.

Pass one turns every text into a 32-byte digest and sets ``HASHES`` bits per
digest in a blocked bit array; a second bit array keeps the bits that were set
more than once.  Pass two tests every digest against the second array.  Rows
with a bit that nobody else set cannot have a copy and pass straight through;
only the possibly repeated rows are shuffled by digest.

The bit array has ``BITS_PER_ROW`` bits a row, in blocks of 32768 bits, so the
share of false candidates is the same at every size.  Rows are tested as narrow facts
(digest, row number, length): the blocks are broadcast while their exact size is within
``BROADCAST_BYTES``; beyond it the facts are joined with them on the block number.

Texts are moved by ``drop_copies`` only, and only those of which a copy may exist: the
digests that passed both filters are counted, and those with two rows or more make a
filter of their own, as large as there are repeated texts, for the pass over the
documents.  Where that filter is larger than ``BROADCAST_BYTES`` the pass is made once
for each part of it, over the documents whose block lies in the part, so that a text
whose digest the filter does not hold is never in a shuffle, at any size.

Defined results: null text is the empty text (all empty texts are copies of
each other); of equal texts the row with the most code points stays, then the
smallest doc_id (null last), then the first row; every input row, repeated ids
included, gives one output row; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import WHITE_CHARS, join_groups, stage, text_of

BITS_PER_ROW = 16
BLOCK_BITS = 32768  # what one bitmap_construct_agg bitmap holds
BLOCK_BYTES = BLOCK_BITS // 8
BROADCAST_BYTES = 32 << 20


def digest_of(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.translate(text_of(text), WHITE_CHARS, ""), 256))


def _address(digest: Column, blocks: int) -> list[Column]:
    """Block number and the two bits inside the block."""
    bits = F.xxhash64(digest, F.lit(1))
    return [F.pmod(F.xxhash64(digest), F.lit(blocks)).alias("__llm_block"),
            bits.bitwiseAND(BLOCK_BITS - 1).cast("int").alias("__llm_bit1"),
            F.shiftrightunsigned(bits, 15).bitwiseAND(BLOCK_BITS - 1).cast("int").alias("__llm_bit2")]


def _is_set(bitmap: str, bit: str) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.shiftright(F.col(bit), 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.col(bit) % 8) == 1


def blocks_for(rows: int) -> int:
    return max(1, math.ceil(rows * BITS_PER_ROW / BLOCK_BITS))


def repeated_bits(digests: DataFrame, rows: int) -> DataFrame:
    """Pass one: the blocks of the bit array of bits set more than once."""
    block, bit1, bit2 = _address(F.col("__llm_sha"), blocks_for(rows))
    return (digests.select(block, F.explode(F.array(bit1, bit2)).alias("__llm_bit"))
            .groupBy("__llm_block", "__llm_bit").count().where("count > 1")
            .groupBy("__llm_block").agg(F.bitmap_construct_agg("__llm_bit").alias("__llm_bits")))


def all_bits(digests: DataFrame, rows: int) -> DataFrame:
    """The blocks of the bit array of all bits of ``digests``."""
    block, bit1, bit2 = _address(F.col("__llm_sha"), blocks_for(rows))
    return (digests.select(block, F.explode(F.array(bit1, bit2)).alias("__llm_bit")).distinct()
            .groupBy("__llm_block").agg(F.bitmap_construct_agg("__llm_bit").alias("__llm_bits")))


def _with_bits(rows_with_sha: DataFrame, bits: DataFrame, rows: int) -> DataFrame:
    """Adds ``__llm_maybe``: whether both bits are set in ``bits``."""
    tested = rows_with_sha.select("*", *_address(F.col("__llm_sha"), blocks_for(rows))).join(bits, "__llm_block", "left")
    maybe = F.col("__llm_bits").isNotNull() & _is_set("__llm_bits", "__llm_bit1") & _is_set("__llm_bits", "__llm_bit2")
    return tested.withColumn("__llm_maybe", maybe).drop("__llm_block", "__llm_bit1", "__llm_bit2", "__llm_bits")


def test_bits(facts: DataFrame, bits: DataFrame, rows: int) -> DataFrame:
    """Pass two, over narrow facts: adds ``__llm_maybe``, false only where no copy can exist."""
    small = blocks_for(rows) * BLOCK_BYTES <= BROADCAST_BYTES
    return _with_bits(facts, F.broadcast(bits) if small else bits, rows)


def _order() -> Column:
    """Greatest for the row that stays (bitwise not turns an order round without overflow)."""
    return F.struct(F.col("__llm_chars"), F.col("doc_id").isNotNull(), F.bitwise_not(F.col("doc_id")),
                    F.bitwise_not(F.col("__llm_row")))


def copy_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    facts = stage(docs.select("doc_id", F.monotonically_increasing_id().alias("__llm_row"),
                              F.length(text_of()).alias("__llm_chars"), digest_of().alias("__llm_sha")), "digests")
    total = facts.count()
    tested = stage(test_bits(facts, repeated_bits(facts, total), total), "tested")
    alone = tested.where("not __llm_maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "__llm_sha")
    maybe = tested.where("__llm_maybe")
    groups = stage(maybe.groupBy("__llm_sha").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max_by(F.struct(F.col("doc_id").alias("keep_id"), F.col("__llm_row").alias("keep_row")), _order())
        .alias("__llm_keep")).select("__llm_sha", "group_size", "__llm_keep.*"), "groups")
    rest = join_groups(maybe, groups, "__llm_sha", "group_size", total).select(
        "doc_id", "keep_id", "group_size", (F.col("__llm_row") == F.col("keep_row")).alias("kept"), "__llm_sha")
    return alone.unionByName(rest).select("doc_id", "keep_id", "group_size", "kept",
                                          F.lower(F.hex("__llm_sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  Only texts that may
    have a copy are shuffled, and of these one row a text leaves each map task."""
    with_sha = docs.withColumn("__llm_sha", digest_of())
    facts = stage(with_sha.select("__llm_sha"), "digests")
    total = facts.count()
    maybe = test_bits(facts, stage(repeated_bits(facts, total), "bits"), total).where("__llm_maybe")
    copied = stage(maybe.groupBy("__llm_sha").count().where("count > 1").select("__llm_sha"), "copied")
    n_copied = copied.count()
    bits = stage(all_bits(copied, n_copied), "copied-bits")
    blocks = blocks_for(n_copied)
    passes = -(-blocks // max(1, BROADCAST_BYTES // BLOCK_BYTES))

    def tested(k: int) -> DataFrame:
        part = F.col("__llm_block") % passes == k
        mine = with_sha.where(_address(F.col("__llm_sha"), blocks)[0] % passes == k) if passes > 1 else with_sha
        return _with_bits(mine, F.broadcast(bits.where(part)), n_copied)

    kept = None
    for k in range(passes):
        rows = tested(k)
        alone = rows.where("not __llm_maybe").select(*docs.columns)
        groups = (rows.where("__llm_maybe")
                  .withColumns({"__llm_row": F.monotonically_increasing_id(), "__llm_chars": F.length(text_of())})
                  .groupBy("__llm_sha").agg(F.max_by(F.struct(*docs.columns), _order()).alias("__llm_keep")))
        both = alone.unionByName(groups.select("__llm_keep.*"))
        kept = both if kept is None else kept.unionByName(both)
    return kept
