"""Operator 12: shards of near-equal size by histogram sort (DataFrame functions only).

Every row has a 128-bit sort key: the digest of its text, then a digest of its
doc_id and row number.  So equal texts lie together, and a group of copies of any
size can still be cut between its rows.

1. Narrow rows (key, size and what is carried) are staged once.
2. ``n_shards - 1`` splitters are sought, all at once.  A round counts, exactly and
   over all partitions, the bytes below evenly spaced candidate boundaries: the
   bins of the first ``FIRST_BITS`` bits of the key, later the bins of ``NEXT_BITS``
   more bits inside those bins that still hold a target.  A splitter is done when a
   boundary lies within ``TOLERANCE`` of a mean shard of its target, or when its
   bin holds one row.  Only bin counts reach the driver: at most 2 ** FIRST_BITS
   rows, or 2 ** NEXT_BITS for each splitter.
3. Each row's shard is the number of splitters at or below its key.  Rows of a
   shard are dealt into slices by ranges of the second half of the key, which are
   even by construction; counts of the slices give their first slots, and the one
   exchange by (shard, slice) sorts the rows and numbers them.

Boundaries are first sought between text digests; only where one digest alone holds
more than the tolerance does the search go on inside it.  So equal texts share a
shard unless their group is larger than that.

Defined results: null text is the empty text, of size 1; a null doc_id and repeated
rows are rows like others (a row number tells them apart); shards may be empty when
there are fewer rows than shards; an empty table gives an empty result.  Columns that
clash with the added ones give way to them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import stage, text_of

FIRST_BITS = 12
NEXT_BITS = 8
TOLERANCE = 0.005
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")

_SIGN = -(1 << 63)


def _prefix(bits: int) -> list[Column]:
    """The first ``bits`` bits of the key as one or two unsigned-order longs."""
    high, low = F.col("__llm_high"), F.col("__llm_low")
    if bits <= 64:
        return [F.shiftright(high, 64 - bits)]
    return [high, F.shiftright(low, 128 - bits)]


def _is_one_of(columns: list[Column], values: list[tuple[int, ...]]) -> Column:
    """Whether the columns equal one of ``values`` (one for each splitter at most)."""
    alike = [reduce(lambda a, b: a & b, [c == F.lit(x) for c, x in zip(columns, v)]) for v in values]
    return reduce(lambda a, b: a | b, alike)


def _child(prefix: tuple[int, ...], bits: int, k: int, step: int) -> tuple[int, ...]:
    """Bin ``k`` of the ``2 ** step`` into which ``prefix`` of ``bits`` bits is cut."""
    if bits < 64:
        return ((prefix[0] << step) + k,)
    if bits == 64:
        return (prefix[0], k - (1 << (step - 1)))  # shiftright keeps the sign of the low half
    return (prefix[0], (prefix[1] << step) + k)


def _boundary(prefix: tuple[int, ...], bits: int) -> tuple[int, int]:
    """The least key of a bin, as signed halves."""
    if bits <= 64:
        return prefix[0] << (64 - bits), _SIGN
    return prefix[0], prefix[1] << (128 - bits)


def find_splitters(rows: DataFrame, n_shards: int) -> list[tuple[int, int]]:
    """The least keys of shards 1 to ``n_shards - 1`` of staged ``rows``
    (__llm_high, __llm_low, size), in order."""
    def histogram(bits: int, within: list[tuple[int, ...]] | None, outer: int) -> dict:
        some = rows if within is None else rows.where(_is_one_of(_prefix(outer), within))
        names = [f"p{k}" for k in range(len(_prefix(bits)))]
        bins = some.groupBy(*[c.alias(n) for c, n in zip(_prefix(bits), names)]).agg(
            F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"))
        return {tuple(r[n] for n in names): (r["total"], r["n"]) for r in bins.collect()}

    bits = FIRST_BITS
    counts = histogram(bits, None, 0)
    total = sum(size for size, _ in counts.values())
    slack = TOLERANCE * total / n_shards
    first = [(k - (1 << (bits - 1)),) for k in range(1 << bits)]
    # splitter -> (bins to look in, in order, bytes below the first of them)
    search = {s: (first, 0) for s in range(1, n_shards)} if total else {}
    found: dict[int, tuple[int, int]] = {}
    while search:
        inside: dict[int, tuple[tuple[int, ...], int]] = {}
        for s, (bins, below) in search.items():
            target = total * s / n_shards
            for at in bins:
                size, n = counts.get(at, (0, 0))
                if below + size < target:
                    below += size
                    continue
                # the target lies in this bin: its lower edge, its upper edge, or between
                over = below + size - target
                step_up = over < target - below
                if min(over, target - below) <= slack or n <= 1 or bits == 128:
                    low, high = _boundary(at, bits)
                    if step_up:
                        low, high = _after(at, bits)
                    found[s] = (low, high)
                else:
                    inside[s] = (at, below)
                break
        step = min(NEXT_BITS, 64 - bits if bits < 64 else 128 - bits)
        if inside:
            counts = histogram(bits + step, sorted({at for at, _ in inside.values()}), bits)
        search = {s: ([_child(at, bits, k, step) for k in range(1 << step)], below) for s, (at, below) in inside.items()}
        bits += step
    return [found[s] for s in sorted(found)]


def _after(prefix: tuple[int, ...], bits: int) -> tuple[int, int]:
    """The least key above a bin; past the last key of all, a key that no row
    reaches is not needed, as the last key itself has one row at most."""
    high, low = _boundary(prefix, bits)
    key = ((high - _SIGN) << 64) + (low - _SIGN) + (1 << (128 - bits))
    key = min(key, (1 << 128) - 1)
    return (key >> 64) + _SIGN, (key & ((1 << 64) - 1)) + _SIGN


def shard_documents(docs: DataFrame, n_shards: int = 16, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default: all) of every row of ``docs`` (doc_id, text, ...)
    with size, text_crc32, law, shard, slot and grown_shard.

    Sizes are UTF-8 bytes plus one; the bytes of shards differ by about
    ``TOLERANCE`` of their mean, and by the largest row.  Slots count from 0 in the
    order of the second half of the key."""
    spark = docs.sparkSession
    text = text_of()
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ADDED]
    own = {c: f"__llm_c{k}" for k, c in enumerate(kept)}
    rows = stage(
        docs.withColumn("__llm_row", F.monotonically_increasing_id()).select(
            *[F.col(f"`{c}`").alias(n) for c, n in own.items()],
            (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("__llm_high"), F.xxhash64(F.lit(12), "doc_id", "__llm_row").alias("__llm_low")),
        "shard-rows")
    splitters = find_splitters(rows.select("__llm_high", "__llm_low", "size"), n_shards)

    high, low = F.col("__llm_high"), F.col("__llm_low")
    reached = [((high > F.lit(h)) | ((high == F.lit(h)) & (low >= F.lit(l)))).cast("int") for h, l in splitters]
    shard = reduce(lambda a, b: a + b, reached, F.lit(0))
    wanted = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_shards)
    bits = max(0, (wanted - 1).bit_length())  # 2 ** bits slices a shard
    piece = F.shiftright(low, 64 - bits) if bits else F.lit(0).cast("long")
    placed = rows.withColumns({"shard": shard.cast("int"), "__llm_slice": piece})
    return _numbered(placed, n_shards << bits).select(
        *[F.col(n).alias(c) for c, n in own.items()], "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("__llm_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _numbered(placed: DataFrame, slices: int) -> DataFrame:
    """Adds ``__llm_slot``, the row's gapless number inside its shard."""
    from pyspark.sql import Window

    key = ["shard", "__llm_slice"]
    counts = stage(placed.groupBy(*key).agg(F.count(F.lit(1)).alias("__llm_n")), "slices")  # one row a slice
    earlier = Window.partitionBy("shard").orderBy("__llm_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, F.coalesce(F.sum("__llm_n").over(earlier), F.lit(0)).alias("__llm_start"))
    inside = Window.partitionBy(*key).orderBy("__llm_low", "__llm_high")
    # one exchange for the rows; the starts are as few as the slices
    ranked = placed.repartition(slices, *key).withColumn("__llm_at", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(starts), key).withColumn("__llm_slot", (F.col("__llm_start") + F.col("__llm_at")).cast("long"))


def write_shards(docs: DataFrame, folder: str, n_shards: int = 16) -> None:
    """Write whole documents as ``folder``/shard=K/ in slot order of each slice."""
    shard_documents(docs, n_shards).write.partitionBy("shard").parquet(folder)
