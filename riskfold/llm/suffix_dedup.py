"""Operator 6: byte-level dedup of repeated substrings by a distributed merge sort of suffixes.

A byte is removed when a string of ``LENGTH`` (100) bytes that covers it also
starts earlier (smaller doc_id, or same document and earlier start).

Which suffixes are sorted.  Sorting a suffix for every byte would multiply the
input by the string length.  Two equal 100-byte strings have the same minimizer:
the leftmost of their 32-byte grams with the least hash, at the same place in
both.  So it is enough to sort the suffixes that start at minimizers (about one
byte in 35), and of those the ones whose 32-byte gram occurs twice (a duplicate
detection by hash).  This loses no repeat.  Each suffix carries the bytes that any
of its strings needs: up to 68 to the left, up to 100 to the right.

The merge sort.
* Tasks sort their suffixes into runs.  Within a run, suffixes with equal
  contexts are one from here on; all copies but the earliest are removed already.
* Runs are front-coded (length of the prefix shared with the one before, and the
  rest), cut at splitters, and exchanged.  Splitters are 32-byte strings from a
  bounded sample, so that equal grams meet in one range.
* Each range is merged with a loser tree that knows, for every run, how long a
  prefix it shares with the last output; games compare bytes only beyond it.
  The shared prefixes of neighbours come out of the merge.
* A string that begins d bytes left of its minimizer is a d-byte left context and
  a (100 - d)-byte prefix of the suffix: for each d, the intervals of shared
  prefixes and those of shared left contexts are intersected; all but the
  earliest in a cell are later copies.

A hot passage reaches a range once a run, whatever the number of its documents.

Defined results: null text is the empty text; texts shorter than 100 bytes keep
everything; a null doc_id sorts last; of rows that repeat a doc_id, different
texts are ordered by digest, and equal ones are copies of the first; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import pickle
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import prefix_sums, ship_package, stage, stage_folder

LENGTH = 100
GRAM = 32
SLOTS = LENGTH - GRAM + 1  # grams in a string
SAMPLE = 4096  # suffixes from which the splitters are taken
RUN_BYTES = 48 << 20
TEXT_CHUNK = 4 << 20  # window starts handled at a time

_BYTE = np.random.default_rng(61).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of all 32-byte grams, by doubling."""
    h, n = _BYTE[raw], 1
    while n < GRAM:
        h = (h[:-n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) ^ ((h[n:] << np.uint64(29)) | (h[n:] >> np.uint64(35)))
        h = h * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
        n *= 2
    return h


def minimizers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the minimizer of the string at each start, hashes of all grams)."""
    if len(raw) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes, starts, out = gram_hashes(raw), len(raw) - LENGTH + 1, []
    for at in range(0, starts, TEXT_CHUNK):
        part = hashes[at:min(at + TEXT_CHUNK, starts) + SLOTS - 1]
        # hash first, place second: the leftmost of the least
        low = ((part >> np.uint64(24)) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        n = 1
        while 2 * n <= SLOTS:
            low, n = np.minimum(low[:-n], low[n:]), 2 * n
        low = np.minimum(low[:len(low) - (SLOTS - n)], low[SLOTS - n:])
        out.append((low & np.uint64((1 << 24) - 1)).astype(np.int64) + at)
    return np.concatenate(out), hashes


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    m = min(len(a), len(b))
    x = int.from_bytes(a[known:m], "big") ^ int.from_bytes(b[known:m], "big")
    return m if not x else m - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Shared prefix lengths of a sorted list, and the rests in a row."""
    shared = np.zeros(len(strings), np.uint16)
    for k in range(1, len(strings)):
        shared[k] = _common(strings[k - 1], strings[k], 0)
    return shared, b"".join([s[n:] for s, n in zip(strings, shared.tolist())])


class Run:
    """A front-coded sorted run: decodes one string after the other."""

    def __init__(self, blob: bytes):
        import zstandard
        (self.shared, self.sizes, self.rests, self.left_sizes, lefts, self.nearest, self.begin, self.place) = pickle.loads(
            zstandard.ZstdDecompressor().decompress(blob))
        ends = np.cumsum(self.left_sizes)
        self.lefts = [lefts[a:b] for a, b in zip((ends - self.left_sizes).tolist(), ends.tolist())]

    @staticmethod
    def pack(rows: list[tuple]) -> bytes:
        """rows: sorted (suffix, left, nearest d, begin, place)."""
        import zstandard
        shared, rests = front_code([r[0] for r in rows])
        return zstandard.ZstdCompressor(level=3).compress(pickle.dumps((
            shared, np.array([len(r[0]) for r in rows], np.uint16), rests, np.array([len(r[1]) for r in rows], np.int64),
            b"".join([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64),
            np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64))))

    def strings(self):
        last, at = b"", 0
        for shared, size in zip(self.shared.tolist(), self.sizes.tolist()):
            last = last[:shared] + self.rests[at:at + size - shared]
            at += size - shared
            yield last, shared


def merge_runs(runs: list) -> tuple[list[tuple[int, int]], list[bytes], list[int]]:
    """Merge sorted runs, iterators of (string, prefix shared with the one before).

    Returns (run, number in the run), the strings, and the prefix each shares
    with the one before it in the merged order.

    A loser tree: every inner node keeps the loser of its game and the prefix the
    loser shares with the winner.  Against a new contender, whose prefix shared
    with the last output is known, the longer prefix wins outright; only equal
    ones are compared, from there on."""
    k = 1
    while k < len(runs):
        k *= 2
    done = None
    heads: list = [next(r, None) for r in runs] + [done] * (k - len(runs))
    taken = [0] * k
    string = [h[0] if h else None for h in heads]
    lose, lose_shared = [0] * k, [0] * k

    def game(a: int, shared_a: int, b: int, shared_b: int):
        """Winner and its prefix, loser and its prefix; ended runs lose."""
        if string[a] is None or string[b] is None:
            return (b, shared_b, a, shared_a) if string[a] is None else (a, shared_a, b, shared_b)
        if shared_a != shared_b:
            return (a, shared_a, b, shared_b) if shared_a > shared_b else (b, shared_b, a, shared_a)
        x, y = string[a], string[b]
        n = _common(x, y, shared_a)
        first = n == len(x) and (n < len(y) or a < b) or (n < len(x) and n < len(y) and x[n] < y[n])
        return (a, shared_a, b, n) if first else (b, shared_a, a, n)

    def play(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, 0
        (a, sa), (b, sb) = play(2 * node), play(2 * node + 1)
        winner, shared, lose[node], lose_shared[node] = game(a, sa, b, sb)
        return winner, shared

    order, strings, prefixes = [], [], []
    winner, shared = play(1) if k > 1 else (0, 0)
    while string[winner] is not None:
        order.append((winner, taken[winner]))
        strings.append(string[winner])
        prefixes.append(shared)
        taken[winner] += 1
        head = next(runs[winner], None)
        string[winner], shared = head if head else (None, 0)
        node = (winner + k) // 2
        while node:
            winner, shared, lose[node], lose_shared[node] = game(winner, shared, lose[node], lose_shared[node])
            node //= 2
    return order, strings, prefixes


def later_starts(prefixes: np.ndarray, lefts: list[bytes], nearest: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For suffixes in sorted order: a matrix (suffix, d) that is true where the
    string that begins d bytes to the left has an earlier copy.

    ``prefixes``: shared with the suffix before; d runs from ``nearest`` to the
    length of the left context."""
    n = len(place)
    flipped = [x[::-1] for x in lefts]
    by_left = sorted(range(n), key=flipped.__getitem__)
    left_shared = np.zeros(n, np.int64)
    for k in range(1, n):
        left_shared[k] = _common(flipped[by_left[k - 1]], flipped[by_left[k]], 0)
    by_left_at = np.array(by_left, np.int64)
    reach = np.array([len(x) for x in lefts], np.int64)
    by_place = np.argsort(place, kind="stable")
    later = np.zeros((n, SLOTS), bool)
    left_id = np.empty(n, np.int64)
    for d in range(SLOTS):
        right_id = np.cumsum(prefixes < LENGTH - d)
        left_id[by_left_at] = np.cumsum(left_shared < d)
        able = by_place[(nearest[by_place] <= d) & (reach[by_place] >= d)]
        if len(able) < 2:
            continue
        cell = right_id[able] * n + left_id[able]
        grouped = np.argsort(cell, kind="stable")  # the earliest place stays first in its cell
        same = cell[grouped][1:] == cell[grouped][:-1]
        later[able[grouped[1:][same]], d] = True
    return later


def spans_of(later: np.ndarray, begin: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """(begin, start, stop) of the removed bytes, offsets in the document."""
    padded = np.zeros((later.shape[0], SLOTS + 2), np.int8)
    padded[:, 1:-1] = later
    change = np.diff(padded, axis=1)
    who, first = np.nonzero(change == 1)
    _, stop = np.nonzero(change == -1)
    at = place[who] - begin[who]
    return pd.DataFrame({"begin": begin[who], "start": at - (stop - 1), "stop": at - first + LENGTH})


def _texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (doc_id, text) as a table bucketed by their place in the order of
    all bytes, so that later joins do not move the texts again; and its keys."""
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"))
    digest = F.unhex(F.sha2("raw", 256))
    keys = rows.select("doc_id", digest.alias("digest"), F.octet_length("raw").cast("long").alias("n_bytes"))
    keys = stage(keys.groupBy("doc_id", "digest", "n_bytes").agg(F.count(F.lit(1)).alias("copies"))
                 .withColumn("no_id", F.col("doc_id").isNull()), "text-keys")
    # the place of a text: the bytes before it; empty texts take one so that places are distinct
    keys = keys.withColumn("width", F.greatest("n_bytes", F.lit(1).cast("long")))
    placed = stage(prefix_sums(keys, None, ["no_id", "doc_id", "digest"], "width")
                   .withColumnRenamed("__llm_before", "begin").select("doc_id", "digest", "begin", "copies", "n_bytes"), "begins")
    long_enough = placed.where(F.col("n_bytes") >= LENGTH).select(
        F.col("doc_id").alias("key_id"), F.col("digest").alias("key_digest"), "begin")
    found = (rows.withColumn("digest", digest)
             .join(long_enough, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("digest") == F.col("key_digest")))
             .groupBy("begin").agg(F.any_value("raw").alias("raw")))
    name, parts = f"llm_texts_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    (found.write.bucketBy(parts, "begin").sortBy("begin").option("compression", "zstd").format("parquet")
     .option("path", f"{stage_folder(spark)}/{name}").saveAsTable(name))
    return spark.table(name), placed


def _anchors(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            gram, begin, offset = [], [], []
            for at, raw in zip(batch["begin"], batch["raw"]):
                places, hashes = minimizers(np.frombuffer(raw, np.uint8))
                places = places[np.flatnonzero(np.diff(places, prepend=-1))]  # they never go back
                gram.append(hashes[places].view(np.int64))
                begin.append(np.full(len(places), at, np.int64))
                offset.append(places.astype(np.int32))
            if gram:
                yield pd.DataFrame({"gram": np.concatenate(gram), "begin": np.concatenate(begin),
                                    "offset": np.concatenate(offset)})

    return texts.select("begin", "raw").mapInPandas(run, "gram long, begin long, offset int")


def _contexts(raw: bytes, begin: int, wanted: np.ndarray):
    """(suffix, left, nearest d, begin, place) of the wanted minimizers of a text."""
    places, _ = minimizers(np.frombuffer(raw, np.uint8))
    first = np.flatnonzero(np.diff(places, prepend=-1))
    last = np.append(first[1:], len(places)) - 1
    at = places[first]
    for p, lo, hi in zip(at.tolist(), first.tolist(), last.tolist()):
        if p in wanted:
            yield raw[p:hi + LENGTH], raw[lo:p], p - hi, begin, begin + p


def _sorted_runs(with_offsets: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Rows (part, blob, spans): front-coded run pieces, and the spans that runs
    find removed themselves (part is null)."""
    def emit(rows):
        rows.sort(key=lambda r: (r[0], r[1], r[4]))
        kept, spans = [], []
        for r in rows:
            if kept and kept[-1][0] == r[0] and kept[-1][1] == r[1] and kept[-1][2] == r[2]:
                at = r[4] - r[3]
                spans.append((r[3], at - len(r[1]), at - r[2] + LENGTH))
            else:
                kept.append(r)
        cuts = [0, *[bisect.bisect_left(kept, s, key=lambda r: r[0][:GRAM]) for s in splitters], len(kept)]
        pieces = [(k, Run.pack(kept[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        yield pd.DataFrame({"part": [k for k, _ in pieces], "blob": [b for _, b in pieces], "begin": -1, "start": 0, "stop": 0})
        if spans:
            s = np.array(spans)
            yield pd.DataFrame({"part": -1, "blob": None, "begin": s[:, 0], "start": s[:, 1], "stop": s[:, 2]})

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for begin, raw, offsets in zip(batch["begin"], batch["raw"], batch["offsets"]):
                for r in _contexts(raw, int(begin), set(np.asarray(offsets).tolist())):
                    rows.append(r)
                    size += len(r[0]) + len(r[1]) + 200
                    if size > RUN_BYTES:
                        yield from emit(rows)
                        rows, size = [], 0
        if rows:
            yield from emit(rows)

    return with_offsets.mapInPandas(run, "part int, blob binary, begin long, start int, stop int")


def _merged_spans(pieces: DataFrame) -> DataFrame:
    def merge(batch: pd.DataFrame) -> pd.DataFrame:
        runs = [Run(b) for b in batch["blob"]]
        order, strings, prefixes = merge_runs([r.strings() for r in runs])
        del strings
        pick = lambda name: np.array([getattr(runs[r], name)[k] for r, k in order], np.int64)
        begin, place = pick("begin"), pick("place")
        later = later_starts(np.array(prefixes, np.int64), [runs[r].lefts[k] for r, k in order], pick("nearest"), place)
        return spans_of(later, begin, place)

    return pieces.groupBy("part").applyInPandas(merge, "begin long, start int, stop int")


def _splitters(with_offsets: DataFrame, parts: int) -> list[bytes]:
    """At most ``parts - 1`` strings that cut a sample of the suffixes evenly."""
    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"gram": [raw[o:o + GRAM] for raw, offsets in zip(batch["raw"], batch["offsets"]) for o in offsets]})

    n = with_offsets.select(F.sum(F.size("offsets"))).first()[0] or 0
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = with_offsets.select("raw", F.filter("offsets", lambda o: F.pmod(F.xxhash64("begin", o), F.lit(1 << 20))
                                                < int(share * (1 << 20)) + 1).alias("offsets")).where(F.size("offsets") > 0)
    grams = sorted(r["gram"] for r in drawn.mapInPandas(run, "gram binary").limit(2 * SAMPLE).collect())
    return sorted({bytes(grams[len(grams) * k // parts]) for k in range(1, parts)}) if grams else []


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, placed, spans): ``spans`` (begin, start, stop) may overlap."""
    from pyspark.sql import Window

    ship_package(docs.sparkSession)
    texts, placed = _texts(docs)
    twice = (_anchors(texts).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("gram")))
             .where("n > 1").groupBy("begin").agg(F.collect_list("offset").alias("offsets")))
    with_offsets = texts.join(stage(twice, "repeated-grams"), "begin").select("begin", "raw", "offsets")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = stage(_sorted_runs(with_offsets, _splitters(with_offsets, parts)), "runs")
    merged = _merged_spans(runs.where("part >= 0").select("part", "blob"))
    return texts, placed, merged.unionByName(runs.where("part = -1").select("begin", "start", "stop"))


def union_spans(starts, stops) -> list[tuple[int, int]]:
    """Maximal spans covered."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, stops)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def drop_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row."""
    texts, placed, spans = repeated_spans(docs)
    per_text = spans.groupBy("begin").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def run(batches):
        for batch in batches:
            out = []
            for begin, raw, found in zip(batch["begin"], batch["raw"], batch["spans"]):
                cuts = union_spans([s["start"] for s in found], [s["stop"] for s in found]) if found is not None else []
                kept, at = [], 0
                for a, b in cuts:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                out.append((begin, len(raw) - len(left), len(cuts), hashlib.sha256(left).hexdigest(), left if with_text else None))
            yield pd.DataFrame(out, columns=["begin", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = (texts.join(per_text, "begin", "left").select("begin", "raw", "spans")
            .mapInPandas(run, "begin long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
    nothing = hashlib.sha256(b"").hexdigest()
    # texts too short to hold a string stay whole: their digest is known already
    every = placed.join(done, "begin", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    again = (F.col("copy") > 1) & (F.col("n_bytes") >= LENGTH)
    columns = [
        "doc_id", "n_bytes",
        F.when(again, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(again, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(again, nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256")]
    if with_text:
        columns.append(F.when(again, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return every.select(*columns)
