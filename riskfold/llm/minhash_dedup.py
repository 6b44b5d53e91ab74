"""Operator 4: near-duplicate documents by MinHash banding.

1. One pass over the texts gives every document the size and a 128-bit
   fingerprint of its shingle set, and ``BANDS * ROWS`` minima of universal hash
   functions.  Documents with equal sets are one node from here on.
2. The minima are cut into bands; nodes that agree on a band share a bucket.
3. Candidates are verified by their signatures and then on the full sets, which
   are made anew from the texts.
4. Links become components by alternating large-star and small-star.

Buckets of any size are searched whole without emitting all their pairs, as
only components are wanted.  First every member is compared with one hub of its
bucket; what is linked then is one component and needs no more comparisons.
Where a bucket is still divided, the shingles that no other open document has are counted: a document with
too many of them can have no link at all and leaves.  The others are compared with
the ``HUBS`` members that have fewest such shingles, as copies of one text are all
close to the copies that were changed least.  Last come the pairs left, of members
in different components that share one of their rarest shingles, as all links do: a
document's shingles are put in the order of how many have them, and one that must
share o of its n shingles shares one of the first n - o + 1.  Nothing is cut off: a link between two nodes of a bucket is left out only when they are
connected already or cannot be similar enough.

The chance that two documents at the least similarity share no band is
(1 - 0.85 ** 4) ** 20 < 4e-7 at 0.85 and (1 - 0.8 ** 4) ** 20 < 2.7e-5 at 0.8.
The signature test asks for so many equal minima (``agree_at``) that such a pair
fails it with a chance below ``MISSED``: 50 of 80 at 0.85, 45 of 80 at 0.8.

Shingles are compared as 64-bit digests of lower-cased words.

Defined results: null, empty or wordless text has an empty set, is linked with
nothing and stays; a text with fewer words than a shingle has its whole word
sequence as its one shingle.  Rows are told apart by a staged row number, never
by doc_id, so that rows which repeat an id, or have none, are judged each on
their own: of a component the row stays that is first by (doc_id, row), nulls
last, and with it only its repeats, rows of the same id and text.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfold.llm.common import join_groups, ship_package, stage, text_of
from riskfold.llm.components import connected_components, joined_components

BANDS, ROWS = 20, 4
AGREE = 50  # never more equal minima than these are asked for
MISSED = 4e-7
HUBS = 4
MASK = (1 << 64) - 1

_RANDOM = np.random.default_rng(20240607)
_A = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """64-bit digests of the words, in order: A-Z in lower case, split at ASCII white space."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    solid = np.concatenate([[False], ~white, [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    letters = raw[~white].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()) - 1, _BASE)]), dtype=np.uint64)
    return _mix(np.add.reduceat(letters * powers[place], first) + lengths.astype(np.uint64))


def shingle_set(text: str, words: int) -> np.ndarray:
    """The sorted distinct digests of the shingles of ``words`` words."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(words, len(h))
    rolled = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        rolled = _mix(rolled * _BASE + h[k:len(h) - width + 1 + k])
    return np.unique(rolled)


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signature(shingles: np.ndarray) -> bytes:
    """The minima of all hash functions x -> the high half of a * x + b."""
    low = np.full(BANDS * ROWS, MASK, np.uint64)
    for at in range(0, len(shingles), 4096):  # bounds the memory of very long texts
        part = shingles[at:at + 4096]
        low = np.minimum(low, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32).tobytes()


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with the row number ``__llm_row``, frozen in a staged table."""
    return stage(docs.withColumn("__llm_row", F.monotonically_increasing_id()), "numbered", "zstd")


def agree_at(percent: int) -> int:
    """The most equal minima, ``AGREE`` at the highest, that a pair with a
    similarity of ``percent`` has but for a chance below ``MISSED``."""
    n, p, fewer = BANDS * ROWS, percent / 100, 0.0
    for k in range(AGREE):
        fewer += math.comb(n, k) * p ** k * (1 - p) ** (n - k)  # the chance of at most k
        if fewer >= MISSED:
            return k
    return AGREE


def _facts(rows: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            facts = []
            for text in batch.column(2):  # one text at a time: a batch of sets would be several times the texts
                said = text.as_py()
                shingles = shingle_set(said, words)
                facts.append((hashlib.blake2b(said.encode("utf-8", "surrogatepass"), digest_size=16).digest(),
                              len(shingles), fingerprint(shingles), signature(shingles)))
            digests, sizes, ids, minima = zip(*facts) if facts else ((), (), (), ())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                                   pa.array(ids, pa.binary()), pa.array(minima, pa.binary())],
                                  ["row", "doc_id", "digest", "n_shingles", "set_id", "minima"])

    texts = rows.select(F.col("__llm_row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(run, "row long, doc_id long, digest binary, n_shingles long, set_id binary, minima binary")


class _Verifier:
    """Tests candidate pairs (a, b) of nodes by signatures and on full sets."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, words: int, percent: int):
        self.rows, self.nodes, self.words, self.percent = rows, nodes, words, percent

    def _agreeing(self, pairs: DataFrame) -> DataFrame:
        agree = agree_at(self.percent)

        def run(batches):
            for batch in batches:
                left, right = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
                               for c in ("minima_a", "minima_b"))
                yield batch.select(["a", "b"]).filter(pa.array((left == right).sum(axis=1) >= agree))

        one = self.nodes.select(F.col("node").alias("a"), F.col("minima").alias("minima_a"))
        two = self.nodes.select(F.col("node").alias("b"), F.col("minima").alias("minima_b"))
        return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")

    def _shingles(self, wanted: DataFrame) -> DataFrame:
        """(node, shingle) for all shingles of every ``wanted`` (node)."""
        words = self.words

        def run(batches):
            for batch in batches:
                for node, text in zip(batch["node"].to_pylist(), batch["text"]):
                    shingles = shingle_set(text.as_py(), words).view(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(shingles), node)), pa.array(shingles)], ["node", "shingle"])

        return self.texts(wanted).mapInArrow(run, "node long, shingle long")

    def private_shingles(self, open_nodes: DataFrame) -> DataFrame:
        """(node, private): for each of ``open_nodes`` (node) the number of its
        shingles that no other of them has."""
        rows = self._shingles(open_nodes)
        alone = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
        counted = alone.groupBy("node").agg(F.count(F.lit(1)).alias("private"))
        return open_nodes.join(counted, "node", "left").select("node", F.coalesce("private", F.lit(0)).alias("private"))

    def sharing_rare_shingles(self, nodes: DataFrame) -> DataFrame:
        """(a, b): the pairs of ``nodes`` (node, label, size) with different labels that can be
        links.  Two sets that must share o shingles share one among the size - o + 1 rarest of
        each, in one order of all shingles by the number of nodes that have them."""
        rows = stage(self._shingles(nodes.select("node")), "shingles", "zstd")
        counts = stage(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "shingle-counts", "zstd")
        known = join_groups(rows, counts, "shingle", "n", max(1, rows.count()))
        place = Window.partitionBy("node").orderBy("n", "shingle")
        t = F.lit(self.percent)
        rare = (known.withColumn("place", F.row_number().over(place) - 1).where("n > 1").join(nodes, "node")
                .where(100 * F.col("place") <= (100 - t) * F.col("size")).select("shingle", "node", "label", "size", "place"))
        rare = stage(rare, "rare")
        one, two = (rare.select("shingle", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "label", "size", "place")]) for k in "xy")
        both = F.col("size_x") + F.col("size_y")
        # place <= size - o with o >= percent * both / (100 + percent)
        fits = [(100 + t) * F.col(f"place_{k}") <= (100 + t) * F.col(f"size_{k}") - t * both for k in "xy"]
        return (one.join(two, "shingle").where((F.col("node_x") < F.col("node_y")) & (F.col("label_x") != F.col("label_y")) & fits[0] & fits[1])
                .select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct())

    def texts(self, wanted: DataFrame) -> DataFrame:
        """(node, text): the text of the first row of every ``wanted`` (node)."""
        named = self.nodes.join(wanted, "node").select("node", F.col("first.row").alias("__llm_row"))
        return self.rows.select("__llm_row", text_of().alias("text")).join(named, "__llm_row").select("node", "text")

    def links(self, pairs: DataFrame) -> DataFrame:
        words, percent = self.words, self.percent

        def run(batches):
            last, set_a = None, None
            for batch in batches:
                keep = []
                for a, text_a, text_b in zip(batch["a"].to_pylist(), batch["text_a"], batch["text_b"]):
                    if a != last:
                        last, set_a = a, shingle_set(text_a.as_py(), words)
                    set_b = shingle_set(text_b.as_py(), words)
                    both = len(np.intersect1d(set_a, set_b, assume_unique=True))
                    keep.append(100 * both >= percent * (len(set_a) + len(set_b) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        agreeing = stage(self._agreeing(pairs), "agreeing")
        either = agreeing.select("a").unionByName(agreeing.select(F.col("b").alias("a"))).distinct()
        texts = stage(self.texts(either.withColumnRenamed("a", "node")), "texts", "zstd")
        one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return agreeing.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``: linked
    are documents with 100 * |intersection| >= percent * |union|, percent >= 80.  kept
    says whether doc_id is component_id, so of rows that share an id all or none."""
    judged = _judged(_numbered(docs.select("doc_id", "text")), words, percent).drop("row")
    return judged.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _judged(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, kept) for every one of the numbered ``rows``."""
    ship_package(rows.sparkSession)
    facts = stage(_facts(rows, words), "shingle-facts")
    total = facts.count()
    # struct order: rows with an id first, then by id and row
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "digest")
    nodes = stage(facts.where("n_shingles > 0").groupBy("set_id")
                  .agg(F.min(first).alias("first"), F.any_value("minima").alias("minima"),
                       F.max("n_shingles").alias("size"), F.count(F.lit(1)).alias("n_docs"))
                  .withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("minima", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)])
    bands = nodes.select("node", "size", F.explode(keys).alias("key"))
    buckets = stage(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("node", "size"), "node").alias("hub"))
                    .where("n > 1"), "buckets")
    members = stage(join_groups(bands, buckets, "key", "n", total * BANDS), "members")

    def enough(common: Column, size_a: Column, size_b: Column) -> Column:
        """Whether ``common`` shingles make two sets of these sizes similar enough."""
        return F.lit(100 + percent) * common >= F.lit(percent) * (size_a + size_b)

    def labelled(some: DataFrame, labels: DataFrame) -> DataFrame:
        return some.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def divided(named: DataFrame, name: str) -> DataFrame:
        """The members of buckets that hold more than one label; ``major`` is the label
        that most of the bucket has."""
        shares = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n_label"))
        mixed = (shares.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("n_label").alias("n_open"),
                                           F.max_by("label", F.struct("n_label", "label")).alias("major"))
                 .where("labels > 1").select("key", "n_open", "major"))
        return stage(join_groups(named, stage(mixed, "mixed"), "key", "n_open", total * BANDS), name)

    verifier = _Verifier(rows, nodes, words, percent)
    # one hub for every bucket; whoever is linked to a hub bears its number
    hub_pairs = members.where((F.col("node") != F.col("hub.node"))
                              & enough(F.least("size", "hub.size"), F.col("size"), F.col("hub.size")))
    links = stage(verifier.links(hub_pairs.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()), "links")
    hubs = links.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("label"))
    labels = stage(links.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(hubs)
                   .groupBy("node").agg(F.min("label").alias("label")), "labels")
    # of what is left, only nodes that share enough shingles with others can have links;
    # those that share most are the hubs of the rest
    named = divided(labelled(members.drop("hub"), labels), "open-members")
    if not named.isEmpty():
        private = stage(verifier.private_shingles(named.select("node").distinct()), "private")
        # the other set of a link holds what both share, and may hold no more than that
        able = (named.select("key", "node", "size", "n").join(private, "node").withColumn("most", F.col("size") - F.col("private"))
                .where(100 * F.col("most") >= percent * F.col("size")))
        able = stage(able, "able")
        named = divided(labelled(able, labels), "able-members")
        one = F.struct("node", "label", "size", "most")
        central = (named.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(HUBS)).alias("draw"))
                   .agg(F.min_by(one, F.struct(F.col("private") / F.col("size"), "node")).alias("hub"), F.first("n_open").alias("n_open"))
                   .groupBy("key").agg(F.collect_list("hub").alias("hubs"), F.first("n_open").alias("n_open")))
        near = (join_groups(named.drop("n_open"), stage(central, "central"), "key", "n_open", total * BANDS)
                .select("node", "label", "size", "most", F.explode("hubs").alias("hub"))
                .where((F.col("label") != F.col("hub.label"))
                       & enough(F.least("most", "hub.most"), F.col("size"), F.col("hub.size")))
                .select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct())
        links = links.unionByName(stage(verifier.links(near), "central-links"))
        labels = stage(connected_components(links), "labels")
        # the pairs that no hub has settled
        named = divided(labelled(able, labels), "last-members")
        rest = verifier.sharing_rare_shingles(named.groupBy("node").agg(F.first("label").alias("label"), F.first("size").alias("size")))
        more = stage(verifier.links(rest), "last-links")
        if not more.isEmpty():
            labels = stage(joined_components(labels, more), "labels")

    placed = nodes.join(labels, "node", "left").select("set_id", "first", "n_docs",
                                                       F.coalesce("label", "node").alias("label"))
    least = placed.groupBy("label").agg(F.min("first").alias("keep"), F.count(F.lit(1)).alias("n_nodes"))
    placed = stage(join_groups(placed.select("set_id", "n_docs", "label"), stage(least, "components"), "label", "n_nodes", total)
                   .select("set_id", "keep", "n_docs"), "placed")
    some = join_groups(facts.where("n_shingles > 0").select("row", "doc_id", "digest", "n_shingles", "set_id"),
                       placed, "set_id", "n_docs", total)
    repeats = F.coalesce(F.col("doc_id") == F.col("keep.doc_id"), F.lit(False)) & (F.col("digest") == F.col("keep.digest"))
    some = some.select("row", "doc_id", "n_shingles", F.col("keep.doc_id").alias("component_id"),
                       ((F.col("row") == F.col("keep.row")) | repeats).alias("kept"))
    none = facts.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"),
                                                F.lit(True).alias("kept"))
    return some.unionByName(none)


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component its first row and its repeats."""
    rows = _numbered(docs)
    gone = _judged(rows, words, percent).where("not kept").select(F.col("row").alias("__llm_row"))
    return rows.join(stage(gone, "gone"), "__llm_row", "left_anti").select(*docs.columns)
