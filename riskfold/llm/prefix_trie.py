"""Operator 11: prefix trie of conversations by adaptive radix trees.

A turn's id is the first ``WIDTH`` bytes, big-endian, of the SHA-256 of its role and
text; a conversation's key is its turn ids, one after the other.

1. Narrow rows (conv_id, turn, id, UTF-8 bytes) are dealt by the family of five
   conversations that share a head, grouped, and rebuilt there.
2. Keys are range-partitioned by (key, conv_id) and frozen.  How many turns the last
   key of a range shares with the first of the next is all that ranges must know of
   each other: one small row a range.
3. Each range inserts its keys into an adaptive radix tree (``ArtNode``: layouts of
   4, 16, 48 and 256 children, compressed paths) and walks it in post-order.  A node
   of the trie is put out at every byte depth that is a whole number of turns, also
   inside compressed paths.  Nodes that also occur in a neighbouring range lie on the
   borders of the range; all others are final.
4. Border nodes are merged by the digest of their prefix.  Every share of them is
   counted in one range only (a child where it first occurs, a childless node where it
   last occurs), so merging is sums and minima.  Ids that end at a border node stay in
   chunks of one range each and are hashed in order, one chunk at a time.

So a prefix, or a whole conversation, that a third of all conversations share is spread
over many ranges.  A task holds one range; one conversation is one row (``WIDTH`` + 8
bytes a turn).

Defined results: null role or text is empty; turns are ordered by turn (null first),
those of one turn by id; rows without a conv_id belong to no conversation; ``c % 5`` has
the sign of c; an empty table gives an empty result.  Extra columns take no part.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfold.llm.common import join_groups, ship_package, stage

WIDTH = 16
FAMILY = 5
HEADS = 9
BATCH = 5000


class ArtNode:
    """One node of an adaptive radix tree: the bytes of its compressed path, the ids
    that end at it, and its children in one of four layouts."""

    __slots__ = ("path", "ends", "kind", "keys", "kids", "first", "last", "least", "sizes")

    def __init__(self, path: bytes):
        self.path, self.ends, self.kind = path, [], 4
        self.keys: bytearray | list = bytearray()
        self.kids: list = []
        self.first = self.last = -1  # the rows of the range that lie below
        self.least = None  # the least of their ids
        self.sizes = None  # bytes of the turns of one of their keys

    def child(self, byte: int) -> ArtNode | None:
        if self.kind <= 16:  # sorted bytes beside their children
            at = bisect_left(self.keys, byte)
            return self.kids[at] if at < len(self.keys) and self.keys[at] == byte else None
        if self.kind == 48:  # an index of 256 bytes, 0 for none
            at = self.keys[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, node: ArtNode) -> None:
        """Set the child of ``byte``, growing into the next layout when this one is full."""
        if self.child(byte) is not None:
            if self.kind <= 16:
                self.kids[bisect_left(self.keys, byte)] = node
            elif self.kind == 48:
                self.kids[self.keys[byte] - 1] = node
            else:
                self.kids[byte] = node
            return
        if self.kind <= 48 and len(self.kids) == self.kind:
            self._grow()
        if self.kind <= 16:
            at = bisect_left(self.keys, byte)
            self.keys.insert(at, byte)
            self.kids.insert(at, node)
        elif self.kind == 48:
            self.kids.append(node)
            self.keys[byte] = len(self.kids)
        else:
            self.kids[byte] = node

    def _grow(self) -> None:
        if self.kind == 4:
            self.kind = 16
        elif self.kind == 16:
            index = bytearray(256)
            for at, byte in enumerate(self.keys):
                index[byte] = at + 1
            self.kind, self.keys = 48, index
        else:
            table = [self.kids[at - 1] if at else None for at in self.keys]
            self.kind, self.keys, self.kids = 256, bytearray(), table

    def children(self) -> list[ArtNode]:
        """In the order of their bytes."""
        if self.kind <= 16:
            return list(self.kids)
        if self.kind == 48:
            return [self.kids[at - 1] for at in self.keys if at]
        return [k for k in self.kids if k is not None]


def shared(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # equal up to low, different within high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def insert(root: ArtNode, key: bytes, conv: int, row: int, sizes: list[int]) -> None:
    """Put a key, number ``row`` in the order of keys, into the tree of ``root``
    (whose own path is empty)."""
    node, at = root, 0
    while True:
        if node.first < 0:
            node.first, node.least, node.sizes = row, conv, sizes
        node.last, node.least = row, min(node.least, conv)
        if at == len(key):
            node.ends.append(conv)
            return
        byte = key[at]
        kid = node.child(byte)
        if kid is None:
            kid = ArtNode(key[at:])
            node.put(byte, kid)
        else:
            same = shared(kid.path, key[at:at + len(kid.path)])
            if same < len(kid.path):  # cut the compressed path
                upper = ArtNode(kid.path[:same])
                upper.first, upper.last, upper.least, upper.sizes = kid.first, kid.last, kid.least, kid.sizes
                kid.path = kid.path[same:]
                upper.put(kid.path[0], kid)
                node.put(byte, upper)
                kid = upper
        node, at = kid, at + len(kid.path)


def _told(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


def nodes_of(keys: list[bytes], convs: list[int], sizes: list[list[int]], part: int, before: int, after: int) -> Iterator[tuple]:
    """The trie nodes of one range of keys in order; ``before`` and ``after``: the turns
    that its first key shares with the range before, its last key with the one after,
    -1 where there is none.

    A row: (border, node, parent, part, conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends).  node is the digest of the prefix for border nodes,
    parent that of the parent where the parent is a border node; ends is the digest of
    the ids, for border nodes the ids themselves."""
    root = ArtNode(b"")
    for row, (key, conv, size) in enumerate(zip(keys, convs, sizes)):
        insert(root, key, conv, row, size)
    last_row = len(keys) - 1
    chains: dict[int, list[bytes]] = {0: [b""], last_row: [b""]}

    def name(row: int, depth: int) -> bytes:
        """The digest of the first ``depth`` turns of the first or last key, each made from the one before."""
        chain = chains[row]
        while len(chain) <= depth:
            at = (len(chain) - 1) * WIDTH
            chain.append(hashlib.blake2b(chain[-1] + keys[row][at:at + WIDTH], digest_size=16).digest())
        return chain[depth]

    # (node, byte depth of its parent, whether its children are done)
    stack = [(root, 0, -1, False)]
    # per open node, over the topmost trie nodes below it: how many first occur here, leaves, saved, and their rows
    sums: dict[int, list] = {}
    while stack:
        node, depth, up, done = stack.pop()
        end = depth + len(node.path)
        if not done:
            sums[id(node)] = [0, 0, 0, []]
            stack.append((node, depth, up, True))
            stack.extend([(kid, end, id(node), False) for kid in node.children()])
            continue
        children, leaves, saved, waiting = sums.pop(id(node))
        n, conv = node.last - node.first + 1, node.least
        lowest = -1 if up < 0 else depth // WIDTH  # trie depths at or above belong to the parent
        for d in range(end // WIDTH, lowest, -1):
            comes, goes_on = node.first == 0 and d <= before, node.last == last_row and d <= after
            border = comes or goes_on
            named = name(0 if comes else last_row, d) if border else None
            if not waiting and not goes_on:  # of a node that goes on, the last range knows
                leaves += 1
            saved += (n if comes else n - 1) * (node.sizes[d - 1] if d else 0)
            ends = _told(node.ends if d * WIDTH == end else [])
            for row in waiting:  # the children of this node
                row[2], row[6] = named, None if border else conv
                yield tuple(row)
            waiting = [[border, named, None, part, conv, d, None, n, children, leaves, saved,
                        ends if border else hashlib.sha256(ends).digest()]]
            children = 0 if comes else 1
        if up >= 0:
            above = sums[up]
            above[0] += children
            above[1] += leaves
            above[2] += saved
            above[3] += waiting
        else:
            yield from (tuple(row) for row in waiting)


NODE = ("border boolean, node binary, parent binary, part int, conv_id long, depth long, parent_conv_id long, "
        "n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary")


def rebuilt_keys(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, sizes) of every rebuilt conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn_id = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_id.alias("id"),
        F.octet_length(text).cast("long").alias("size"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = (rows.withColumn("family", family).groupBy("family", "conv_id")
           .agg(F.sort_array(F.collect_list(F.struct("turn", "id", "size"))).alias("turns"))
           .select("family", "conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns")))
    heads = own.where("conv_id = family").select("family", F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % HEADS).cast("int")
    nothing = F.slice("turns", 1, 0)
    turns = F.concat(F.slice(F.coalesce("head", nothing), F.lit(1), h),
                     F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1))))
    whole = own.join(heads, "family", "left").select("conv_id", turns.alias("turns"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")).alias("key"),
                        F.transform("turns", lambda t: t["size"]).alias("sizes"))


def _ranged(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys frozen in ranges, and one row a range: how many turns it shares with
    the ranges before and after."""
    import numpy as np
    import pyarrow as pa

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(keys.repartitionByRange(parts, "key", "conv_id").withColumn("part", F.spark_partition_id()), "keys")
    ends = ranged.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")  # one row a range
    beside = ends.select("part", "low", "high", F.lag("high").over(order).alias("below"), F.lead("low").over(order).alias("above"))

    def run(batches):
        for batch in batches:
            part, low, high, below, above = (c.to_pylist() for c in batch.columns)
            turns = [[-1 if x is None else shared(x, y) // WIDTH for x, y in zip(a, b)] for a, b in ((below, low), (above, high))]
            yield pa.record_batch([pa.array(part, pa.int32()), *[pa.array(np.array(t, np.int32)) for t in turns]],
                                  ["part", "before", "after"])

    return ranged, stage(beside.mapInArrow(run, "part int, before int, after int"), "borders")


def _partial_nodes(ranged: DataFrame, borders: DataFrame) -> DataFrame:
    """The trie nodes of every range (see ``nodes_of``)."""
    import pyarrow as pa

    parts = int(ranged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    types = [pa.bool_(), pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 7, pa.binary()]
    names = [f.split()[0] for f in NODE.split(", ")]

    def made(rows):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names)

    def one(held, part, before, after):
        rows = []
        for row in nodes_of(*held, part, before, after):
            rows.append(row)
            if len(rows) >= BATCH:
                yield made(rows)
                rows = []
        yield made(rows)

    def run(batches):
        held, now = ([], [], []), None
        for batch in batches:
            conv, key, sizes, part, before, after = (batch.column(c).to_pylist() for c in range(6))
            for k in range(len(conv)):
                if now is None or part[k] != now[0]:
                    if now is not None:
                        yield from one(held, *now)
                    held, now = ([], [], []), (part[k], before[k], after[k])
                held[0].append(key[k])
                held[1].append(conv[k])
                held[2].append(sizes[k])
        if now is not None:
            yield from one(held, *now)

    dealt = (ranged.join(F.broadcast(borders), "part")  # one row a range
             .select("conv_id", "key", "sizes", "part", "before", "after")
             .repartition(parts, "part").sortWithinPartitions("part", "key", "conv_id"))
    return stage(dealt.mapInArrow(run, NODE), "trie-nodes")


def _merged(borders: DataFrame) -> DataFrame:
    """Border nodes with their shares of all ranges put together, one row a node."""
    import pyarrow as pa

    spread = borders.groupBy("node").agg(
        F.first("parent", ignorenulls=True).alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])

    def run(batches):
        node, digest, empty = None, None, True
        for batch in batches:
            out = []
            for name, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != node:
                    if node is not None:
                        out.append((node, digest.digest()))
                    node, digest, empty = name, hashlib.sha256(), True
                if said:
                    digest.update(said if empty else b"," + said)
                    empty = False
            yield pa.record_batch([pa.array([r[k] for r in out], pa.binary()) for k in (0, 1)], ["node", "ends"])
        if node is not None:
            yield pa.record_batch([pa.array([node], pa.binary()), pa.array([digest.digest()], pa.binary())], ["node", "ends"])

    parts = int(borders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = (borders.select("node", "ends", "part").repartition(parts, "node").sortWithinPartitions("node", "part")
              .drop("part").mapInArrow(run, "node binary, ends binary"))
    return spread.join(hashed, "node")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    ship_package(conversations.sparkSession)
    found = _partial_nodes(*_ranged(rebuilt_keys(conversations)))
    merged = stage(_merged(found.where("border")), "border-nodes")
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    settled = found.where("not border").select("parent", "parent_conv_id", *columns)
    inner = settled.where("parent is null").select("parent_conv_id", *columns)
    hanging = settled.where("parent is not null").select("parent", *columns).unionByName(
        merged.where("parent is not null").select("parent", *columns))
    top = merged.where("parent is null").select(F.lit(None).cast("long").alias("parent_conv_id"), *columns)
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("__llm_n"))
    total = max(1, found.count())
    joined = join_groups(hanging, parents, "parent", "__llm_n", total).select("parent_conv_id", *columns)
    return (inner.unionByName(joined).unionByName(top)
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.lower(F.hex("ends")).alias("ends_sha256")))
