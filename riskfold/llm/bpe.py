"""Operator 9: byte-level BPE encoding and decoding with DuckDB per partition.

Every partition is encoded where it lies: no shuffle.  Inside a task, the
distinct pre-tokens of a block of texts (matches of the split pattern) become
token-position rows of a DuckDB table, one row a byte.  A recursive query joins
neighbouring rows with the merge table and contracts each word's leftmost pair of
minimum rank, until no word has a pair; words without one leave the recursion.
Ordered aggregation gives each word its ids and, from the ids alone, its bytes;
texts are put together from their words.

The rank file is read once on the driver (its size is that of the vocabulary) and
broadcast; tasks need no file.  Memory in a task is bounded by ``BLOCK_CHARS``
characters of text (one text at least), ``CHUNK`` words a query, and ``CACHE``
remembered words; these bound memory only and never change a result.  Words
longer than ``LONG`` bytes, for which one contraction a step would be quadratic,
are contracted in the same order with a heap.

Defined results: null text is the empty text, which has no ids; repeated rows and
ids are encoded row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import ship_package

BLOCK_CHARS = 8 << 20
CHUNK = 50_000
CACHE = 150_000
LONG = 256

#: A token's place: word number in the high bits, byte offset in the low nine.
#: ``here`` is the rank a pair would merge to in the high bits, its place in the low
#: forty, so that the least one is the leftmost pair of minimum rank.  Words without
#: a pair are put out once more, as step -1, and take no further part.
_ENCODE = """
WITH RECURSIVE steps(step, place, id) AS (
    SELECT 0, place, id FROM start
  UNION ALL
    (WITH pairs AS MATERIALIZED (
        SELECT t.step, t.place, t.id, t.next_place, (m.rank << 40) + t.place AS here
        FROM (SELECT step, place, id, lead(id) OVER byte_order AS next_id, lead(place) OVER byte_order AS next_place
              FROM steps WHERE step >= 0 WINDOW byte_order AS (ORDER BY place)) t
        LEFT JOIN merges m ON m.pair = (CAST(t.id AS BIGINT) << 32) + t.next_id
                          AND t.next_place >> 9 = t.place >> 9),
     best AS (SELECT place >> 9 AS word, min(here) AS here, arg_min(next_place, here) AS gone
              FROM pairs WHERE here IS NOT NULL GROUP BY 1)
     SELECT CASE WHEN best.here IS NULL THEN -1 ELSE step + 1 END, place,
            CASE WHEN pairs.here = best.here THEN CAST(best.here >> 40 AS INTEGER) ELSE id END
     FROM pairs LEFT JOIN best ON word = place >> 9 WHERE place IS DISTINCT FROM gone)
)
SELECT place >> 9 AS word, count(*) AS n, array_to_string(list(id ORDER BY place), ' ') AS ids,
       string_agg(hex, '' ORDER BY place) AS hex
FROM steps JOIN vocabulary USING (id) WHERE step = -1 GROUP BY 1
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class Encoder:
    """Encodes words by the ranks, in one DuckDB connection."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import pyarrow as pa
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        pairs, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left << 32) + right)
                    merged.append(rank)
        self.merge = dict(zip(pairs, merged))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        made = {"merges": pa.table({"pair": pa.array(pairs, pa.int64()), "rank": pa.array(merged, pa.int64())}),
                "vocabulary": pa.table({"id": pa.array(self.tokens, pa.int64()),
                                        "hex": [t.hex() for t in self.tokens.values()]})}
        for name, table in made.items():
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.byte_ids = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.words: dict[str, tuple[int, str, bytes]] = {}
        self.parts: dict[str, tuple[int, str, bytes] | None] = {}
        self.old_words, self.old_parts = {}, {}  # the generation before

    def forget(self) -> None:
        """Drop the remembered words: a worker that waits for its next task holds none."""
        self.words, self.parts, self.old_words, self.old_parts = {}, {}, {}, {}

    def _heap(self, word: bytes) -> list[int]:
        """The same contractions, in the same order, for one long word."""
        ids, after = [self.byte_ids[b] for b in word], list(range(1, len(word) + 1))
        before, merge = list(range(-1, len(word) - 1)), self.merge
        live = [True] * len(word)
        heap = [(r, p, ids[p], ids[p + 1]) for p in range(len(ids) - 1)
                if (r := merge.get((ids[p] << 32) + ids[p + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, p, left, right = heapq.heappop(heap)
            n = after[p]
            if not live[p] or n >= len(ids) or ids[p] != left or ids[n] != right:
                continue  # one of the two has been merged since
            ids[p], live[n], after[p] = rank, False, after[n]
            if after[n] < len(ids):
                before[after[n]] = p
            for a, b in ((before[p], p), (p, after[p])):
                if a >= 0 and b < len(ids) and (r := merge.get((ids[a] << 32) + ids[b])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x, alive in zip(ids, live) if alive]

    def _remember(self, word: str, ids: list[int]) -> None:
        self.words[word] = (len(ids), " ".join(map(str, ids)), b"".join([self.tokens[i] for i in ids]))

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that are not known yet."""
        import numpy as np
        import pyarrow as pa

        rest: list[tuple[str, bytes]] = []
        for word in words:
            raw = word.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self._remember(word, [rank])
            elif len(raw) > LONG:
                self._remember(word, self._heap(raw))
            else:
                rest.append((word, raw))
        for at in range(0, len(rest), CHUNK):
            chunk = rest[at:at + CHUNK]
            lengths = np.array([len(raw) for _, raw in chunk])
            data = np.frombuffer(b"".join([raw for _, raw in chunk]), np.uint8)
            starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
            words_of = np.repeat(np.arange(len(chunk), dtype=np.int64), lengths)
            self.db.register("start", pa.table({
                "place": (words_of << 9) + np.arange(len(data), dtype=np.int64) - starts,
                "id": np.array(self.byte_ids, np.int32)[data]}))
            for w, n, ids, hexed in self.db.execute(_ENCODE).fetchall():
                self.words[chunk[w][0]] = (n, ids, bytes.fromhex(hexed))
            self.db.unregister("start")

    def _put(self, pieces: list[str]) -> tuple[int, str, bytes]:
        if len(pieces) == 1:
            return self.words[pieces[0]]
        if not pieces:
            return 0, "", b""
        numbers, ids, raw = zip(*map(self.words.__getitem__, pieces))
        return sum(numbers), " ".join(ids), b"".join(raw)

    def encode_whole(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """As ``encode``, for any pattern: every text is matched whole."""
        if len(self.words) > CACHE:
            self.old_words, self.words = self.words, {}
        for text in texts:
            pieces = self.find(text)
            self.learn(set(pieces) - self.words.keys())
            yield self._put(pieces)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """(number of ids, the ids in decimal joined by spaces, decoded bytes) of each text.

        Only for patterns that allow it, a text is cut before its spaces.  A match of the pattern never spans such
        a cut when the characters on both sides of the space are no white space,
        so equal parts have equal matches; texts with other cuts are matched
        whole."""
        if len(self.parts) > CACHE:
            self.old_words, self.old_parts, self.words, self.parts = self.words, self.parts, {}, {}
        cut = [t.split(" ") for t in texts]
        firsts = [c.pop(0) for c in cut]
        new = set().union(*cut) - self.parts.keys()
        self.parts.update((x, self.old_parts[x]) for x in new & self.old_parts.keys())
        new -= self.parts.keys()
        found = {x: self.find(" " + x) if x and not x[0].isspace() and not x[-1].isspace() else None for x in new}
        odd = {x for x, pieces in found.items() if pieces is None}
        first = [self.find(x) if x and not x[0].isspace() and not x[-1].isspace() else None for x in firsts]
        words = set().union(*filter(None, found.values()), *filter(None, first)) - self.words.keys()
        self.words.update((x, self.old_words[x]) for x in words & self.old_words.keys())
        self.learn(words - self.words.keys())
        self.parts.update((x, None if x in odd else self._put(pieces)) for x, pieces in found.items())
        known = self.parts.__getitem__
        for text, c, head in zip(texts, cut, first):
            got = list(map(known, c))
            if head is None or None in got:
                pieces = self.find(text)
                self.learn(set(pieces) - self.words.keys())
                yield self._put(pieces)
            else:
                got.insert(0, self._put(head))
                numbers, ids, raw = zip(*got)
                yield sum(numbers), " ".join(ids), b"".join(raw)


_ENCODERS: dict[tuple[str, str], Encoder] = {}  # one per worker process and vocabulary


def ranks_digest(ranks: dict[bytes, int]) -> str:
    """A digest of the whole vocabulary."""
    whole = hashlib.sha256()
    for token, rank in sorted(ranks.items()):
        whole.update(f"{rank} {len(token)} ".encode() + token)
    return whole.hexdigest()


def _encoder(name: str, ranks, pattern: str) -> Encoder:
    """This worker's encoder of the vocabulary called ``name``."""
    if (name, pattern) not in _ENCODERS:
        _ENCODERS[name, pattern] = Encoder(ranks.value, pattern)
    return _ENCODERS[name, pattern]


def blocks(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    """Runs of rows of about ``BLOCK_CHARS`` characters, one row at least."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > BLOCK_CHARS:
            yield ids[start:k], texts[start:k]
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield ids[start:], texts[start:]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False,
                     cut_at_spaces: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row.
    ``vocabulary``: path of a rank file on the driver; ``with_ids`` adds the ids
    themselves, as decimals joined by spaces.  ``cut_at_spaces``: true for patterns no
    match of which spans the place before a space between two characters that are not
    white space (as in the public vocabularies here); it saves matching, not more."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship_package(spark)
    read = read_ranks(vocabulary)
    name, ranks = ranks_digest(read), spark.sparkContext.broadcast(read)
    sha = hashlib.sha256

    def run(batches):
        encoder = _encoder(name, ranks, pattern)
        encode = encoder.encode if cut_at_spaces else encoder.encode_whole
        gc.disable()  # the words and parts hold no cycles, and there are millions for a collector to walk
        try:
            yield from encoded(encode, batches)
        finally:
            gc.enable()
            encoder.forget()

    def encoded(encode, batches):
        for batch in batches:
            for ids, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = {"doc_id": ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
                for n, text_ids, decoded in encode(texts):
                    out["n_tokens"].append(n)
                    out["ids_sha256"].append(sha(text_ids.encode()).hexdigest())
                    out["decoded_sha256"].append(sha(decoded).hexdigest())
                    if with_ids:
                        out["ids"].append(text_ids)
                if not with_ids:
                    del out["ids"]
                types = {"doc_id": pa.int64(), "n_tokens": pa.int64()}
                yield pa.record_batch([pa.array(v, types.get(k, pa.string())) for k, v in out.items()], list(out))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string" * with_ids
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)
