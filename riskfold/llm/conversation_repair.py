"""Operator 13: conversation structure repair by depth-first branch-and-bound.

A repaired conversation has role initials ``(s?(ua)+)?``.  Edits, one for each row in
order, besides insertions: Keep (0), Rerole to user or assistant (1), Delete (2; the
only one for blank and duplicate rows), Insert an empty user or assistant row (5);
a truncated row that stays adds 5.  Of the cheapest edits those count whose initials
(D, I, K, R) are ASCII-least: the audit.

1. Narrow rows (conv_id, turn, digest of role and text, role initial, fault) are
   grouped by conversation, some 30 bytes a row, never the texts.
2. ``best_edits`` searches each conversation: an explicit stack of prefixes, taken in
   ASCII order; a lower bound of every suffix (the cheapest edits when a conversation
   may also end after its system row); an incumbent (cost, audit), at first that of a
   dive along least bounds; for each node (row, place in the pattern) a dominance
   table of the least cost at which it was left.  As prefixes come in ASCII order, one
   that reaches a node at no less than the cost of an earlier one is worse, and so is
   all that follows.  The search ends when no prefix can beat the incumbent.
3. The texts travel once, dealt by conv_id and sorted; each conversation's edits
   come before its rows, so a task streams them: a conversation of any length is
   hashed, or put out again, one row at a time.

Rows of a conversation stand in the order of turn (null first), those of one turn in
the order of the SHA-256 of their role and text.

Defined results: a null role or text is one space, and so is a null conv_id or turn in
the number that draws the damage; rows without conv_id make one conversation; an
empty role has no initial and cannot be kept; gaps above the range of a long are the
largest long; a conversation without rows has zeros, an empty audit and the digest of
the empty string; an empty table gives an empty result.  Extra columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import WHITE_CHARS, ship_package

KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
CUT_SHORT = 5
#: Places in the pattern: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, TURN = range(4)
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, TURN: USER}, "a": {USER: TURN}}
LEGAL = {"su", "ua", "au"}
MAX_LONG = (1 << 63) - 1


def suffix_bounds(rows: str) -> list[list[int]]:
    """For every suffix of ``rows`` the least that it can cost at each place of the
    pattern; it is exact but for the place after the system row, which here may be the end.

    ``rows`` has a letter a row: its role initial s, u or a, else o; in upper case if it
    is truncated; x if it must go."""
    n = len(rows)
    start, user, assistant = [0] * (n + 1), [0] * (n + 1), [INSERT] * (n + 1)  # by what is next
    for i in range(n - 1, -1, -1):
        row, low, u, a = rows[i], rows[i].lower(), user[i + 1], assistant[i + 1]
        to_s, to_u, to_a = DELETE + start[i + 1], DELETE + u, DELETE + a
        if low != "x":
            more = CUT_SHORT if row != low else 0
            as_user = more + a + (KEEP if low == "u" else REROLE)
            to_u = min(to_u, as_user)
            to_s = min(to_s, as_user, more + u if low == "s" else as_user)
            to_a = min(to_a, more + u + (KEEP if low == "a" else REROLE))
        user[i], assistant[i] = min(to_u, INSERT + to_a), min(to_a, INSERT + to_u)
        start[i] = min(to_s, INSERT + assistant[i])
    return [start, user, assistant, user]


def _moves(rows: str, i: int, place: int) -> Iterator[tuple[str, int, int, int]]:
    """(initial, next row, next place, cost) of the edits at a node, in ASCII order."""
    row = rows[i] if i < len(rows) else ""
    low = row.lower()
    if row:
        yield "D", i + 1, place, DELETE
    wanted = "a" if place == USER else "u"
    then = AFTER[wanted][place]
    yield "I", i, then, INSERT
    if row and low != "x":
        more = CUT_SHORT if row != low else 0
        if place in AFTER.get(low, ()):
            yield "K", i + 1, AFTER[low][place], KEEP + more
        if low != wanted:
            yield "R", i + 1, then, REROLE + more


def _dive(rows: str, bound: list[list[int]]) -> tuple[int, str]:
    """The first incumbent: along least cost plus bound, never above deleting all."""
    i, place, cost, audit = 0, START, 0, []
    while not (i == len(rows) and place in (START, TURN)):
        edit, i, place, paid = min(_moves(rows, i, place),
                                   key=lambda m: (m[3] + bound[m[2]][m[1]], m[0]))
        audit.append(edit)
        cost += paid
        if cost > DELETE * len(rows):
            return DELETE * len(rows), "D" * len(rows)
    return cost, "".join(audit)


def search(rows: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, ASCII-least of these."""
    bound = suffix_bounds(rows)
    best, audit = _dive(rows, bound)
    in_order = False  # the incumbent comes from the stack: what follows it is larger in ASCII order
    least: dict[tuple[int, int], int] = {}
    path = bytearray()
    stack = [(0, START, 0, 0, 0)]
    while stack:
        i, place, cost, depth, edit = stack.pop()
        could_be = cost + bound[place][i]
        if could_be > best or (in_order and could_be == best) or least.get((i, place), cost + 1) <= cost:
            continue
        least[i, place] = cost
        del path[max(0, depth - 1):]
        if depth:
            path.append(edit)
        if i == len(rows) and place in (START, TURN):
            best, audit, in_order = cost, path.decode(), True
            continue
        stack.extend([(j, then, cost + paid, depth + 1, ord(name))
                      for name, j, then, paid in list(_moves(rows, i, place))[::-1]])
    return best, audit


_remembered = lru_cache(maxsize=20_000)(search)  # short conversations are alike


def best_edits(rows: str) -> tuple[int, str]:
    return _remembered(rows) if len(rows) <= 40 else search(rows)


def written_edits(rows: str, audit: str) -> str:
    """The audit with the roles written: D, K, and u or a for rows given that role, U or
    A for rows put in."""
    out, i, place = [], 0, START
    for edit in audit:
        if edit == "D":
            out.append("D")
        elif edit == "K":
            place = AFTER[rows[i].lower()][place]
            out.append("K")
        else:
            role = "a" if place == USER else "u"
            place = AFTER[role][place]
            out.append(role if edit == "R" else role.upper())
        i += edit != "I"
    return "".join(out)


def judge(turns: list, digests: list, marks: list[str]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, written edits) of the
    rows of one conversation, in order.  A mark is the role initial (s, u, a, else o) and
    the fault of the row itself: b blank, t truncated, else a dash."""
    seen, letters, faults = set(), [], {"b": 0, "x": 0, "t": 0, "-": 0}
    for digest, (initial, fault) in zip(digests, marks):
        if fault != "b" and digest in seen:
            fault = "x"
        seen.add(digest)
        faults[fault] += 1
        letters.append("x" if fault in "bx" else initial.upper() if fault == "t" else initial)
    illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(marks, marks[1:]))
    known = [t for t in turns if t is not None]
    gaps = min(MAX_LONG, max(known) - min(known) + 1 - len(set(known))) if known else 0
    rows = "".join(letters)
    cost, audit = best_edits(rows)
    return gaps, faults["b"], faults["x"], faults["t"], illegal, cost, audit, written_edits(rows, audit)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` damaged by crc32(``conv_id:turn``) % 20: (conv_id,
    turn, role, text, here); rows that are dropped stay with ``here`` false, so that
    their conversation is still known."""
    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.encode(F.concat(said("conv_id"), F.lit(":"), said("turn")), "UTF-8")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = (F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("here"),
                       F.explode(copies).alias("copy")).drop("copy")


def _prepared(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    here = F.col("here") if "here" in rows.columns else F.lit(True)
    return (rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        role.alias("role"), text.alias("text"), here.alias("here"))
            .withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))))


def _edits(rows: DataFrame) -> DataFrame:
    """One row a conversation: its facts, audit and written edits."""
    import pyarrow as pa

    end = F.rtrim(F.col("text"), F.lit(WHITE_CHARS))
    first = F.substring("role", 1, 1)
    mark = F.concat(F.when(first.isin("s", "u", "a"), first).otherwise("o"),
                    F.when(end == "", "b").when(F.substring(end, -1, 1).isin(".", "!", "?"), "-").otherwise("t"))
    # a null where the row is not here: collect_list leaves it out, the conversation stays
    fact = F.when(F.col("here"), F.struct("turn", "digest", mark.alias("mark")))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(fact)).alias("facts"))
    grouped = grouped.select("conv_id", *[F.col(f"facts.{c}").alias(c) for c in ("turn", "digest", "mark")])

    def run(batches):
        for batch in batches:
            found = [judge(*facts) for facts in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            columns = list(zip(*found)) if found else [()] * 8
            yield pa.record_batch([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:6]],
                                   *[pa.array(c, pa.string()) for c in columns[6:]]],
                                  ["conv_id", *FACTS, "audit", "edits"])

    return grouped.mapInArrow(run, f"conv_id long, {', '.join(f'{c} long' for c in FACTS)}, audit string, edits string")


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
ROLES = {"u": "user", "a": "assistant"}


def _streamed(rows: DataFrame) -> DataFrame:
    """Edits and rows of every conversation, the edits first, dealt by conv_id."""
    edits = _edits(rows)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("digest", "binary"), ("role", "string"), ("text", "string"))]
    first = edits.select("conv_id", F.lit(0).alias("kind"), *none, *FACTS, "audit", "edits")
    nothing = [F.lit(None).cast("long").alias(c) for c in FACTS] + [F.lit(None).cast("string").alias(c) for c in ("audit", "edits")]
    then = rows.where("here").select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "role", "text", *nothing)
    both = first.unionByName(then)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest").drop("turn", "digest")


def _applied(batches: Iterable) -> Iterator[tuple[dict | None, list[tuple[str, str]]]]:
    """(facts, []) where a conversation begins, and (None, repaired rows) for each of
    its rows; ends with the rows put in behind the last one."""
    edits, at = "", 0

    def put_in() -> list[tuple[str, str]]:
        nonlocal at
        start = at
        while at < len(edits) and edits[at] in "UA":
            at += 1
        return [(ROLES[e.lower()], "") for e in edits[start:at]]

    for batch in batches:
        names = batch.schema.names
        kinds, roles, texts = (batch.column(names.index(c)).to_pylist() for c in ("kind", "role", "text"))
        for k, kind in enumerate(kinds):
            if kind == 0:
                facts = {c: batch.column(names.index(c))[k].as_py() for c in ("conv_id", *FACTS, "audit", "edits")}
                edits, at = facts["edits"], 0
                yield facts, []
                if more := put_in():  # before the first row
                    yield None, more
                continue
            edit = edits[at]
            at += 1
            out = [] if edit == "D" else [(roles[k] if edit == "K" else ROLES[edit], texts[k])]
            yield None, out + put_in()


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row for every conv_id of ``conversations`` (conv_id, turn, role, text[, here]):
    its faults, the cost and audit of its cheapest repair, and the SHA-256 of the
    repaired rows as ``role:text`` lines."""
    import pyarrow as pa

    def run(batches):
        facts, digest, empty, done = None, None, True, []
        names = ["conv_id", *FACTS, "audit", "repaired_sha256"]
        types = [pa.int64()] * 7 + [pa.string()] * 2

        def made():
            return pa.record_batch([pa.array([r[c] for r in done], t) for c, t in zip(names, types)], names)

        for start, rows in _applied(batches):
            if start is not None:
                if facts is not None:
                    done.append({**facts, "repaired_sha256": digest.hexdigest()})
                    if len(done) >= 2000:
                        yield made()
                        done = []
                facts, digest, empty = start, hashlib.sha256(), True
            for role, text in rows:
                digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False
        if facts is not None:
            done.append({**facts, "repaired_sha256": digest.hexdigest()})
        yield made()

    ship_package(conversations.sparkSession)
    return _streamed(_prepared(conversations)).mapInArrow(
        run, f"conv_id long, {', '.join(f'{c} long' for c in FACTS)}, audit string, repaired_sha256 string")


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the rows of the repaired conversations, places from 0."""
    import pyarrow as pa

    def run(batches):
        conv, place, out = None, 0, []

        def made():
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, types)],
                                   ["conv_id", "place", "role", "text"])

        types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        for start, rows in _applied(batches):
            if start is not None:
                conv, place = start["conv_id"], 0
            for role, text in rows:
                out.append((conv, place, role, text))
                place += 1
            if len(out) >= 2000:
                yield made()
                out = []
        yield made()

    ship_package(conversations.sparkSession)
    return _streamed(_prepared(conversations)).mapInArrow(run, "conv_id long, place long, role string, text string")
