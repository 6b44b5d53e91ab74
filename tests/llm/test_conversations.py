"""Operators 11 and 13 (conversations) and 12 (shards) against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from riskfold.llm import conversation_repair as repair
from riskfold.llm import prefix_trie as trie
from riskfold.llm import sharding

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_order(rows):
    def digest(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()

    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))


# --- operator 11 ---------------------------------------------------------------------

def brute_trie(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn, role or "", text or ""))
    convs = {c: [(r, t) for _, r, t in in_order(v)] for c, v in convs.items()}
    built = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = int(c - (abs(c) % 5) * (1 if c >= 0 else -1))
        built[c] = convs.get(head, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, who in members.items():
        below, leaves, saved = [p], 0, 0
        while below:
            x = below.pop()
            leaves += x not in kids
            saved += (len(members[x]) - 1) * len(x[-1][1].encode()) if x else 0
            below += kids.get(x, [])
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(kids.get(p, [])), leaves, saved, sha(ends)))
    return sorted(out, key=repr)


def trie_rows(spark, rows):
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit(1)))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def random_talks(seed, n, words=3):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.choice([0, 1, 2, 3, 6, 12])):
            rows.append((c, t, "ua"[t % 2], r.choice(["x", "ý", "zz"][:words]) if r.random() < 0.8 else None))
    return rows


def test_trie_against_brute_force(spark):
    rows = random_talks(1, 300) + [(None, 1, "u", "lost"), (-7, None, None, "x"), (-7, 1, "u", "x"), (-5, 1, "u", "x"),
                                   (1000, 5, "u", "same"), (1000, 5, "u", "same"), (1000, None, "u", "first")]
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_of_one_hot_conversation(spark):
    """Most conversations alike: their nodes lie on the borders of all ranges."""
    rows = [(c, t, "u", f"turn {t}") for c in range(400) for t in range(5)]
    rows += [(c, t, "u", f"turn {t}" if t < 3 else f"own {c}") for c in range(400, 430) for t in range(30)]
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_rows(spark, [(None, 1, "u", "x")]) == []
    assert trie_rows(spark, [(3, 1, "u", "x")]) == brute_trie([(3, 1, "u", "x")])


@pytest.mark.parametrize("seed", range(4))
def test_tree_layouts(seed):
    """All four layouts, compressed paths cut in the middle, keys that are prefixes of others."""
    r = random.Random(seed)
    keys = {bytes(r.randrange(256) for _ in range(trie.WIDTH)) * r.randrange(3) for _ in range(600)}
    keys |= {k + bytes([b]) * trie.WIDTH for k in list(keys)[:3] for b in range(0, 256, 1 + seed)}
    keys = sorted(keys)
    root = trie.ArtNode(b"")
    for row, key in enumerate(keys):
        trie.insert(root, key, row, row, [1] * (len(key) // trie.WIDTH))
    found, kinds, todo = [], set(), [(root, b"")]
    while todo:
        node, before = todo.pop()
        kinds.add(node.kind)
        whole = before + node.path
        found += [(whole, e) for e in node.ends]
        kids = node.children()
        assert [k.path[0] for k in kids] == sorted({k.path[0] for k in kids})
        todo += [(k, whole) for k in kids]
    assert sorted(found) == list(zip(keys, range(len(keys))))
    assert {4, 256} <= kinds


# --- operator 13 ---------------------------------------------------------------------

def brute_edits(rows):
    """All edit strings with up to two insertions in a row."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(("", "I", "II"), repeat=len(rows) + 1):
            audit = "".join(g + e for g, e in zip(gaps, (*edits, "")))
            cost, i, roles, good = 0, 0, "", True
            for e in audit:
                if e == "I":
                    cost, roles = cost + 5, roles + "*"
                    continue
                row = rows[i]
                i += 1
                cost += {"D": 2, "K": 0, "R": 1}[e] + (5 if e != "D" and row.isupper() else 0)
                good &= e == "D" or row != "x"
                roles += "" if e == "D" else "*" if e == "R" else row.lower()
            if good and re.fullmatch(r"([s](?=.))?([u*][a*])*", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


@pytest.mark.parametrize("rows", ["", "s", "u", "a", "x", "ua", "sua", "uas", "uu", "aa", "au", "suu", "sau", "oU", "UA", "sUA", "xua",
                                  "uxa", "ssu", "uaua", "usa", "Sua", "aua", "auo", "uoUa", "sxsu", "aasu"])
def test_edits_against_brute_force(rows):
    assert repair.search(rows) == brute_edits(rows)


def by_steps(rows):
    """The same by dynamic programming, keeping the least (cost, audit) of each place."""
    def insertions(states):
        for _ in range(2):
            for place, (cost, audit) in list(states.items()):
                then = 3 if place == 2 else 2
                states[then] = min(states.get(then, (10 ** 9, "")), (cost + 5, audit + "I"))
        return states

    states = {0: (0, "")}
    for row in rows:
        now = {}
        for place, (cost, audit) in insertions(states).items():
            more = 5 if row.isupper() else 0
            moves = [("D", place, 2)]
            if row != "x":
                moves.append(("R", 3 if place == 2 else 2, 1 + more))
                if (then := {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(row.lower(), {}).get(place)) is not None:
                    moves.append(("K", then, more))
            for e, then, paid in moves:
                now[then] = min(now.get(then, (10 ** 9, "")), (cost + paid, audit + e))
        states = now
    states = insertions(states)
    return min(states[p] for p in (0, 3) if p in states)


@pytest.mark.parametrize("seed", range(60))
def test_edits_against_steps(seed):
    r = random.Random(seed)
    rows = "".join(r.choice("uauauasoxUAS" if seed % 2 else "sS" + "uax") for _ in range(r.randrange(60)))
    assert repair.search(rows) == by_steps(rows)


def test_edits_of_a_long_conversation():
    r = random.Random(5)
    rows = "".join(r.choice("uuaasSUx") for _ in range(3000))
    cost, audit = repair.search(rows)
    assert (cost, audit) == by_steps(rows)
    assert repair.search("ua" * 20_000) == (0, "K" * 40_000)
    assert len(repair.written_edits(rows, audit)) == len(audit)


def brute_repair(rows):
    out, convs = [], {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for conv, found in convs.items():
        found = in_order(found)
        seen, letters, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, role, text in found:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            initial = role[0] if role[:1] and role[0] in "sua" else "o"
            letters += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = by_steps(letters)
        lines, i = [], 0
        for e in audit:
            role = "user" if len(lines) % 2 == (1 if lines and lines[0].startswith("s") else 0) else "assistant"
            if e == "I":
                lines.append(f"{role}:")
            else:
                lines += [] if e == "D" else [f"{found[i][1] if e == 'K' else role}:{found[i][2]}"]
                i += 1
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=repr)


def test_repair_against_brute_force(spark):
    r = random.Random(7)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "", None]) if r.random() < 0.3 else ("user", "assistant")[t % 2],
             r.choice(["Yes.", "No!", "cut", "  ", None, "ü?\n", "Yes."])) for c in range(300) for t in range(r.randrange(9))]
    rows += [(None, 1, "user", "a."), (None, None, "assistant", "b."), (900, None, "user", "a."), (901, 1 << 62, "user", "a."), (901, 3, "user", "b."),
             *[(902, t, "user", "same.") for t in range(500)], (903, 4, "user", "x" * 300_000), (904, 2, "user", "tie."), (904, 2, "assistant", "tie.")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("here", F.lit("clash"))
    got = repair.repair_conversations(repair.damage(frame))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute_repair(rows)
    assert repair.repair_conversations(repair.damage(frame.limit(0))).count() == 0


def test_repaired_rows_are_legal(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "assistant", "Ho."), (2, 0, "user", "cut"), (3, 0, "user", "Yes.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {}
    for r in sorted(repair.repaired_rows(frame).collect()):
        found.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert found == {1: [("system", "Be kind."), ("user", "Hi."), ("assistant", "Ho.")]}


def test_gaps_wider_than_a_long(spark):
    rows = [(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")]
    assert repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)).first()["gaps"] == repair.MAX_LONG


# --- operator 12 ---------------------------------------------------------------------

def shards_of(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"size": F.lit("clash"), "shard": F.lit("clash"), "lang": F.lit("en")})
    return sharding.shard_documents(docs, **more)


def test_shards(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("abc é") for _ in range(r.randrange(200))) for _ in range(3000)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5000 + k, "copy " * 8) for k in range(1500)] + [(6000 + k, "pair" * 9) for k in range(3)]
    rows += [(None, None), (None, ""), (7, texts[7]), (7, texts[7]), (9000, "long " * 2000)]
    got = shards_of(spark, rows).collect()
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", *sharding.ADDED}
    assert sorted(((x["doc_id"], x["text"]) for x in got), key=repr) == sorted(rows, key=repr)
    size, at, of = {}, {}, {}
    for x in got:
        raw = (x["text"] or "").encode()
        assert (x["size"], x["text_crc32"], x["law"], x["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        size[x["shard"]] = size.get(x["shard"], 0) + x["size"]
        at.setdefault(x["shard"], []).append(x["slot"])
        of.setdefault(x["text"], set()).add(x["shard"])
    assert sorted(size) == list(range(16))
    assert all(sorted(v) == list(range(len(v))) for v in at.values())
    mean = sum(size.values()) / 16
    assert max(abs(v - mean) for v in size.values()) <= 2 * sharding.TOLERANCE * mean + 10_001
    assert len(of["pair" * 9]) == 1  # small groups stay together


def test_one_group_is_cut(spark):
    """Nothing but copies: only the second half of the key can part them."""
    got = shards_of(spark, [(k, "same text") for k in range(4000)], n_shards=8, carry=["doc_id"]).groupBy("shard").count().collect()
    assert len(got) == 8 and max(r["count"] for r in got) - min(r["count"] for r in got) <= 4000 / 8 * 2 * sharding.TOLERANCE + 2


def test_few_rows_and_none(spark):
    assert shards_of(spark, [(1, "a"), (2, "b")]).count() == 2
    assert shards_of(spark, [(1, "a")], n_shards=1).first()["shard"] == 0
    assert shards_of(spark, []).count() == 0


def test_written_shards(spark, tmp_path):
    from riskfold.llm.common import stage_folder

    folder = f"{stage_folder(spark)}/shards-{tmp_path.name}"
    sharding.write_shards(spark.createDataFrame([(k, f"text {k}") for k in range(100)], "doc_id long, text string"), folder, 4)
    back = spark.read.parquet(folder)
    assert back.count() == 100 and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
