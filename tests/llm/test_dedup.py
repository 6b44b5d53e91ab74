"""Operators 1, 4, 6 and 10 against brute force and on awkward tables."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from riskfold.llm import components, exact_dedup, line_dedup, minhash_dedup, suffix_dedup

AWKWARD = "doc_id long, text string, __x string, row string, place int, count int"


def awkward(spark, texts):
    """Rows with repeated ids, a null id, and extra columns with names that operators use inside."""
    rows = [(k, t, "x", None, 1, None) for k, t in enumerate(texts)]
    rows += [(0, texts[0], None, "r", None, 2), (None, texts[-1], "x", "r", 3, 4)]
    return spark.createDataFrame(rows, AWKWARD)


def empty(spark):
    return spark.createDataFrame([], AWKWARD)


def prose(rng, n):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


# ---- 10: exact dedup

def test_exact_groups(spark):
    docs = awkward(spark, ["a b", "ab", " a\tb\n", None, "", "other", "ab"])
    got = sorted(exact_dedup.copy_groups(docs).collect(), key=lambda r: (r["keep_id"], not r["kept"], r["doc_id"] is None, r["doc_id"] or 0))
    same = [r for r in got if r["text_sha256"] == hashlib.sha256(b"ab").hexdigest()]
    assert len(same) == 6 and {r["keep_id"] for r in same} == {2} and {r["group_size"] for r in same} == {6}
    assert [r["doc_id"] for r in same if r["kept"]] == [2]  # the longest original
    nothing = [r for r in got if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert {r["doc_id"] for r in nothing} == {3, 4} and [r["doc_id"] for r in nothing if r["kept"]] == [3]


def test_exact_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(7, "t")] * 5 + [(None, "t")], "doc_id long, text string")
    got = exact_dedup.copy_groups(docs).collect()
    assert sum(r["kept"] for r in got) == 1 and len(got) == 6 and {r["keep_id"] for r in got} == {7}
    assert exact_dedup.drop_copies(docs).count() == 1


def test_exact_rows_pass_whole(spark):
    docs = awkward(spark, ["a b", "ab", "other"])
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns and sorted(r["text"] for r in got.collect()) == ["a b", "other"]


def test_exact_empty(spark):
    assert exact_dedup.copy_groups(empty(spark)).count() == 0 and exact_dedup.drop_copies(empty(spark)).count() == 0


def test_bloom_pass_through(spark):
    """Unique digests are let through, repeated ones never are."""
    docs = spark.range(4000).select((F.col("id") % 3500).alias("doc_id"), (F.col("id") % 3500).cast("string").alias("text"))
    rows = docs.select(exact_dedup.digest_of().alias("__llm_sha"), "doc_id")
    tested = exact_dedup.test_bits(rows, exact_dedup.repeated_bits(rows, 4000), 4000)
    assert tested.where("doc_id < 500 and not __llm_maybe").count() == 0
    assert tested.where("doc_id >= 500 and __llm_maybe").count() < 300


# ---- 1: line dedup

def brute_lines(docs, n):
    seen, out = set(), {}
    for key, text in docs:
        said = (text or "").split("\n")
        solid = [k for k, x in enumerate(said) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for a in range(len(solid) - n + 1):
            run = tuple(said[k] for k in solid[a:a + n])
            if run in seen:
                gone.update(range(a, a + n))
            seen.add(run)
        runs = sum(1 for a in gone if a - 1 not in gone)
        drop = {solid[a] for a in gone}
        out[key] = ("\n".join(x for k, x in enumerate(said) if k not in drop), len(solid), len(gone), runs)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_lines_brute_force(spark, n):
    rng = random.Random(n)
    texts = ["\n".join(rng.choice(["a", "b", "c", "", "  ", "d e"]) for _ in range(rng.randint(0, 14))) for _ in range(25)]
    texts += [texts[3], texts[4] + "\n" + texts[5], None, "x\n" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"], r["n_runs"])
           for r in line_dedup.drop_repeated_lines(docs, n).collect()}
    assert got == brute_lines(list(enumerate(texts)), n)


def test_suffix_array_order(spark):
    """Ranks order the suffixes of the id sequences; equal suffixes share one."""
    rng = random.Random(5)
    texts = ["\n".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(12)]
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string")
    _, lines = line_dedup._lines(rows)
    ranks, _ = line_dedup.suffix_array(lines, lines.count())
    got = {r["place"]: r["rank"] for r in ranks.collect()}
    digests = {r["place"]: (bytes(r["digest"]), r["end"]) for r in lines.collect()}
    suffix = {p: [digests[q][0] for q in range(p, end)] for p, (_, end) in digests.items()}
    places = sorted(suffix)
    assert set(got) == set(places)
    for p in places:
        assert got[p] == sum(suffix[q] < suffix[p] for q in places)


def test_lines_awkward(spark):
    docs = awkward(spark, ["a\nb\nc", "a\nb", None, ""])
    got = line_dedup.drop_repeated_lines(docs).collect()
    assert len(got) == 6
    zero = sorted(r["n_removed"] for r in got if r["doc_id"] == 0)
    assert zero == [0, 3]  # the second row of the repeated id is a copy of the first
    assert line_dedup.drop_repeated_lines(empty(spark)).count() == 0


# ---- 4: MinHash

def test_minhash_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(8):
        words = prose(rng, 120).split()
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(["zz", "yy", "XX"])
            texts.append(" ".join(copy))
    texts += ["one two", "ONE  two", "one", "", None, "   "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
           for r in minhash_dedup.near_duplicates(docs, 3, 85).collect()}
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k:k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set()))
    label = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == {k: (len(s), label[k], label[k] == k) for k, s in enumerate(sets)}


def test_minhash_awkward(spark):
    docs = awkward(spark, ["a b c d e f", "a b c d e f", None, "z"])
    got = minhash_dedup.near_duplicates(docs, 3, 85).collect()
    assert len(got) == 6 and {r["component_id"] for r in got if r["n_shingles"] == 4} == {0}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [3]
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0
    only_null = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert minhash_dedup.near_duplicates(only_null).first()["kept"]
    assert sorted(r["text"] or "" for r in minhash_dedup.drop_near_duplicates(docs).collect()) == ["", "a b c d e f", "a b c d e f", "z"]


def test_near_duplicates_go_by_row(spark):
    """Null and repeated ids: only near copies go, however ids are shared, and one row of a component stays."""
    rng = random.Random(21)
    base, lone, shared, pair = (prose(rng, 200) for _ in range(4))
    near = lambda text: text + " tail"
    rows = [(1, base), (None, near(base)), (None, lone), (None, prose(rng, 50)),  # a null near copy, null unique texts
            (5, shared), (5, near(base)), (6, prose(rng, 60)), (6, near(shared)),  # ids shared by unique rows and near copies
            (None, pair), (None, near(pair)), (8, prose(rng, 70)), (8, None)]
    docs = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    got = minhash_dedup.drop_near_duplicates(docs, words=3, percent=85).collect()
    left = sorted(r["n"] for r in got)
    assert [n for n in left if n not in (8, 9)] == [0, 2, 3, 4, 6, 10, 11] and len(left) == 8
    assert all((r["doc_id"], r["text"]) == rows[r["n"]] for r in got)
    same_id = spark.createDataFrame([(7, pair), (7, near(pair))], "doc_id long, text string")
    assert minhash_dedup.drop_near_duplicates(same_id, words=3, percent=85).count() == 1


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_signature_test_passes_links(percent):
    """A pair at the least similarity fails the signature test with a chance below MISSED."""
    n, p, agree = minhash_dedup.BANDS * minhash_dedup.ROWS, percent / 100, minhash_dedup.agree_at(percent)
    assert sum(math.comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(agree)) < minhash_dedup.MISSED == 4e-7
    assert agree == {80: 45, 85: 50, 95: 50}[percent]


def test_minhash_hubs_find_links_between_non_hubs(spark, monkeypatch):
    """Two tight groups in the same buckets: the rounds after the first join each."""
    rng = random.Random(3)
    base = prose(rng, 300).split()
    one = base[:]
    two = base[:40] + prose(rng, 20).split() + base[60:]
    texts = [" ".join(x[:k] + ["qq"] + x[k + 1:]) for x in (one, two) for k in (3, 90, 150, 222)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["component_id"] for r in minhash_dedup.near_duplicates(docs, 3, 95).orderBy("doc_id").collect()]
    assert got == [0] * 4 + [4] * 4


def test_components_chain_and_star(spark):
    n = 200
    edges = [(k, k + 1) for k in range(n)] + [(1000, 1000 + k) for k in range(1, n)] + [(5000, 4999), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(n + 1)) and all(got[1000 + k] == 1000 for k in range(n)) and got[5000] == 4999


# ---- 6: suffix dedup

def brute_bytes(docs):
    seen, out = set(), {}
    for key, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s:s + 100] in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(raw[s:s + 100])
        left = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[key] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def test_suffix_brute_force(spark):
    rng = random.Random(11)
    passage, other = prose(rng, 60), prose(rng, 45)
    texts = [prose(rng, 150), passage, prose(rng, 30) + passage + prose(rng, 20), other + passage[40:],
             "é" + passage[:130] + "ß", "ab" * 400, "x" * 99, "x" * 100, "x" * 350, "", None, "\0" * 210,
             passage + other + passage, other[3:], prose(rng, 10) + "ab" * 70]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in suffix_dedup.drop_repeats(docs).collect()}
    assert got == brute_bytes(list(enumerate(texts)))


def test_suffix_awkward(spark):
    long = "word " * 3 + "abcdefghij" * 15
    got = suffix_dedup.drop_repeats(awkward(spark, [long, None, "", long]), with_text=True).collect()
    removed = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in got)
    n = len(long)
    first = min(x for a, b, x in removed if b == 0 and not a)
    assert len(got) == 6 and first < n and [x for _, b, x in removed if b == 3 or x == n] .count(n) == 3
    assert suffix_dedup.drop_repeats(empty(spark)).count() == 0


def test_merge_never_compares_known_prefixes():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    runs = []
    for k in range(7):
        run = sorted(strings[k::7])
        shared, _ = suffix_dedup.front_code(run)
        runs.append(iter(list(zip(run, shared.tolist()))))
    order, merged, prefixes = suffix_dedup.merge_runs(runs)
    assert merged == sorted(strings) and len(set(order)) == len(strings)
    for a, b, n in zip(merged, merged[1:], prefixes[1:]):
        assert a[:n] == b[:n] and (len(a) == n or len(b) == n or a[n] != b[n])


def test_exact_filter_in_parts(spark, monkeypatch):
    """A filter of many broadcast parts: the same rows, and no text is joined on a block."""
    rng = random.Random(4)
    texts = [prose(rng, 5) for _ in range(3000)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(10_000 + k, t + " ") for k, t in enumerate(texts[:1500])] + [(None, None), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(tuple(r) for r in exact_dedup.drop_copies(docs.where("doc_id is not null")).collect())
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(exact_dedup, "BLOCK_BITS", 32768)
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 128)  # several blocks
    got = exact_dedup.drop_copies(docs.where("doc_id is not null"))
    assert exact_dedup.blocks_for(1500) > 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__llm_block" not in plan and "BroadcastHashJoin" in plan
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 3001
    assert exact_dedup.drop_copies(docs).count() == 3001


def test_minhash_kept_is_the_component(spark):
    """Of rows that share an id, all or none are kept in the report."""
    text = prose(random.Random(8), 100)
    docs = spark.createDataFrame([(1, text), (1, text + " tail"), (2, text + " end"), (None, None)], "doc_id long, text string")
    got = minhash_dedup.near_duplicates(docs, 3, 85).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"]) == [(1, 1, True), (1, 1, True), (2, 1, False)]


def test_minhash_copies_of_one_text(spark):
    """Copies with few to many changes: some linked, some near them but below the threshold."""
    rng = random.Random(12)
    base = prose(rng, 60).split()
    texts = []
    for _ in range(250):
        words = base[:]
        for k in rng.sample(range(len(words)), rng.choice([1, 2, 3, 4, 5, 6, 9])):
            words[k] = "".join(rng.choice("xyz") for _ in range(8))
        texts.append(" ".join(words))
    sets = [set(minhash_dedup.shingle_set(t, 3).tolist()) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                if label[i] != label[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs, 3, 85).collect()}
    assert got == dict(enumerate(label)) and 1 < len(set(label)) < 250


def test_minhash_subset_of_a_longer_text(spark):
    """A text and one that only adds words to it: they are linked, though the longer one shares no more than
    the 85 % that it must, and their buckets are full of texts that are close to both but linked with neither."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(402)]
    texts = [" ".join(base + [f"x{k}" for k in range(70)]), " ".join(base)]  # 400 of 470 shingles: 85.1 %
    for n in range(150):
        copy = list(base)
        for k in rng.sample(range(1, len(copy) - 1), 31):
            copy[k] = f"y{n}-{k}"
        texts.append(" ".join(copy))
    sets = [{tuple(w[k:k + 3]) for k in range(len(w) - 2)} for w in map(str.split, texts)]
    assert 100 * len(sets[0] & sets[1]) >= 85 * len(sets[0] | sets[1])
    assert not any(100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for a in range(152) for b in range(max(2, a + 1), 152))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs, 3, 85).collect()}
    assert got == {k: 0 if k < 2 else k for k in range(152)}


def test_components_that_are_stars_need_no_round(spark, monkeypatch):
    names = []
    monkeypatch.setattr(components, "stage", lambda df, name, *more, f=components.stage: names.append(name) or f(df, name, *more))
    stars = spark.createDataFrame([(1, 4), (1, 5), (2, 7)], "a long, b long")
    labels = components.connected_components(stars)
    assert {r["node"]: r["label"] for r in labels.collect()} == {1: 1, 4: 1, 5: 1, 2: 2, 7: 2}
    assert names == ["edges"]
    # links between components, to a node without a label, and inside a component
    more = spark.createDataFrame([(5, 7), (8, 9), (4, 5)], "a long, b long")
    joined = components.joined_components(labels, more)
    assert {r["node"]: r["label"] for r in joined.collect()} == {1: 1, 4: 1, 5: 1, 2: 1, 7: 1, 8: 8, 9: 8}
    assert joined.count() == 7 and "large-star" not in names
