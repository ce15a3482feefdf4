"""Decontamination against every window of every document, by brute force."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from shelfcast.llm.decontaminate import RADIUS, SIMILARITY, contaminations, decontaminated, fingerprint, within_radius


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bag(split):
    return Counter(tuple(split[i:i + 5]) for i in range(len(split) - 4))


def brute(docs, items):
    """(doc_id, item_id) where some window of the item's size is similar enough."""
    found = set()
    for doc_id, text in docs:
        split = words(text)
        for item_id, item in items:
            item = words(item)
            if len(item) < 5:
                continue
            for start in range(max(1, len(split) - len(item) + 1)):
                a, b = bag(split[start:start + len(item)]), bag(item)
                if a and 2 * sum((a & b).values()) >= SIMILARITY * (sum(a.values()) + sum(b.values())):
                    found.add((doc_id, item_id))
    return found


def fixture():
    rng = random.Random(4)
    make = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    items = [(i, " ".join(make(rng.randrange(14, 50)))) for i in range(12)] + [(20, "too short for it"), (21, None), (22, "")]
    items += [(23, items[0][1]), (24, "a b c d e a b c d e a b c d e a b c d e")]
    docs = []
    for i in range(60):
        text = make(rng.randrange(1, 200))
        kind = i % 6
        passage = words(items[i % 12][1])
        if kind == 1:
            passage[len(passage) // 2] = "changed"
        if kind == 2:
            passage = passage[: len(passage) // 2]
        if kind == 3:
            passage.insert(3, "inserted")
        if kind < 4:
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage
        docs.append((i, " ".join(text).upper() + "." if kind == 0 else ", ".join(text)))
    docs += [(100, None), (101, ""), (None, docs[0][1]), (0, docs[0][1]), (0, docs[4][1]), (102, items[0][1] + " tail"), (103, words(items[0][1])[3]),
             (104, "a b c d e a b c d e a b c d e a b c d e a b c d e"), (105, "é ü " * 30)]
    return docs, items


def test_equals_brute_force(spark, empty):
    docs, items = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS n", "3 AS start")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminations(df, bench).collect()}
    want = brute(docs, items)
    assert got == want
    assert {i for _, i in want} >= {0, 23, 24}

    kept = decontaminated(df, bench)
    assert kept.columns == df.columns
    bad = {t for d, t in docs if any((x, i) in brute([(x, t)], items) for x in [d] for i, _ in items)}
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in kept.collect()])) == sorted(map(str, [d for d in docs if d[1] not in bad]))
    assert contaminations(empty, bench).count() == 0
    assert contaminations(df, bench.limit(0)).count() == 0
    assert decontaminated(df, bench.limit(0)).count() == len(docs)


def test_fingerprint_is_the_majority_of_bits(spark):
    rng = random.Random(5)
    hashes = [rng.randrange(-2**63, 2**63) for _ in range(21)]
    got = spark.createDataFrame([(hashes,)], "h array<long>").select(fingerprint(F.col("h")).alias("p")).first()["p"]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 21)
    assert got % (1 << 64) == want


def test_passages_cut_at_their_end_to_the_least_similarity_are_found(spark):
    rng = random.Random(6)
    docs, items = [], []
    for i in range(300):
        passage = [f"p{i}x{k}" for k in range(44)]
        # 32 of the 40 shingles stay; in some, one word fills the end, which moves the fingerprint far.
        rest = ["filler"] * 8 if i % 3 == 0 else [f"q{rng.randrange(10**9)}" for _ in range(8)]
        items.append((i, " ".join(passage)))
        docs.append((i, " ".join(passage[:36] + rest)))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in contaminations(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i): 0.8 for i in range(300)}


def test_blocks_find_every_print_within_the_radius(spark):
    rng = random.Random(8)
    left = [(i, rng.randrange(2**64)) for i in range(300)]
    right = [(i, b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 30)))) for i, b in left] + [
        (1000 + i, rng.randrange(2**64)) for i in range(300)]
    signed = lambda b: b - 2**64 if b >= 2**63 else b
    frames = [spark.createDataFrame([(1, i, signed(b)) for i, b in side], f"n int, {name} int, {name}_bits long") for side, name in ((left, "l"), (right, "r"))]
    for radius in (0, 7, 8, RADIUS):
        found = [(r["l"], r["r"]) for r in within_radius(*frames, ["n"], "l_bits", "r_bits", radius).collect()]
        assert sorted(found) == sorted((i, j) for i, a in left for j, b in right if (a ^ b).bit_count() <= radius)


def test_the_radius_decides_without_the_rescue(spark):
    docs, items = fixture()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda **how: {(r["doc_id"], r["item_id"]) for r in contaminations(df, bench, **how).collect()}
    exact, near, whole = rows(radius=0, rescue=False), rows(rescue=False), brute(docs, items)
    assert exact < near <= whole
    # Recall of the fingerprints alone, against every window.
    assert len(near) >= 0.95 * len(whole)


def test_a_window_is_found_where_no_shingle_stands_at_its_place(spark):
    passage = [f"r{i}" for i in range(60)]
    rest = [f"z{i}" for i in range(200)]
    # The halves change places: each start that fits one half to the item loses the other half.
    turned = rest[:90] + passage[30:] + passage[:30] + rest[90:]
    items, docs = [(1, " ".join(passage))], [(7, " ".join(turned)), (8, " ".join(rest + passage[:30]))]
    got = contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items) == {(7, 1)}
    assert [(r["start"], round(r["similarity"], 6)) for r in got] == [(90, round(52 / 56, 6))]
