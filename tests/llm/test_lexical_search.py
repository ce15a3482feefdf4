import math
import random
import re
from collections import Counter

from shelfcast.llm import lexical_search
from shelfcast.llm.lexical_search import TERM, ranked


def split(text):
    return [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall(TERM, text or "")]


def brute(docs, items, k=10):
    bags = [(i, Counter(split(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    total, words = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for doc, bag, n in bags:
            m = 25 + (75 * n * total) // words
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                        for t in split(text) if t in bag)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    made = ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                  spark.createDataFrame(items, "item_id long, text string"), **options)
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in made.collect()), key=str)


def corpus(rng, n=400):
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([3, 20, 80])))) for i in range(n)]
    items = [(i, " ".join(rng.choices(words, weights, k=25))) for i in range(12)]
    docs += [(n + i, "x y " + items[i][1] + " Z") for i in range(12) for _ in range(2)]
    return docs, items


def test_equals_scoring_every_document(spark):
    docs, items = corpus(random.Random(1))
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, k=3) == brute(docs, items, 3)


def test_stops_creating_accumulators_and_stays_exact(spark, monkeypatch):
    # Rare words decide; 3,000 documents hold the frequent ones only.
    rng = random.Random(7)
    items = [(i, " ".join([f"rare{i}x{j}" for j in range(8)] + ["the", "of"])) for i in range(12)]
    docs = [(i, " ".join(rng.choice(["the", "of", "and"]) for _ in range(20))) for i in range(3000)]
    docs += [(5000 + 10 * i + r, t) for i, t in items for r in range(3)]
    made = {}
    kept = lexical_search.written
    def noted(df, name, **options):
        made[name] = kept(df, name, **options)
        return made[name]

    monkeypatch.setattr(lexical_search, "written", noted)
    assert found(spark, docs, items, k=3) == brute(docs, items, 3)
    assert made["accumulators-0"].count() == 36


def test_awkward_rows(spark):
    docs = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (3, ""), (4, " -- \t"), (5, "A É é"), (6, "w " * 30000 + "É"), (None, None)]
    items = [(1, "a É"), (1, "a É"), (2, None), (3, ""), (None, "é"), (4, "absent")]
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "d")], "doc_id long, text string").selectExpr(
        "*", "1 AS item", "2 AS term", "3 AS score", "4 AS doc", "5 AS band", "6 AS n")
    items = spark.createDataFrame([(9, "a b")], "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS term", "3 AS item")
    assert [(r["item_id"], r["doc_id"]) for r in ranked(docs, items).orderBy("rank").collect()] == [(9, 1), (9, 2)]
