"""The n-gram join against all pairs by brute force, and its parts."""

import random

import numpy as np
from hypothesis import given, settings, strategies as st

from shelfcast.llm import ngram_join
from shelfcast.llm.components import components
from shelfcast.llm.local_graph import least_labels
from shelfcast.llm.ngram_join import deduplicated, joined
from shelfcast.llm.shingles import WordHashes, least_matches, minhashes, overlaps, shingle_set


def shingles(text):
    words = (text or "").encode().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    near = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        least = lambda ids: min((x for x in ids if x is not None), default=None)
        out.append((doc_id, least([rows[j][0] for j in [i, *near[i]] if sets[j] == sets[i]] if sets[i] else [doc_id]),
                    len(near[i]), least([rows[j][0] for j in seen])))
    return sorted(out, key=str)


def run(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"], r["component_id"]) for r in joined(df).collect()), key=str)


def near_copies(seed, count, edits):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(500)}" for _ in range(80)]
    texts = []
    for _ in range(count):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(9)}"
        texts.append(" ".join(words))
    return texts


def test_equals_all_pairs_on_awkward_documents(spark, awkward, empty):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()] + list(enumerate(near_copies(1, 40, 5), 500))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df) == brute(rows)
    assert run(empty) == []


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BAND_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", 8)
    rows = list(enumerate(near_copies(2, 90, 4) + near_copies(3, 20, 3) + ["short text"] * 5 + [None, ""]))
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_one_document_of_each_group_stays(spark, awkward):
    rows = deduplicated(awkward)
    assert rows.columns == awkward.columns
    want = {r[3] for r in brute([(r["doc_id"], r["text"]) for r in awkward.collect()])}
    got = [r["doc_id"] for r in rows.collect()]
    assert set(got) == want
    assert sorted(d for d in got if d is not None) == sorted(set(d for d in got if d is not None))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab c\t\n", max_size=30), max_size=14))
def test_overlaps_equal_set_intersections(texts):
    hashes = WordHashes()
    sets = [shingle_set(t, hashes) for t in texts]
    want = [[len(shingles(a) & shingles(b)) for b in texts] for a in texts]
    assert overlaps(sets).tolist() == want or not texts


def test_minhash_agreement_estimates_similarity():
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.concatenate([a[:800], np.random.default_rng(2).integers(0, 1 << 63, 200).astype(np.uint64)])
    x, y = minhashes([a, np.sort(b)], 512, 3)
    assert abs((x == y).mean() - 2 / 3) < 0.08


def test_pruning_keeps_what_may_reach_the_threshold():
    # At similarity 0.8, 32 of 32 and 20 of 32 stay; at 0.3, 128 comparisons rule it out.
    assert least_matches(32, 0.8, 1e-6, 8) <= 20
    assert least_matches(128, 0.8, 1e-6, 8) > 0.3 * 128 + 20


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components_equal_a_plain_search(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = np.zeros((26, 26), bool)
    for u, v in edges:
        linked[u, v] = linked[v, u] = True
    labels = least_labels(linked)
    assert got == {n: int(labels[n]) for n in range(26) if any(n in e and e[0] != e[1] for e in edges)}
