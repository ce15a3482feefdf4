"""Mixing against an exact model of the sampling, in plain Python."""

import hashlib
import math
import re

import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from shelfcast.llm.mixing import MAX_COPIES, WEIGHTS, mixed, planned, source_targets


def levels(sizes: dict) -> dict:
    """Targets by the rule itself: share by weight, stop at the cap, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > MAX_COPIES * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = MAX_COPIES * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=9))
def test_targets_share_all_words_by_weight_up_to_the_cap(spark, sizes):
    named = {f"s{i}": n for i, n in enumerate(sizes)} | {None: 7}
    df = spark.createDataFrame([(s, n) for s, n in named.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(df, "source", "size").collect()}
    want = levels(named)
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(named.values()))


def test_copies_are_the_crossings_of_the_prefix_sums(spark, awkward):
    rows = awkward.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = {}
    for r in rows:
        per.setdefault(r["source"], []).append((size(r["text"]), r["doc_id"]))
    target = levels({s: sum(n for n, _ in v) for s, v in per.items()})
    want = []
    for source, docs in per.items():
        total = sum(n for n, _ in docs)
        each = target[source] / total if total else 0.0
        name = "mix|" if source is None else "mix=" + source
        start = int(hashlib.md5(name.encode()).hexdigest()[:4], 16) / 65536
        tie = lambda d: hashlib.md5(f"mix:{'' if d is None else d}".encode()).hexdigest()
        for k, (n, d) in enumerate(sorted(docs, key=lambda x: (x[0], tie(x[1]), -1 if x[1] is None else x[1]))):
            want.append((d, source, n, math.floor(start + (k + 1) * each) - math.floor(start + k * each)))
    got = planned(awkward.select("doc_id", "text", "source")).collect()
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["source"], r["_words"], r["copies"])) for r in got)
    for source, docs in per.items():
        taken = sum(r["_words"] * r["copies"] for r in got if r["source"] == source)
        assert abs(taken - target[source]) <= max(n for n, _ in docs)
    assert max(r["copies"] for r in got) <= MAX_COPIES


def test_mix_keeps_columns_and_repeats_rows(spark, awkward, empty):
    plan = planned(awkward)
    rows = mixed(awkward)
    assert rows.columns == awkward.columns
    assert rows.count() == plan.selectExpr("sum(copies_)").first()[0]
    assert sorted(map(str, rows.collect())) == sorted(map(str, mixed(awkward).collect()))
    assert mixed(empty).count() == 0
    assert mixed(empty.union(empty).selectExpr("1L AS doc_id", "cast(null AS string) AS text", "'a' AS source")).count() == 0


def test_rows_of_one_id_and_size_are_taken_alike_on_every_run(spark):
    rows = [(1, f"word{i} again", "a", i) for i in range(40)] + [(None, "", None, 0), (2, None, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _row long")
    once, dealt = mixed(docs.repartition(3)), mixed(docs.repartition(7).orderBy(F.desc("text")))
    assert once.columns == docs.columns
    assert sorted(map(str, once.collect())) == sorted(map(str, dealt.collect()))
