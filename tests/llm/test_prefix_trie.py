import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from shelfcast.llm.contraction import subtree_totals
from shelfcast.llm.prefix_trie import end_digests, ordered_turns, prefix_trie, rebuilt

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The contract, one conversation at a time."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(c - rest, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    out = []
    for path, members in nodes.items():
        kids = [p for p in nodes if len(p) == len(path) + 1 and p[:-1] == path]
        below = [p for p in nodes if p[:len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0) for p in below)
        ends = sorted(c for c in members if len(whole[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaves), saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows):
    made = prefix_trie(*rebuilt(ordered_turns(spark.createDataFrame(rows, TURNS).repartition(5))))
    assert made.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in made.collect()), key=str)


def test_trie_equals_one_conversation_at_a_time(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hé", "yes", "no", ""]))
            for c in [*range(-12, 45), 2**63 - 1, 2**63 - 3, -2**63] for t in range(rng.choice([1, 1, 2, 3, 12]))]
    rows += [(50 + i, t, "user", "same") for i in range(40) for t in range(4)]
    rows += [(100, None, None, None), (100, None, "user", "x"), (100, 1, "user", "x"), (100, 1, "user", "x"), (100, 1, "a", None),
             (None, 1, "user", "lost"), (None, None, None, None), (101, 5, "user", "long " * 20000)]
    assert trie(spark, rows) == brute(rows)


def test_one_conversation_may_hold_most_turns(spark):
    rows = [(3, t, "user", f"t{t % 7}") for t in range(1500)] + [(c, 0, "user", "t0") for c in range(10, 20)]
    made = trie(spark, rows)
    assert len(made) == len({tuple(r[:2]) for r in made})
    assert max(r[1] for r in made) == 1500 - zlib.crc32(b"3") % 9
    root = next(r for r in made if r[1] == 0)
    assert root[3] == 11 and root[5] == sum(r[4] == 0 for r in made)


def test_no_turns_no_nodes(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []


def test_contraction_equals_recursion_on_chains_stars_and_random_trees(spark):
    rng = random.Random(2)
    parent = {0: None, **{i: i - 1 for i in range(1, 300)}}  # a chain
    parent |= {300: None, **{i: 300 for i in range(301, 600)}}  # a star
    parent |= {600: None, **{i: rng.randrange(max(600, i - 9), i) for i in range(601, 1000)}, 1000: None}
    value = {i: rng.randrange(-5, 100) for i in parent}
    total = dict(value)
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            total[parent[i]] += total[i]
    tree = spark.createDataFrame([(i, p, value[i], 1 if i % 2 else None) for i, p in parent.items()], "node long, parent long, a long, b long")
    assert {r["node"]: r["a"] for r in subtree_totals(tree, ["a", "b"]).collect()} == total
    assert subtree_totals(tree.limit(0), ["a"]).count() == 0


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    from shelfcast.llm import contraction
    rounds = []
    kept = contraction.written
    monkeypatch.setattr(contraction, "written", lambda df, name: rounds.append(name) or kept(df, name))
    chain = spark.range(3000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(1).cast("long").alias("n"))
    made = {r["node"]: r["n"] for r in subtree_totals(chain, ["n"]).collect()}
    assert made == {i: 3000 - i for i in range(3000)}
    assert sum(n.startswith("rake") for n in rounds) < 30


def test_digests_are_streamed_in_order(spark):
    ends = spark.range(0, 30000, 3).select(F.col("id").alias("conv_id"), *[F.lit(c).cast("long").alias(n) for c, n in ((1, "depth"), (2, "p1"), (3, "p2"))])
    more = spark.createDataFrame([(-5, 1, 2, 3), (-70000, 1, 2, 3), (7, 1, 2, 4)], ends.schema)
    made = {r["p2"]: r["ends_sha256"] for r in end_digests(ends.unionByName(more)).collect()}
    assert made[3] == hashlib.sha256(",".join(map(str, [-70000, -5, *range(0, 30000, 3)])).encode()).hexdigest()
    assert made[4] == hashlib.sha256(b"7").hexdigest()
