"""Near-duplicate embeddings against all pairs by brute force."""

import math

import numpy as np

from shelfcast.llm import neardup_vectors
from shelfcast.llm.neardup_vectors import agreement, near_duplicates, passes_needed


def brute(rows):
    good = {i: np.array(v, float) for i, (_, v) in enumerate(rows)
            if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.abs(v).max() for i, v in good.items()}
    unit = {i: v / np.sqrt(v @ v) for i, v in unit.items()}
    link = {i: [j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in unit}
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in link.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        named = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(named) if named else None
        out.append((vec_id, len(link.get(i, [])), component, vec_id == component))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS node", "'z' AS component")
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df, **options).collect()), key=str)


def test_equals_all_pairs_with_awkward_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    rows = [(i, base[i].tolist()) for i in range(60)]
    rows += [(100 + i, (base[i % 6] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(40)]
    rows += [(200 + i, base[1].tolist()) for i in range(25)] + [(None, base[1].tolist()), (3, base[3].tolist())]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [math.nan] * 16), (304, [None] + [1.0] * 15), (305, [math.inf] * 16),
             (306, (base[2] * 1e200).tolist()), (307, (base[2] * 1e-200).tolist()), (308, base[2][:8].tolist()), (309, base[2][:8].tolist()),
             (310, [-0.0] * 15 + [1.0]), (311, [0.0] * 15 + [1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_groups_larger_than_window_and_block_are_counted_whole(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(12)
    rows = [(i, (centre + 0.02 * rng.standard_normal(12)).tolist()) for i in range(300)]
    rows += [(1000 + i, rng.standard_normal(12).tolist()) for i in range(100)]
    assert run(spark, rows, window=8, block=32) == brute(rows)


def test_lone_pairs_are_found_on_a_table_with_a_common_direction(spark):
    rng = np.random.default_rng(3)
    count, size = 1000, 48
    common = np.zeros(size)
    common[0] = np.sqrt(0.6)

    def near(left):
        aside = rng.standard_normal(size)
        aside -= (aside @ left) * left
        return 0.902 * left + np.sqrt(1 - 0.902**2) * aside / np.linalg.norm(aside)

    rest = rng.standard_normal((count, size - 1))
    base = common + np.hstack([np.zeros((count, 1)), np.sqrt(0.4) * rest / np.linalg.norm(rest, axis=1, keepdims=True)])
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(10000 + i, near(base[i]).tolist()) for i in range(200)]
    want = brute(rows)
    assert sum(r[1] > 0 for r in want) >= 400
    assert run(spark, rows, passes=8, window=4, block=8) == want


def test_passes_grow_with_the_chance_to_miss():
    half = np.log(np.full(10, 0.5))
    assert passes_needed(half, 1, 1e-3) == 10
    assert passes_needed(half, 32, 1e-4) == 426
    assert passes_needed(np.zeros(0), 32) == 32
    assert passes_needed(np.full(5, -40.0), 32) == 32


def test_passes_find_the_pairs_whatever_they_cost(spark, monkeypatch):
    dealt, deal = [], neardup_vectors.block_pairs
    monkeypatch.setattr(neardup_vectors, "block_pairs", lambda members, key, *rest, **how: dealt.append(key) or deal(members, key, *rest, **how))
    # More passes than all pairs of so small a table cost.
    monkeypatch.setattr(neardup_vectors, "passes_needed", lambda log_misses, done: 3 * done)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, (base[i] + 0.05 * rng.standard_normal(12)).tolist()) for i in range(20)]
    assert run(spark, rows, passes=8, window=4, block=8) == brute(rows)
    # Blocks of pairs only count links inside components.
    assert dealt == ["component"]


def test_a_direction_at_the_mean_needs_a_finite_number_of_passes():
    mean = np.array([0.99, 0.0])
    same = agreement(np.array([[1.0, 0.0], [0.0, 1.0]]), mean, 0.9)
    assert same[0] == 0.5 and 0.5 < same[1] < 1
    assert passes_needed(np.log1p(-same[:1] ** 8), 1) < 5000
