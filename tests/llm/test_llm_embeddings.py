import numpy as np
import pytest

from fixfold.llm import embed_dedup


def brute(rows, threshold=0.9):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(
        x is not None and np.isfinite(x) for x in v) and any(v)]
    n = {k: 0 for k in range(len(good))}
    root = {k: i for k, (i, _) in enumerate(good)}
    links = [(a, b) for a in range(len(good)) for b in range(a + 1, len(good)) if len(good[a][1]) == len(good[b][1])
             and good[a][1] @ good[b][1] / (np.sqrt(good[a][1] @ good[a][1]) * np.sqrt(good[b][1] @ good[b][1])) >= threshold]
    for a, b in links:
        n[a] += 1
        n[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return sorted((good[k][0], n[k], root[k]) for k in n)


def vectors(seed=1, n=260, dim=16):
    r = np.random.default_rng(seed)
    out, key = [], 0
    for c in range(40):
        base = r.normal(size=dim)
        for _ in range(int(r.integers(1, 12))):
            out.append((key, (base + r.normal(size=dim) * r.choice([0, 0.05, 0.2, 0.3])).astype(np.float32).tolist()))
            key += 1
    return out


def rows_of(found):
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found.collect())


@pytest.mark.parametrize("block_rows", [1000, 7])
def test_against_brute_force(spark, block_rows):
    rows = vectors()
    found = embed_dedup.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>"), recall=0.999999, block_rows=block_rows)
    assert rows_of(found) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.collect())


def test_recall_at_production_parameters(spark):
    rows = vectors(9)
    found = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want = sum(n for _, n, _ in brute(rows))
    got = sum(r["n_links"] for r in found.collect())
    assert 0.95 * want <= got <= want


def test_bad_vectors_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 2.0]), (2, [2.0, 0.0, 4.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]),
            (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [1.0, 0.0]), (10, [1.0, -0.0, 2.0]), (11, [-1.0, 0.0, -2.0]),
            (None, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0])]
    found = embed_dedup.near_duplicates(spark.createDataFrame(
        [(*r, "x", "x", "x") for r in rows], "vec_id long, embedding array<float>, id string, links string, copies string"))
    got = sorted(((r["vec_id"] is None, r["vec_id"]), r["n_links"], r["component_id"]) for r in found.collect() if r["vec_id"] is not None)
    assert [(k[1], n, c) for k, n, c in got] == sorted(
        [(1, 3, 1), (1, 3, 1), (2, 3, 1), (10, 3, 1)] + [(i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9, 11)])
    null = [r for r in found.collect() if r["vec_id"] is None]
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in null] == [(0, None, True)]
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_plan_keeps_its_recall():
    for rows in (10, 10_000, 10 ** 9):
        bits, tables = embed_dedup.table_plan(rows, 0.9, 0.99)
        meet = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 1 - (1 - meet) ** tables >= 0.99


def test_very_large_and_very_small_components(spark):
    rows = [(k, [x * scale for x in v]) for k, (v, scale) in enumerate(
        [([1.0, 2.0, 3.0], 1e160), ([1.0, 2.0, 3.01], 1e160), ([1.0, 2.0, 3.0], 1e-170), ([1.0, 2.0, 3.02], 1e-310),
         ([-1.0, 2.0, 0.5], 1e300), ([1.0, 2.0, 3.0], 1.0)])]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [
        (0, 4, 0), (1, 4, 0), (2, 4, 0), (3, 4, 0), (4, 0, 4), (5, 4, 0)]
