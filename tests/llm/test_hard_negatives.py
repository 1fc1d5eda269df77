"""Hard negatives against brute force, trees against their definition, and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives, queries
from tests.oracle import same

SCHEMA = "vec_id long, label int, embedding array<float>, shard int, cell string, block double"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2.0) for r in rows], SCHEMA)


def brute(rows, every=10):
    usable = [(i, label, [math.floor(256 * float(np.float32(c))) for c in v]) for i, label, v in rows if i is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, label, x in sorted({(i, label, tuple(x)) for i, label, x in usable if i % every == 0}):
        scores = [(-sum(a * b for a, b in zip(x, y, strict=False)), j, other) for j, other, y in usable if j != i]
        for p, j, _ in sorted(s for s in scores if s[2] == label)[:5]:
            inside = [(s, n) for s, n, other in scores if other != label and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n) in enumerate(sorted(inside)[:10], 1)]
    return sorted(out)


def mined(spark, rows, every=10, **options):
    return sorted(tuple(r) for r in hard_negatives.mine(table(spark, rows), F.col("vec_id") % every == 0, **options).collect())


def vectors(seed, n=400, dim=8, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    if clusters:
        x = x * 0.2 + rng.standard_normal((clusters, dim))[rng.integers(0, clusters, n)] * 2
    x[rng.integers(0, n, n // 4)] = x[0]  # a group of copies
    x[1] *= 30
    return [(i, int(rng.integers(0, 4)), v) for i, v in enumerate(x.astype(np.float32).tolist())]


@pytest.mark.parametrize(("seed", "clusters", "options"), [(0, 0, {}), (1, 6, {"shard_rows": 50, "block_anchors": 7}), (2, 12, {"shard_rows": 300, "sample_rows": 64}), (3, 0, {"shard_rows": 1000})])
def test_equals_brute_force(spark, seed, clusters, options):
    rows = vectors(seed, clusters=clusters)
    want = brute(rows)
    assert len(want) > 500 and mined(spark, rows, **options) == want


def test_edges(spark):
    bad = [(10, None, [1.0, 2.0]), (20, 1, None), (30, 1, [1.0, None]), (40, 1, [math.nan, 1.0]), (50, 1, [math.inf, 1.0]), (None, 1, [1.0, 1.0]), (60, 1, [])]
    good = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, [2.0, 0.0]), (2, 2, [1.0, 5.0]), (2, 2, [1.0, 5.0]), (3, 3, [0.5, 1.0]), (70, 7, [0.0, 0.0]), (71, 7, [1.0]), (72, 8, [-1.0]), (80, 9, [-1.0, 0.0]), (81, 9, [1.0, 1.0])]
    got = mined(spark, bad + good)
    assert got == brute(bad + good) and {r[0] for r in got} == {0, 70}
    # A row that is there twice counts twice; negative scores have no window.
    assert [r for r in got if r[:2] == (0, 1)] == [(0, 1, 1, 2, 131072, 65536), (0, 1, 2, 2, 131072, 65536), (0, 1, 3, 71, 131072, 65536), (0, 1, 4, 81, 131072, 65536)]
    assert mined(spark, bad) == [] and hard_negatives.mine(table(spark, bad).limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_large_entries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, v) for i, v in enumerate((rng.standard_normal((60, 3)) * 2**20).astype(np.float32).tolist())]
    assert mined(spark, rows, shard_rows=16) == brute(rows)
    with pytest.raises(Exception, match="don't fit"):
        mined(spark, [(0, 1, [1e30])])


@pytest.mark.parametrize("n", [1, 5, 64, 300])
def test_trees_hold_all_rows_within_their_ranges(n):
    rng = np.random.default_rng(n)
    points = hard_negatives.augmented(rng.integers(-5, 6, (n, 4)).astype(float), 11.0)
    tree, order = hard_negatives.build(points, 8)
    assert sorted(order.tolist()) == list(range(n)) and np.allclose((points**2).sum(1), 121)
    for i in range((1 << tree.depth) - 1):
        a, m, b = tree.bounds[2 * i + 1, 0], tree.bounds[2 * i + 1, 1], tree.bounds[2 * i + 2, 1]
        assert (a, b) == tuple(tree.bounds[i]) and m == tree.bounds[2 * i + 2, 0]
        for child, lo, hi in ((2 * i + 1, a, m), (2 * i + 2, m, b)):
            far = hard_negatives.distances(points[order[lo:hi]], tree.vantage[i])
            assert not len(far) or (tree.low[child], tree.high[child]) == (far.min(), far.max())


def test_a_traversal_looks_at_few_leaves_of_clustered_rows():
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 6)) * 300
    x = (centres[rng.integers(0, 40, 8000)] + rng.standard_normal((8000, 6)) * 9).astype(np.int64)
    norm = float(np.sqrt((x * x).sum(1).max()))
    shard = hard_negatives.Shard(np.arange(8000), np.zeros(8000, int), x, norm, 32)
    scores = x @ x[7]
    for low, high in ((None, None), (int(scores.max()) * 3 // 10, int(scores.max()) * 9 // 10)):
        one = hard_negatives.Search([shard], x[7], norm)
        got = one.nearest(10, lambda ids, labels: ids >= 0, low, high)
        ok = np.flatnonzero((scores >= low) & (scores <= high)) if low is not None else np.arange(8000)
        assert got == sorted(((int(scores[i]), int(i)) for i in ok), key=lambda r: (-r[0], r[1]))[:10]
        assert len(one.scores) < 80  # of 256


def test_query_equals_sql(spark):
    same(spark, queries.queries()["op11_hard_negatives"], queries.oracle_sql()["op11_hard_negatives"], "/root/testdata/sf0.01")
