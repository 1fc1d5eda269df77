"""Whitening against exact rational arithmetic, and edge cases."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string, x double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 2.0) for i, v in rows], SCHEMA)


def brute(vectors):
    """n, S, the covariance as fractions and each vector of integers."""
    xs = [tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(xs))
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    centred = [[Fraction(x[i]) - Fraction(s[i], n) for i in range(d)] for x in fit]
    v = [[sum(c[i] * c[j] for c in centred) / n for j in range(d)] for i in range(d)]
    return n, s, v, xs


def test_equals_rational_arithmetic(spark):
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((6, 6))
    vectors = [(rng.standard_normal(6) @ mix).astype(np.float32).tolist() for _ in range(80)]
    vectors[7] = vectors[3]
    rows = list(enumerate(vectors)) + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [math.nan] * 6), (903, [math.inf] + [0.0] * 5), (904, []), (None, vectors[5])]
    got = whitening.whiten(table(spark, rows).repartition(5)).collect()
    n, s, v, xs = brute(vectors)
    e, u = np.linalg.eigh(np.array([[float(a) for a in r] for r in v]))
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 81 * 6 and {r.component for r in got} == set(range(1, 7)) and {r.n for r in got} == {n} == {79}
    signs = {}
    for r in got:
        x = xs[5 if r.vec_id is None else r.vec_id]
        assert int(r.deviation) == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        k = r.component - 1
        want = float(np.array([float(Fraction(a) - Fraction(b, n)) for a, b in zip(x, s, strict=True)]) @ u[:, k]) / math.sqrt(e[k])
        assert abs(abs(r.whitened) - abs(want)) < 1e-9
        if abs(want) > 1e-6:
            assert signs.setdefault(k, np.sign(want) * np.sign(r.whitened)) == np.sign(want) * np.sign(r.whitened)
        assert abs(r.explained / (e[k] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


def test_sums_are_exact_for_large_entries(spark):
    rng = np.random.default_rng(4)
    vectors = [[float(np.float32(c)) for c in rng.uniform(-1, 1, 3) * 10.0 ** rng.integers(0, 16)] for _ in range(50)]
    rows = table(spark, list(enumerate(vectors))).repartition(20)
    got = whitening.whiten(rows).filter("component = 1").collect()
    n, s, v, xs = brute(vectors)
    e = np.linalg.eigvalsh(np.array([[float(a) for a in r] for r in v]))
    assert abs(got[0].explained / (e[-1] / e.sum()) - 1) < 1e-9
    for r in got:
        want = sum((n * a - b) ** 2 for a, b in zip(xs[r.vec_id], s, strict=True))
        assert r.deviation is None if want >= 10**38 else int(r.deviation) == want
    whole = whitening.exact_sums(rows.select("embedding").mapInArrow(lambda it: it, "embedding array<float>").limit(0).select(F.lit(b"x").alias("x")), 0)
    assert whole is None


def test_edges(spark):
    empty = table(spark, [(1, None)]).limit(0)
    assert whitening.whiten(empty).count() == 0 and whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    same = whitening.whiten(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, None, None)] * 4
    # The second entry never changes: one component with variance, one without.
    flat = whitening.whiten(table(spark, [(1, [1.0, 3.0]), (2, [-1.0, 3.0])])).orderBy("vec_id", "component").collect()
    assert [r.whitened and abs(r.whitened) for r in flat] == [1.0, None, 1.0, None] and [r.explained for r in flat] == [1.0, 0.0, 1.0, 0.0]
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_primes_and_rounds(spark):
    assert whitening.primes_over(1 << 100)[0] == 1048573 and math.prod(whitening.primes_over(1 << 100)) > 1 << 100
    parts = spark.range(70).selectExpr("cast(id as int) part", "cast(cast(id as string) as binary) data")
    assert whitening.added(parts, 70, lambda some: str(sum(int(x) for x in some)).encode(), fan=4) == str(sum(range(70))).encode()


def test_query_of_the_given_table(spark):
    rows = queries.queries()["op13_whitening"](spark, "/root/testdata/sf0.001").collect()
    assert dict(zip(rows[0].asDict(), [type(x) for x in rows[0]], strict=True)) == {"vec_id": int, "component": int, "n": int, "deviation": int, "whitened": float, "explained": float, "identity_error": float}
    n = rows[0].n
    w = {c: np.array([r.whitened for r in rows if r.component == c]) for c in range(1, 17)}
    assert all(len(x) == n for x in w.values()) and rows[0].identity_error < 1e-10
    assert all(abs((w[a] * w[b]).mean() - (a == b)) < 1e-9 for a in w for b in w)
