"""Suffix orders by grouping, and byte-wise deduplication, against brute force and edge cases."""

import collections
import random

import numpy as np
import pytest

from tessera.llm import suffix_dedup
from tessera.llm.suffix_groups import suffix_orders
from tests.llm.test_text_operators import docs


def by_sorting(symbols, lengths):
    out, base = [], 0
    for n in lengths.tolist():
        own = symbols[base : base + n].tolist()
        out += [base + i for i in sorted(range(n), key=lambda i: own[i:])]
        base += n
    return out


@pytest.mark.parametrize("seed", range(60))
def test_suffix_orders(seed):
    rng = np.random.default_rng(seed)
    lengths = -np.sort(-rng.integers(1, 60, rng.integers(1, 9)))
    symbols = np.concatenate([np.append(rng.integers(1, rng.integers(2, 6), n - 1), 0) for n in lengths])
    assert suffix_orders(symbols, lengths).tolist() == by_sorting(symbols, lengths)


def test_suffix_orders_of_extremes():
    same = np.append(np.ones(3000, int), 0)
    assert suffix_orders(same, np.array([3001])).tolist() == list(range(3000, -1, -1))
    rising, falling = np.append(np.arange(1, 500), 0), np.append(np.arange(500, 1, -1), 0)
    both = np.concatenate([rising, falling])
    assert suffix_orders(both, np.array([500, 500])).tolist() == by_sorting(both, np.array([500, 500]))
    fibonacci = "a"
    last = "b"
    while len(fibonacci) < 600:
        fibonacci, last = fibonacci + last, fibonacci
    word = np.append(np.frombuffer(fibonacci.encode(), np.uint8).astype(int) - 96, 0)
    assert suffix_orders(word, np.array([len(word)])).tolist() == by_sorting(word, np.array([len(word)]))
    assert len(suffix_orders(np.zeros(0, int), np.zeros(0, int))) == 0


def brute(rows, window=200):
    """For each row what is left and the number of removed bytes and spans."""
    texts = [(t or "").encode() for _, t in rows]
    counts = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if counts[t[i : i + window]] > 1:
                gone[i : i + window] = True
        turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
        out.append((bytes(b for b, g in zip(t, gone, strict=True) if not g), len(t), int(gone.sum()), turns[0::2].tolist(), turns[1::2].tolist()))
    return out


def key(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


def check(spark, rows, **options):
    got = [(r.doc_id, bytes(r.left), r.n_bytes, r.n_removed, r.span_starts, r.span_ends) for r in suffix_dedup.suffix_dedup(docs(spark, rows), **options).collect()]
    want = [(i, *x) for (i, _), x in zip(rows, brute(rows, options.get("window", 200)), strict=True)]
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def corpus(seed, n=60):
    """Copies, copies with a changed letter, shared passages at any place, repeats within a text, other alphabets."""
    rng = random.Random(seed)
    words = [f"{a}{b}é"[: rng.randint(2, 4)] for a in "abcdfgh" for b in "aeiou"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.choice([30, 48, 50, 52, 90]))) for _ in range(6)]
    out = []
    for i in range(n):
        kind = rng.random()
        own = " ".join(rng.choice(words) for _ in range(rng.randint(0, 150)))
        if kind < 0.2 and out:
            own = out[rng.randrange(len(out))]
        elif kind < 0.4 and out:
            own = list(out[rng.randrange(len(out))] or "x")
            own[rng.randrange(len(own))] = "Z"
            own = "".join(own)
        elif kind < 0.7:
            own = own[: rng.randint(0, 99)] + rng.choice(passages) + own[:50] + rng.choice(passages)[rng.randint(0, 40) :]
        out.append(own)
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "options"), [(0, {}), (1, {"group_bytes": 3000}), (2, {"group_bytes": 1500, "fan_in": 2}), (3, {"group_bytes": 2000, "window": 152})])
def test_equals_brute_force(spark, seed, options):
    got = check(spark, corpus(seed), **options)
    assert 0 < sum(r[3] for r in got) < sum(r[2] for r in got)


def test_edges(spark):
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefgh ") for _ in range(200))
    rows = [(1, None), (2, ""), (3, "x" * 199), (4, "x" * 200), (5, "y" * 201), (None, line + "1"), (None, line + "2"), (8, "é" * 100), (9, "é" * 99 + "e"), (10, line[1:] + "z"), (11, "0" + line)]
    got = check(spark, rows)
    by_id = {r[0]: r for r in got}
    assert by_id[1][1:4] == (b"", 0, 0) and by_id[5][3] == 201 and by_id[4][3] == 0 and by_id[10][3] == 0 and by_id[11][3] == 200
    # Rows that repeat both columns are texts of their own.
    assert [r[3] for r in check(spark, [(1, line), (1, line), (2, "q")])].count(200) == 2
    assert suffix_dedup.suffix_dedup(docs(spark, [(1, "a")]).limit(0)).count() == 0
    assert check(spark, [(1, None), (2, None)])


def test_long_and_periodic_texts(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(30_000))
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 3000)
    rows = [(1, long), (2, long[10_000:20_000]), (3, "ab" * 3000), (4, "=" * 5000 + long[:150]), (5, "abcde" * 200), (6, long[15_000:15_199] + "#"), (7, long[29_800:])]
    check(spark, rows)


def test_columns_of_any_names(spark):
    line = "0123456789" * 20
    table = docs(spark, [(1, line), (2, line)]).selectExpr("*", "'g' as `group`", "1 as `a.b`", "2 as span")
    got = suffix_dedup.suffix_dedup(table, keep=("group", "a.b", "span", "kept")).collect()
    assert [(r["group"], r["a.b"], r["span"], r.n_removed, r.left) for r in got] == [("g", 1, 2, 200, b"")] * 2
    with pytest.raises(ValueError, match="window"):
        suffix_dedup.suffix_dedup(table, window=100)
