"""Exact, near and substring deduplication and components against brute force and edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, ngram_join, substring_dedup
from tessera.llm.components import components
from tessera.llm.sketch import Sketch
from tessera.llm.words import Words, runs
from tests.llm.test_text_operators import docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- exact


def test_exact_edges(spark):
    table = docs(spark, [(5, "a  b"), (3, "a\tb"), (3, "a\nb"), (None, "a b"), (None, "only"), (None, "only"), (7, None), (8, ""), (9, " "), (10, "x" * 100_000)])
    got = exact_dedup.exact_dedup(table, fan_in=2).collect()
    kept = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size) for r in got if r.kept)
    assert len(got) == 10 and kept == [(-1, -1, 2), (3, 3, 4), (7, 7, 2), (9, 9, 1), (10, 10, 1)]
    assert {r.text_sha256 for r in got if r.keep_id == 3} == {hashlib.sha256(b"a b").hexdigest()}
    once = exact_dedup.keep_one(table)
    assert once.columns == table.columns and sorted((r.doc_id or -1) for r in once.collect()) == [-1, 3, 7, 9, 10]
    assert exact_dedup.exact_dedup(table.limit(0)).count() == 0 and exact_dedup.keep_one(table.limit(0)).count() == 0


def test_exact_hot_texts(spark):
    rows = [(i, "" if i % 3 == 0 else f"t{i % 50}") for i in range(600)]
    plain = sorted(tuple(r) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect())
    hot = exact_dedup.exact_dedup(docs(spark, rows), hot_rows=100)
    assert sorted(tuple(r) for r in hot.collect()) == plain
    assert [r.group_size for r in hot.filter("doc_id = 3").collect()] == [200]


def test_sketch_totals_stop_and_never_wrap():
    sketch = Sketch(1 << 16, 1, 2)
    hashes = np.repeat(np.arange(5, dtype=np.uint64), 200)
    parts = [sketch.parts(hashes, g) for g in range(30)]
    full = sketch.merge(pa.concat_tables(parts))
    assert sketch.estimates(full.filter(pa.compute.equal(full["group"], 7)), np.arange(5, dtype=np.uint64)).tolist() == [2] * 5
    total = np.full(3, np.uint32(4))
    assert (np.minimum(total + np.array([255] * 3, np.uint8), np.uint32(4)) == 4).all()


@pytest.mark.parametrize(("parts", "fan_in", "range_rows"), [(1, 2, 10), (13, 2, 7), (40, 8, 1000)])
def test_exact_rounds(spark, parts, fan_in, range_rows):
    rng = random.Random(parts)
    rows = [(i, f"t{rng.randint(0, 60)}") for i in range(400)]
    digested = exact_dedup.digests(docs(spark, rows).repartition(parts)).cache()
    assert digested.count() == 400
    found = exact_dedup.survivors(digested, fan_in, range_rows).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert sorted((r.keep_id, r.group_size) for r in found) == sorted((min(g), len(g)) for g in groups.values())


def test_one_run_a_partition_and_sorted_merges(spark):
    rng = random.Random(2)
    digested = exact_dedup.digests(docs(spark, [(i, f"t{rng.randint(0, 500)}") for i in range(3000)]).repartition(4)).cache()
    runs = digested.mapInArrow(exact_dedup.first_runs(1), exact_dedup.RUN_SCHEMA).collect()
    parts = digested.rdd.getNumPartitions()
    assert len(runs) == parts and len({r.run for r in runs}) == parts
    found = []
    for r in runs:
        keys = [r["keys"][a : a + exact_dedup.KEY_BYTES] for a in range(0, len(r["keys"]), exact_dedup.KEY_BYTES)]
        assert keys == sorted(set(keys))
        found.append((np.frombuffer(bytes(r["keys"]), f"S{exact_dedup.KEY_BYTES}"), *[np.frombuffer(bytes(r[c]), np.int64) for c in ("ids", "uids", "counts")]))
    keys, _, _, counts = exact_dedup.merged(found)
    assert (keys[1:] > keys[:-1]).all() and counts.sum() == 3000
    assert len(exact_dedup.merged([])[0]) == 0


# -- components


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1200)] + [(5, 5), (None, 1), (2000, 2001), (2001, 2000)] + [(rng.randint(3000, 3060), rng.randint(3000, 3060)) for _ in range(40)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: find(a) for a in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- n-grams


def brute_links(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def variants(rng, n):
    """Bases, and copies that change a few words, drop some, or share a common line or are short."""
    vocabulary = [f"{a}{b}" for a in "bcdfg" for b in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 40, 90]))] for _ in range(n // 8)]
    line = [f"L{i}" for i in range(12)]
    out = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words += line
        out.append((i, " ".join(words).replace("b", "B", rng.randint(0, 2))))
    return out


@pytest.mark.parametrize(("size", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (1, 50, 3)])
def test_ngram_join_against_brute_force(spark, size, percent, seed):
    rows = variants(random.Random(seed), 320)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs(spark, rows), size, percent).collect()}
    assert got == brute_links(rows, size, percent)


def test_ngram_join_over_a_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in table.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(table, 4, 85).collect()}
    assert got == brute_links(rows, 4, 85)


def test_chains_join_where_hubs_do_not_link(spark):
    """Each text links only with its neighbours, so no hub of a posting list links them all."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 100])) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs(spark, rows), 4, 90).collect()}
    assert got == brute_links(rows, 4, 90) and {c for _, c in got.values()} == {0}


def test_members_of_a_group_link_past_its_first(spark):
    """Nodes of one size and prefix, where the second and third link with each other but not with the first."""
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join([*common, *[f"t{t}" for t in tail]])) for i, tail in enumerate([range(100, 140), range(0, 40), [*range(0, 36), *range(200, 204)]])]
    rows += [(10 + i, r[1]) for i, r in enumerate(rows)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs(spark, rows), 1, 90).collect()}
    assert got == brute_links(rows, 1, 90) and got[2][1] == 1


def test_a_shingle_that_all_have_joins_nothing(spark):
    """Form letters: very many share most shingles, yet none links, and few pairs are formed."""
    body = [f"f{k}" for k in range(13)]
    rows = [(i, " ".join([*body[: i % 13], f"u{i}", *body[i % 13 :]])) for i in range(4000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs(spark, rows), 4, 85).collect()}
    assert brute_links(rows[:300], 4, 85) == {i: (11, i) for i in range(300)} and got == {i: (11, i) for i in range(4000)}


def test_ngram_join_edges(spark):
    table = docs(spark, [(1, None), (2, ""), (3, "a b"), (4, "A B"), (5, "a b c"), (None, "a b"), (6, "z " * 60_000), (7, "same"), (7, "same")])
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id or -1) for r in ngram_join.ngram_join(table, 4, 85).collect())
    assert got == [(-1, 1, -1), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 1, 6), (7, 1, 7), (7, 1, 7)]
    assert ngram_join.ngram_join(table.limit(0), 4, 85).count() == 0


# -- substrings


def brute_removed(rows, window):
    first, words = {}, {}
    for i, t in sorted(rows):
        words[i] = WORD.findall(t or "")
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), (i, k))
    out = {}
    for i, w in words.items():
        gone = {k + d for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < (i, k) for d in range(window)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize(("window", "seed"), [(20, 1), (5, 2), (3, 3)])
def test_substrings_against_brute_force(spark, window, seed):
    rng = random.Random(seed)
    passages = [[f"p{j}_{k}" for k in range(rng.randint(window, 3 * window))] for j in range(6)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages)[: rng.choice([window - 1, None])] if rng.random() < 0.6 else [f"u{rng.randint(0, 10**9)}" for _ in range(rng.randint(1, 30))]
        words += ["same"] * rng.choice([0, 0, window + 3])
        rows.append((i * 7, rng.choice([" ", "  ", "\n"]).join(words)))
    rng.shuffle(rows)
    got = substring_dedup.substring_dedup(docs(spark, rows).repartition(7), window, joined=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == brute_removed(rows, window)


def test_no_sketch_loses_a_repeat(spark, monkeypatch):
    """Even a sketch far too small, in many groups, pieces, ranges and levels."""
    monkeypatch.setattr(substring_dedup, "CELLS", 0)
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 300)
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 500)
    monkeypatch.setattr(substring_dedup, "FAN_IN", 3)
    rng = random.Random(9)
    rows = [(i, " ".join(f"v{rng.randint(0, 3)}" for _ in range(40))) for i in range(60)]
    got = substring_dedup.substring_dedup(docs(spark, rows).repartition(5), 6, joined=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == brute_removed(rows, 6)


def test_long_texts_in_pieces(monkeypatch):
    words = [f"w{i % 977}".encode() for i in range(5000)]
    monkeypatch.setattr(substring_dedup, "PIECE_BYTES", 100)
    monkeypatch.setattr(substring_dedup, "PIECE_WORDS", 64)
    texts, of, first = substring_dedup.pieces([b" ".join(words), b"", b"a  b"], 20)
    seen = [(k, a + i) for t, k, a in zip(texts, of, first) for i in range(len(t.split()) - 19)]
    assert seen == [(0, i) for i in range(4981)] and texts[-2:] == [b"", b"a b"]
    whole, cut = substring_dedup.Windows([b" ".join(words)], 20), [substring_dedup.Windows([t], 20) for t in texts]
    assert (np.concatenate([c.anchor for c in cut]) == whole.anchor).all() and (np.concatenate([c.hash for c in cut]) == whole.hash).all()


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_that_collide_in_polynomial_hashes(spark):
    """A long word and its complement collide in every polynomial hash modulo 2**64 with an odd base."""
    rest = " ".join(f"w{i}" for i in range(19))
    for n in (1024, 200, 4096):
        rows = [(1, f"{thue_morse(n)} {rest}"), (2, f"{thue_morse(n, True)} {rest}"), (3, f"{thue_morse(n)} {rest} more")]
        got = substring_dedup.substring_dedup(docs(spark, rows)).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 20, 0), (2, 20, 0), (3, 21, 20)]


@pytest.mark.parametrize("bits", [0, 3])
def test_windows_are_grouped_by_words_not_by_hash(bits):
    """Even where hashes hardly tell windows apart."""
    rng = random.Random(bits)
    texts = [" ".join(rng.choice("abc") for _ in range(60)).encode() for _ in range(12)]
    w = substring_dedup.Windows(texts, 4)
    text = np.searchsorted(w.words.first, w.at, "right") - 1
    lo, hi, start = w.words.starts[w.at], w.words.ends[w.at + 3], w.at - w.words.first[text]
    buffer = b"\n".join(texts)
    of = substring_dedup.equals(buffer, lo, hi, text, w.hash & np.uint64((1 << bits) - 1), text, start)
    first = {}
    for i in range(len(lo)):
        first.setdefault(buffer[lo[i] : hi[i]], i)
    assert of.tolist() == [first[buffer[a:b]] for a, b in zip(lo, hi)]


@pytest.mark.parametrize("megabytes", [1, 20])
def test_sketch_tells_unrepeated_windows_apart(megabytes):
    """Few windows that occur once pass for repeated, however large the corpus, and the sketch is never held whole."""
    anchors = np.random.default_rng(megabytes).integers(0, 1 << 63, megabytes * (1 << 20) // 36, dtype=np.uint64)
    sketch = Sketch.of(substring_dedup.CELLS * megabytes * (1 << 20), substring_dedup.ROWS, 1)
    parts = [sketch.parts(some, g) for g, some in enumerate(np.array_split(anchors, 5))]
    table = pa.concat_tables(parts).combine_chunks()
    blocks = collections.defaultdict(list)
    for i, key in enumerate(zip(table.column("row").to_pylist(), table.column("block").to_pylist())):
        blocks[key].append(i)
    told = pa.concat_tables([sketch.merge(table.take(rows)) for rows in blocks.values()])
    for g, some in enumerate(np.array_split(anchors, 5)):
        mine = told.filter(pa.compute.equal(told.column("group"), g))
        assert (sketch.estimates(mine, some) > 0).mean() < 0.05
    # Nothing that is there twice is missed.
    again = [*parts, sketch.parts(anchors[:1000], 5)]
    table = pa.concat_tables(again).combine_chunks()
    blocks = collections.defaultdict(list)
    for i, key in enumerate(zip(table.column("row").to_pylist(), table.column("block").to_pylist())):
        blocks[key].append(i)
    told = pa.concat_tables([sketch.merge(table.take(rows)) for rows in blocks.values()])
    assert (sketch.estimates(told.filter(pa.compute.equal(told.column("group"), 5)), anchors[:1000]) > 0).all()


def test_slices_hash_by_content():
    rng = random.Random(4)
    words = [bytes(rng.choices(range(33, 127), k=rng.choice([1, 2, 7, 8, 9, 16, 17, 255, 256, 257, 600]))) for _ in range(500)]
    w = Words([b" ".join(words), b"", b" ".join(reversed(words))])
    h = w.hashes()
    assert (h[:500] == h[500:][::-1]).all() and len(set(h.tolist())) == len(set(words))
    for size in (1, 2, 3, 5, 10, 20):
        found = runs(h, size)
        assert len(found) == 1000 - size + 1 and len(set(found[: 500 - size + 1].tolist())) == len({tuple(words[i : i + size]) for i in range(500 - size + 1)})
    assert len(runs(h[:3], 4)) == 0 and (runs(h[10:40], 20) == runs(h, 20)[10:21]).all()


def test_substring_edges(spark):
    text = " ".join(f"w{i}" for i in range(30))
    table = docs(spark, [(1, text), (1, text), (None, text), (2, f"a  {text}\tz"), (3, None), (4, ""), (9_000_000_000, "x " * 40_000)])
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(table, keep=("kept", "uid", "score")).collect()}
    assert (got[1].n_removed, got[None].n_removed, got[2].n_removed, got[3].text, got[4].text) == (0, 0, 30, None, "")
    assert got[2].text == "a  z" and got[1].text == text and got[2].kept == "x" and got[9_000_000_000].n_removed == 39_999
    assert substring_dedup.substring_dedup(table).count() == 7 and substring_dedup.substring_dedup(table.limit(0)).count() == 0


def test_normalised_by_both_engines(spark):
    row = spark.createDataFrame([("a\x0b\x0c b c",)], "text string").select(exact_dedup.normalised(F.col("text")).alias("t")).first()
    assert row.t == "a b c"
