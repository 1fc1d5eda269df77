"""BPE, packing, sharding and the pipeline against libraries, brute force and edge cases."""

import collections
import random
import re
import struct
import zlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, packing, queries, sharding
from tests.llm.test_dedup_operators import brute_links, brute_removed
from tests.llm.test_text_operators import docs

OWN = bpe.ByteBpe.from_bytes(open(path("byte_bpe_50k.tiktoken"), "rb").read(), "tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=OWN.ranks, special_tokens={})
ODD = "ab1 \n\t'sdtmrevl.!é中　 ²٣’<|endoftext|>"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ODD, max_size=40) | st.text(max_size=20), max_size=5))
def test_bpe_equals_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, offsets = OWN.encode_batch(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == LIBRARY.encode_ordinary(t)
    assert OWN.decode_batch(ids, offsets) == [t.encode() for t in texts]


def test_bpe_long_and_json():
    rng = random.Random(0)
    for t in ("x" * 3000, "ab'" * 2000, " " * 2000 + "a", "".join(rng.choices("etahin", k=2500)), "'s 're'll\n's  's''s"):
        assert OWN.encode_batch([t])[0].tolist() == LIBRARY.encode_ordinary(t)
    assert bpe.ByteBpe.from_bytes(open(path("byte_bpe_50k.json"), "rb").read(), "json").ranks == OWN.ranks


def test_scan_composes_in_order():
    rng = np.random.default_rng(0)
    for n in (1, 255, 256, 257, 5000):
        f = rng.integers(0, 256, n).astype(np.uint8)
        got, state = bpe.scan(f), [0, 1, 2, 3]
        for k in range(n):
            state = [f[k] >> (2 * s) & 3 for s in state]
            assert [got[k] >> (2 * s) & 3 for s in range(4)] == state


def test_bpe_in_spark(spark):
    table = docs(spark, [(None, None), (1, ""), (2, "it's  <|endoftext|>"), (2, "it's  <|endoftext|>"), (3, "z " * 50_000)])
    coded = bpe.encode(table, path("byte_bpe_50k.tiktoken"), decoded=True)
    got = {r.doc_id: r for r in coded.collect()}
    assert got[None].ids == [] and got[1].ids == [] and got[2].ids == LIBRARY.encode_ordinary("it's  <|endoftext|>")
    assert bytes(got[3].decoded) == b"z " * 50_000 and coded.count() == 5
    again = bpe.decode(coded.withColumn("ids", F.when(F.col("doc_id") > 1, F.col("ids"))), path("byte_bpe_50k.tiktoken"))
    assert {r.doc_id: bytes(r.decoded) for r in again.collect()}[1] == b""
    assert bpe.encode(table.limit(0), path("byte_bpe_50k.tiktoken")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_fills_bins(counts):
    slots = packing.plan(counts, 64)
    bins, seen = collections.defaultdict(list), collections.Counter()
    for length, lo, hi, first, at, each in slots:
        for rank in range(lo, hi):
            bins[first + (rank - lo) // each].append((at + (rank - lo) % each * length, length))
            seen[length, rank] += 1
    assert seen == {(n, r): 1 for n, c in counts.items() for r in range(c)}
    for content in bins.values():
        end = 0
        for at, length in sorted(content):
            assert at == end
            end += length
        assert end <= 64
    # As many bins as best-fit decreasing opens, one piece after another.
    rooms = []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= length
        else:
            rooms.append(64 - length)
    assert len(bins) == len(rooms)


def check_packed(rows, texts, capacity=1024):
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for i, parts in by_doc.items():
        ids, at = library.encode(texts[i] or "", add_special_tokens=False).ids + [2], 0
        for k, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            own = ids[at : at + r.length]
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(struct.pack(f"<{len(own)}I", *own)))
            assert k == 0 or r.length == capacity
            at += r.length
        assert at == len(ids)
    for content in by_bin.values():
        end = 0
        for at, length in sorted(content):
            assert at == end
            end += length
        assert end <= capacity


def test_packing_over_a_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op8_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    check_packed(rows, texts)
    assert len({r.sequence_id for r in rows}) <= 1.03 * sum(r.length for r in rows) / 1024 + 1


def test_full_pieces_need_no_rank_and_lots_are_bounded(spark):
    items = spark.range(4000).select(F.col("id").alias("uid"), F.when(F.col("id") % 4 > 0, 8).otherwise(3).cast("long").alias("length"))
    placed = packing.place(items.checkpoint(), 8, salt_rows=100)
    rows = placed.collect()
    assert len(rows) == 4000 and len({r.sequence_id for r in rows if r.length == 8}) == 3000 and {r.offset for r in rows if r.length == 8} == {0}
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(by_bin) == 3500 and all(sorted(b) in ([(0, 8)], [(0, 3), (3, 3)]) for b in by_bin.values())
    # No window holds full pieces, and a lot of others has no more than its rows on average.
    assert packing.salts_of({3: 1000, 5: 10, 7: 0}, 100) == {3: 10, 5: 1}
    huge = packing.salts_of({n: 10**9 for n in range(1, 1024)})
    assert sum(huge.values()) <= packing.MOST_SALTS + 1023 and min(huge.values()) > 60


def test_packing_edges(spark):
    table = docs(spark, [(None, None), (1, ""), (2, "a " * 3000), (3, "<|endoftext|> x"), (4, " " * 5000)])
    check_packed(packing.pack(table, path("byte_bpe_50k.json"), salt_rows=1, added=True).collect(), {None: None, 1: "", 2: "a " * 3000, 3: "<|endoftext|> x", 4: " " * 5000})
    assert packing.pack(docs(spark, [(5, "b"), (5, "b")]), path("byte_bpe_50k.json")).count() == 2
    assert packing.pack(table.limit(0), path("byte_bpe_50k.json")).count() == 0
    kept = packing.pieces(table, path("byte_bpe_50k.json"), keep_ids=True).filter("doc_id = 1").first()
    assert kept.ids == [2]


def test_long_white_space_falls_back(monkeypatch):
    def fails(*_, **__):
        raise ValueError("too much")

    monkeypatch.setattr(packing, "_library", lambda name: type("L", (), {"encode_to_numpy": fails}))
    monkeypatch.setattr(packing, "loaded", lambda name: OWN)
    assert packing.ids_of("v", "it's  x").tolist() == LIBRARY.encode_ordinary("it's  x")


JSON = bpe.ByteBpe.from_bytes(open(path("byte_bpe_50k.json"), "rb").read(), "json")
MARKED = ["<|endoftext|> x", "a <|endoftext|>  x", "<|endoftext|><|endoftext|>", "foo  <|endoftext|>'s", "<|endoftext|", "plain", "", "<|endoftext|>" * 1500, " " * 5000 + "<|endoftext|>"]


def test_packing_gives_added_tokens_as_the_librarys_defaults_do(spark, tmp_path):
    """Both queries that pack, over texts with the literal of an added token."""
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = {}
    for i, text in enumerate(MARKED):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k] = (a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])))
    table = docs(spark, list(enumerate(MARKED)), extra=False)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    for rows in (queries.op8_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, table, "")):
        assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows.collect()} == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(ODD, max_size=8) | st.just("<|endoftext|>"), max_size=6).map("".join))
def test_added_tokens_also_where_the_fast_library_gives_up(text):
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))

    def fails(*a, **k):
        raise ValueError

    with pytest.MonkeyPatch.context() as m:
        m.setattr(packing, "_library", lambda name: type("L", (), {"encode_to_numpy": fails}))
        m.setattr(packing, "loaded", lambda name: JSON)
        assert packing.ids_of("v", text, added=True).tolist() == library.encode(text, add_special_tokens=False).ids


def test_shards_are_even_and_steady():
    names = sharding.SHARDS
    table = sharding.fill_table(names)
    share = collections.Counter(table)
    assert len(share) == len(names) and max(share.values()) - min(share.values()) <= 1
    without = sharding.fill_table(names[:-1])
    moved = sum(a != b for a, b in zip(table, without))
    assert moved < 0.25 * len(table)
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            sharding.fill_table(bad)
    with pytest.raises(ValueError):
        sharding.fill_table(names, 65_536)
    # Brute force: turns written out shard by shard over whole permutations.
    small, size = ("a", "b", "c"), 13
    import hashlib

    owner = [None] * size
    orders = []
    for n in small:
        d = hashlib.md5(n.encode()).digest()
        orders.append([(int.from_bytes(d[:8], "big") + k * (int.from_bytes(d[8:], "big") % (size - 1) + 1)) % size for k in range(size)])
    turn = 0
    while None in owner:
        owner[next(s for s in orders[turn % 3] if owner[s] is None)] = turn % 3
        turn += 1
    assert sharding.fill_table(small, size) == owner


def test_shards_in_spark(spark, tmp_path):
    table = docs(spark, [(None, "x"), (1, "y"), (1, "y"), (2, None)]).withColumn("Shard", F.lit("old"))
    got = sharding.assign_shards(table)
    assert got.count() == 4 and got.filter("shard is null").count() == 0 and len({r.shard for r in got.filter("doc_id = 1").collect()}) == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Python" not in plan and "Arrow" not in plan
    sharding.write_shards(table, str(tmp_path / "out"), parts=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4 and sharding.assign_shards(table.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage against brute force on what its predecessor kept."""
    sf = "/root/testdata/sf0.001"
    given_docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    frame = given_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, frame, sf).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        assert set(frame.columns) == set(given_docs.columns)
        kept[name] = {r.doc_id: r for r in frame.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good, bad = ([i in kept["quality"] for i, q in labels.items() if q == x] for x in (1, 0))
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.5
    first = {}
    for i in sorted(kept["quality"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept["quality"][i].text), i)
    assert set(kept["exact"]) == set(first.values())
    links = brute_links([(i, r.text) for i, r in kept["exact"].items()], 5, 80)
    assert set(kept["near"]) == {i for i, (_, c) in links.items() if c == i}
    removed = brute_removed([(i, r.text) for i, r in kept["near"].items()], 20)
    assert {i: " ".join(r.text.split()) for i, r in kept["substrings"].items()} == {i: t for i, (_, _, t) in removed.items()}
    assert all(r.n_chars == len(r.text) for r in kept["substrings"].values())
    rows = corpus_pipeline.run(spark, sf).collect()
    check_packed(rows, {i: r.text for i, r in kept["substrings"].items()})


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, columns in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    table = spark.createDataFrame([(1, long), (2, long), (3, long + " x"), (4, "short one"), (5, None)], "doc_id long, text string")
    once = corpus_pipeline.exact(spark, table, "")
    assert sorted(r.doc_id for r in once.collect()) == [1, 3, 4, 5]
    near = corpus_pipeline.near(spark, once, "")
    assert sorted(r.doc_id for r in near.collect()) == [1, 4, 5]
    cut = corpus_pipeline.substrings(spark, table.withColumn("n_chars", F.length("text").cast("long")), "")
    assert {r.doc_id: r.n_chars for r in cut.collect()} == {1: len(long), 2: 0, 3: 1, 4: 9, 5: None}


def test_stages_take_columns_of_any_names(spark):
    """Also of those that the operators use within, nulls and repeats included."""
    names = ["one", "group", "n_words", "n_removed", "data", "kept", "row", "id", "of_id", "sha", "node", "component_id", "__id", "__of", "__sha", "__maybe", "__cell", "__bucket", "__bits", "a.b", "place", "n_chars"]
    rows = [(i, f"{i % 4} " + " ".join(f"w{k}" for k in range(60)), *[None if i % 5 == 0 else f"{i}-{n}" for n in names]) for i in range(12)] + [(None, None, *names), (3, "", *names), (3, "", *names)]
    table = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, table, "")
        assert out.columns == table.columns, name
        got = out.collect()
        assert got, name
        for r in got:
            if r["doc_id"] is not None and r["doc_id"] != 3:
                assert [r[n] for n in names[:-1]] == [None if r["doc_id"] % 5 == 0 else f"{r['doc_id']}-{n}" for n in names[:-1]], name
    model = corpus_pipeline.quality_gam.train(table, spark.createDataFrame([], "doc_id long, quality int"))
    assert corpus_pipeline.quality_gam.keep_good(table, model, 0.4).columns == table.columns


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from tessera.llm import common

    made = []
    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: made[-1] if made else None, getConf=lambda: {}, setCheckpointDir=made.append)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(SimpleNamespace(sparkContext=context))
    context.master = "local[4]"
    assert common.shared_folder(SimpleNamespace(sparkContext=context)) == made[0]
