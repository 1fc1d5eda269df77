"""Splitting by syntax, token caps, hashing trees, keeping an index in sync, providers and spans."""

import datetime as dt
import logging
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera import observe
from tessera.operators import chunking, search, syntax
from tessera.operators.matching import glob_join, overlap_join
from tessera.sources import embedding, files, indexer
from tessera.sources.store import Store
from tessera.streaming import jobs
from tessera.workspace import Workspace

T0 = dt.datetime(2024, 1, 1, 12)

SERVICE = """import { api } from './api';

class UserService {
  private apiUrl = '/users/';

  constructor(private http: Http) {
    this.http = http;
    this.ready = true;
  }

  async getUser(id: string, options: { deep: boolean } = { deep: true }) {
    const pattern = /[}/]"{/g;
    return fetch(`${this.apiUrl}${id}`, { method: 'GET' });
  }

  handler = () => {
    return 1;
  };
}

const add = (a: number, b: number) =>
  a + b

function plain() { return "}" }
"""


def test_typescript_members_and_statements():
    got = [(c.chunk_type, c.name, c.parent_name, c.start_line, c.end_line) for c in chunking.PARSERS["typescript"](SERVICE)]
    assert got == [
        ("module_header", None, None, 1, 3), ("function", "constructor", "UserService", 6, 9), ("function", "getUser", "UserService", 11, 14), ("definition", "handler", "UserService", 16, 18),
        ("variable", None, None, 21, 22), ("function", "plain", None, 24, 24),
    ]
    assert chunking.PARSERS["typescript"](SERVICE)[1].content.startswith("class UserService {\n    constructor(")


@pytest.mark.parametrize("language", sorted(syntax.GRAMMARS))
def test_broken_and_empty_source(language):
    split = chunking.PARSERS[language]
    assert split("") == [] and split(" \n") == []
    assert [c.chunk_type for c in split("@@@ nothing here\n")] == ["module_body"]
    for text in ("function f( {", "func f( {", "fn f( {", "class A { m() {", '"unclosed', "/* open", "}}}}", "`", "impl X {", "type T struct {", "export", "const"):
        assert "".join(c.content for c in split(text)).replace(" ", "").replace("\n", "") >= ""
    assert split("x" * 100_000 + "\n" + "{" * 5000)


def test_go_and_rust():
    go = "package m\n\nfunc (t *T) Run() error {\n\tx := '}'\n\treturn nil\n}\n\ntype (\n\tA int\n)\n"
    assert [(c.chunk_type, c.name, c.start_line, c.end_line) for c in chunking.PARSERS["go"](go)] == [("module_header", None, 1, 3), ("function", None, 3, 6), ("type", None, 8, 10)]
    rust = "#[derive(Debug)]\npub struct P<'a> {\n    x: &'a str,\n}\n\nimpl<T: Into<X>> From<T> for P<'_> {\n    fn from(t: T) -> Self {\n        let c = '{';\n        P\n    }\n    fn short() {}\n}\n"
    assert [(c.chunk_type, c.name, c.parent_name) for c in chunking.PARSERS["rust"](rust)] == [("module_header", None, None), ("struct", "P", None), ("function", "from", "P")]


def test_python_that_does_not_parse():
    text = "import os\n\ndef ok(a):\n    return a\n\nclass K:\n    @deco\n    def m(self):\n        x = 1\n        return x\n\n@d\nasync def b(:\n    pass\nx = 1\n"
    got = [(c.chunk_type, c.name, c.parent_name, c.start_line, c.end_line) for c in chunking.split_python(text)]
    assert got == [("module_header", None, None, 1, 3), ("function", "ok", None, 3, 4), ("definition", "m", "K", 7, 10), ("definition", "b", None, 12, 14), ("module_body", None, None, 14, 16)]


class Tokens:
    """Two for a character that isn't white space."""

    def __call__(self, text):
        return sum(1 if c.isspace() else 2 for c in text)


def test_token_cap(spark):
    count, dense = Tokens(), "x" * 600
    pieces = chunking.capped(chunking.Chunk(dense, 1, 1), 1000, count, 200)
    assert len(pieces) > 1 and all(count(p.content) <= 200 for p in pieces) and "".join(p.content for p in pieces) == dense
    assert all(len(p.content) <= 5000 for p in chunking.capped(chunking.Chunk("x" * 50_000, 1, 1), 5000, None, 200))
    rows = spark.createDataFrame([("p", "f.bin", "unknown", "y" * 800)], "project string, file_path string, language string, text string")
    found = [r.content for r in chunking.source_chunks(rows, cap=10_000, tokens=count, most=200).collect()]
    assert len(found) > 1 and all(count(c) <= 200 for c in found)
    assert embedding.token_counter("made-up") is None and embedding.token_counter("all-minilm:latest") is None  # no network


def test_levels_of_literal_beginnings(spark):
    names = ["", "a", "src/a.py", "src/auth/login.py", "x" * 100, "src/[odd].py"]
    patterns = ["*", "src/*", "src/auth/*", "src/a.py", "s?c/a.py", "x" * 90 + "*", "[s]rc/*", "", "src/[odd].py", "src/[[]odd].py"]
    import fnmatch

    n = spark.createDataFrame([(x,) for x in names], "name string")
    p = spark.createDataFrame([(x,) for x in patterns], "pattern string")
    want = {(a, b) for a in names for b in patterns if fnmatch.fnmatchcase(a, b)}
    assert {(r.name, r.pattern) for r in glob_join(n, p, "name", "pattern").collect()} == want
    both = {(a, b) for a in names for b in patterns if fnmatch.fnmatchcase(a, b) or fnmatch.fnmatchcase(b, a)}
    got = [(r.name, r.pattern) for r in overlap_join(n, p, "name", "pattern").collect()]
    assert set(got) == both and len(got) == len(both)


def test_products_find_the_same_as_distances(spark):
    """Ties, equal rows and few rows included."""
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.integers(0, 3, (700, 4)) / 2.0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>")
    queries = rows.filter("id % 50 = 0").selectExpr("id query_id", "embedding")
    got = {}
    for r in search.top_k_each(rows.repartition(5), queries, 12).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    for q in range(0, 700, 50):
        score = np.round(1 / (1 + ((v - v[q]) ** 2).sum(1)), 9)
        want = sorted(range(700), key=lambda i: (-score[i], i))[:12]
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, score[i]) for i in want]
    assert search.top_k_each(rows.limit(3), queries.limit(2), 12).count() == 6


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, text in {"a.py": "def a():\n    return 1\n", "sub/b.py": "def b():\n    return 2\n", ".venv/x.py": "no", "sub/dist/y.py": "no", "raw.bin": "z", ".hid/h.py": "h"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


def test_hashing_a_tree(spark, tree):
    import xxhash

    got = {r.path: r.hash for r in files.scan_hashes(spark, tree).collect()}
    assert set(got) == {"a.py", "sub/b.py", "raw.bin", ".hid/h.py"} and got["raw.bin"] == xxhash.xxh3_64_hexdigest(b"z")
    assert files.scan_hashes(spark, tree, frozenset({"sub"})).filter("path like 'sub/%'").count() == 0
    os.remove(f"{tree}/raw.bin")
    assert files._digest(f"{tree}/raw.bin", "xxh3") is None
    assert [p for p, _ in files.listing(f"{tree}/nowhere")] == []


class Failing(embedding.HashProvider):
    def embed_batch(self, texts):
        raise ConnectionError("down")


def test_sync_follows_the_tree_and_failures_lose_nothing(spark, tree, tmp_path):
    work = Workspace(spark, str(tmp_path / "w"), embedding.HashProvider())
    first = work.sync_once("p", tree)
    assert first["changed"] == ["a.py", "sub/b.py"] and work.index_status("p")["chunk_count"] == 2
    assert work.sync_once("p", tree) == {"project": "p", "changed": [], "removed": [], "chunks_dropped": 0}
    Path(tree, "a.py").write_text("def a():\n    return 3\n")
    os.remove(f"{tree}/sub/b.py")
    with pytest.raises(Exception, match="down"):
        indexer.index_files(work.store, tree, "p", ["a.py"], Failing())
    assert work.index_status("p")["chunk_count"] == 2
    assert work.sync_once("p", tree) == {"project": "p", "changed": ["a.py"], "removed": ["sub/b.py"], "chunks_dropped": 1}
    assert [r.content.endswith("return 3") for r in work.store.read("code_p").collect()] == [True]
    work.index_branch(tree, "p", "x", ["a.py"])
    assert work.cleanup_branch("p", "x", reindex_base=True, root=tree) == {"project": "p", "branch": "x", "dropped": True, "reindex_status": "indexed"}
    assert work.clear_index("p")["status"] == "cleared" and files.load_snapshot(spark, work.store.snapshots, "p") is None


def test_sync_starts_with_the_first_search(spark, tree, tmp_path):
    work = Workspace(spark, str(tmp_path / "w"), embedding.HashProvider(), roots={"p": tree}, every=1)
    assert not work.syncs
    work.search_code("x")
    try:
        assert set(work.syncs) == {"p"}
        running = work.syncs["p"]
        work.search_code("x")
        assert work.syncs["p"] is running
        for _ in range(120):
            if work.index_status("p")["chunk_count"] == 2:
                break
            time.sleep(0.5)
        assert work.index_status("p")["chunk_count"] == 2
    finally:
        work.stop_sync()
    assert not work.syncs


def test_rounds_go_on_after_a_failure(spark, caplog):
    calls = []

    def work():
        calls.append(1)
        if len(calls) == 1:
            raise ValueError("once")

    running = jobs.every(spark, work, "200 milliseconds")
    for _ in range(100):
        if len(calls) > 2:
            break
        time.sleep(0.2)
    running.stop()
    assert len(calls) > 2


def test_heartbeat_coordinates_once(spark, tmp_path):
    work = Workspace(spark, str(tmp_path / "w"), embedding.HashProvider())
    work.lock_acquire(T0, "other", "p", ["b.py"])
    done = work.auto_coordinate(T0, "me", "p", ["a.py", "b.py"])
    assert done == {"status": "acquired", "locked": ["a.py"], "subscribed": 2}
    assert work.auto_coordinate(T0, "me", "p", ["b.py", "a.py"]) == {"status": "unchanged"}
    assert work.heartbeat(T0, "me", project="p", modified=["a.py", "c.py"]) == 1
    assert [r.file_patterns for r in work.lock_query(T0, "p").filter("agent_id = 'me'").collect()] == [["a.py", "c.py"]]


def test_notifications_are_read_exactly(spark, tmp_path):
    work = Workspace(spark, str(tmp_path / "w"), embedding.HashProvider())
    work.memory_subscribe(T0, "b", ["*"], "p")
    key = work.memory_store(T0, "note", "text", None, ["k"], "a.py", "h", None, "p", "a")["id"]
    assert work.memory_node(key)["content"] == "text" and work.memory_node("nope") is None
    assert len(work.memory_notifications(T0, "b")) == 1 and work.memory_notifications(T0, "b") == []
    assert work.embed_missing() == 0
    work.nodes.append(work.nodes.state().withColumn("embedding", F.lit(None)))
    assert work.embed_missing() == 1 and work.nodes.state().first().embedding is not None


def test_logs_are_compacted(spark, tmp_path):
    work = Workspace(spark, str(tmp_path / "w"), embedding.HashProvider())
    for minutes in range(3):
        work.lock_acquire(T0 + dt.timedelta(minutes=minutes), "a", "p", [f"f{minutes}.py"])
    work.lock_acquire(T0, "b", "p", ["z.py"])
    work.lock_release("b", "p")
    before = work.locks.state().collect()
    assert work.compact()["locks"] >= 5 and work.locks.state().collect() == before and work.locks.rows().count() == 1
    assert work.lock_acquire(T0, "c", "p", ["f2.py"])["status"] == "conflict" and work.lock_acquire(T0, "b", "p", ["z.py"])["status"] == "acquired"
    assert work.compact()["sessions"] == 0


def test_provider_asks_for_its_dimension(monkeypatch):
    import asyncio

    provider = embedding.HttpProvider("http://127.0.0.1:9", "m")
    monkeypatch.setattr(embedding.HttpProvider, "_post", lambda self, texts: [[1.0, 2.0, 3.0]] * len(texts))
    assert provider.dimension == 3 and asyncio.run(provider.aembed_batch(["a", "b"])) == [[1.0, 2.0, 3.0]] * 2


def test_store_checks_before_it_points(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", [1.0], 1)], "id string, embedding array<float>, ord int")
    store.upsert("c", rows, "ord")
    with pytest.raises(ValueError):
        store.upsert("c", rows.withColumn("embedding", F.lit(None).cast("array<float>")), "ord")
    store.upsert("c", rows.withColumn("id", F.lit("b")), "ord", without=rows)
    assert [r.id for r in store.read("c").collect()] == ["b"]
    assert len(list((tmp_path / "s" / "data").iterdir())) == 2


def test_spans_hide_content(spark, caplog):
    caplog.set_level(logging.INFO, "tessera")
    with pytest.raises(KeyError), observe.span(spark, "search", query="a secret", k=3):
        raise KeyError
    assert "secret" not in caplog.text and observe.hash_content("a secret") in caplog.text and '"status": "KeyError"' in caplog.text
