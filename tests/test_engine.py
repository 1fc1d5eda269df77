"""Memory, coordination, sync, sources and the store on small literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import coordination, memory, search, stats, sync
from tessera.sources import embedding, files, indexer
from tessera.sources.store import Store

T0 = dt.datetime(2024, 1, 1, 12)


def now_():
    return F.lit(T0)


def at(minutes):
    return T0 - dt.timedelta(minutes=minutes)


def locks(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, agent_id string, project string, pattern string, acquired_at timestamp, branch string")


def test_lock_conflicts_expiry_and_own(spark):
    log = locks(spark, [("a", "p", "src/auth/*", at(5), "x"), ("b", "p", "old/*", at(120), "x"), ("b", "p", "lib/*.py", at(3), "x"), ("c", "q", "src/*", at(90), "x")])
    state = coordination.lock_state(log, now_())
    assert sorted((r.agent_id, r.pattern) for r in state.collect()) == [("a", "src/auth/*"), ("b", "lib/*.py")]
    wanted = spark.createDataFrame([("a", "p", "src/auth/login.py"), ("d", "p", "src/auth/login.py"), ("e", "p", "src/api/*")], "wanted_agent string, project string, wanted_pattern string")
    granted, conflicts = coordination.acquire(log, wanted, now_())
    assert [(r.wanted_agent, r.agent_id) for r in conflicts.collect()] == [("d", "a")]
    assert sorted(r.agent_id for r in granted.collect()) == ["a", "e"]
    assert coordination.release(state, "a", "p").count() == 1
    assert coordination.heartbeat(state, "a", now_()).filter(F.col("expires_at") > now_() + F.expr("INTERVAL 7 HOURS")).count() == 1


def test_notifications(spark):
    subs = spark.createDataFrame([("bravo", "p", "src/*.py"), ("bravo", "p", "src/e*"), ("alpha", "p", "src/*.py"), ("z", "other", "*")], "agent_id string, project string, file_pattern string")
    changed = spark.createDataFrame([("p", "src/engine.py", "alpha")], "project string, file_path string, author string")
    assert sorted(r.file_pattern for r in coordination.notify(subs, changed).collect()) == ["src/*.py", "src/e*"]
    assert coordination.subscribe_new(subs, subs.limit(1)).count() == 0
    notes = spark.createDataFrame([(1, "b", at(1), None), (2, "b", at(2), at(1)), (3, "c", at(1), None)], "id long, subscriber_agent_id string, created_at timestamp, read_at timestamp")
    assert [r.id for r in coordination.unread(notes, "b").collect()] == [1]
    assert coordination.unread(coordination.mark_read(notes, "b", now_()), "b").count() == 0
    assert [r.id for r in stats.latest_notifications(notes, 2).collect()] == [3, 1]


def test_sessions(spark):
    seen = spark.createDataFrame([("a", at(1)), ("b", at(3)), ("c", at(10)), ("d", at(3000)), ("a", at(50))], "agent_id string, seen_at timestamp")
    got = coordination.sessions(seen, now_())
    assert [(r.agent_id, r.status) for r in got.collect()] == [("a", "active"), ("b", "idle"), ("c", "disconnected")]
    assert coordination.pruned(got).count() == 2
    known = spark.createDataFrame([("a", "p", "main", at(60), at(50), "idle")], "agent_id string, project string, branch string, connected_at timestamp, last_activity_at timestamp, status string")
    again = spark.createDataFrame([("a", "p", "feat", at(1), at(1), "active")], known.schema)
    row = coordination.register(known, again).collect()
    assert len(row) == 1 and row[0].branch == "feat" and row[0].connected_at == at(60)
    held = spark.createDataFrame([("a", "p")], "agent_id string, pattern string")
    assert {r.agent_id: r.has_lock for r in stats.agents_view(got, held, "A").collect()} == {"a": True}


def test_fusion_and_recall(spark):
    nodes = spark.createDataFrame([(1, "note", "The quick brown fox", None, False), (2, "note", "Jumps over the lazy dog", "a fox", False), (3, "pattern", "fox", None, True)], "id long, node_type string, content string, summary string, archived boolean")
    assert [r.id for r in memory.phrase_hits(nodes, "fox").collect()] == [1, 2]
    assert memory.phrase_hits(nodes, "cat").count() == 0
    phrase = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    vector = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    assert [(r.id, r.score) for r in memory.fused(phrase, vector).collect()] == [(2, 1.5), (1, 1.0), (3, 0.5)]
    feed = nodes.withColumns({"agent_id": F.when(F.col("id") == 1, "me"), "created_at": now_(), "project_path": F.lit("p")})
    assert [r.id for r in memory.feed(feed, now_(), "me").collect()] == [2]
    anchors = spark.createDataFrame([(1, 1, "a.py", "h"), (2, 2, "gone.py", "h")], "anchor_id long, memory_id long, file_path string, stored_hash string")
    now = spark.createDataFrame([("a.py", "h")], "file_path string, hash string")
    assert [(r.anchor_id, r.current_hash) for r in memory.stale_anchors(anchors, nodes, now).collect()] == [(2, "<missing>")]
    assert [r.id for r in memory.unembedded(nodes, spark.createDataFrame([(1,)], "id long")).collect()] == [2]
    new = spark.createDataFrame([(9, "note", "c", "", ["k", "l"], "a.py", "1-2")], "id long, node_type string, content string, summary string, keywords array<string>, file_path string, line_range string")
    stored = memory.store(nodes, new).filter("id = 9").first()
    assert (stored.summary, stored.keywords, stored.archived) == ("c", "k,l", False)
    assert memory.anchors_for(new, now).first().line_end == 2
    assert memory.promote(nodes.withColumn("project_path", F.lit("p")), 1, None).filter("project_path is null").count() == 1


def test_overlay(spark):
    rows = spark.createDataFrame([(1, "code_p__b", "src/a.py", [0.0]), (2, "code_p", "src/a.py", [0.1]), (3, "code_p", "src/b.py", [0.2]), (4, "code_p", None, [0.3])], "id long, collection string, file_path string, embedding array<float>")
    assert [r.id for r in search.overlay_search(rows, [0.0], "code_p", "code_p__b").collect()] == [1, 3, 4]
    with pytest.raises(search.DimensionMismatch):
        search.check_dimension(8, 4, "m", "c")
    assert search.clamp(1000) == 100 and search.clamp(0) == 1


def test_dependents_skip_the_definition(spark):
    rows = spark.createDataFrame([("1", "code_p", "a.py", "foo", "def foo"), ("2", "code_p", "b.py", "bar", "calls foo"), ("3", "code_p", "c.py", "baz", "calls bar"), ("4", "memory", "d", "x", "foo")], "id string, collection string, file_path string, name string, content string")
    got = search.dependents(spark, rows, "foo", "a.py", 9)
    assert sorted((r.id, r.depth) for r in got.collect()) == [("2", 1), ("3", 2)]
    assert search.impact_terms(["a/b.py", ".env"], ["s"]) == ["b.py", "b", ".env", ".env", "s"]
    assert search.change_impact(rows, []).count() == 0


def test_sync(spark):
    old = spark.createDataFrame([("src/a.py", "1"), ("lib/c.py", "1"), ("k", "1")], "path string, hash string")
    new = spark.createDataFrame([("src/a.py", "2"), ("tests/t.py", "1"), ("k", "1")], "path string, hash string")
    diff = sync.tree_diff(old, new)
    assert sorted(map(tuple, diff.collect())) == [("lib/c.py", "removed"), ("src/a.py", "modified"), ("tests/t.py", "added")]
    assert {r.top: (r.changed, r.removed) for r in sync.by_top_folder(diff).collect()}["lib"] == ([], ["lib/c.py"])
    a, b = ({r.path: r.hash for r in sync.folder_hashes(x, 1).collect()} for x in (old, new))
    assert a[""] != b[""] and set(a) == {"", "src", "lib"}
    moves = spark.createDataFrame([(1, "a", "b", "moved", T0), (2, "c", None, "modified", T0)], "event_id long, path string, to_path string, kind string, ts timestamp")
    assert sorted((r.path, r.kind) for r in sync.pending(sync.file_moves(moves)).collect()) == [("a", "deleted"), ("b", "created"), ("c", "modified")]
    chunks = spark.createDataFrame([(1, "a"), (2, None)], "id long, file_path string")
    assert [r.id for r in sync.orphans(chunks, spark.createDataFrame([("a",)], "file_path string")).collect()] == [2]


@pytest.fixture
def tree(tmp_path):
    for path, text in {".gitignore": "*.log\nsecret/\n# c\n", "a.py": "def f():\n    x = 1\n    return x\n", "b.log": "x", "sub/__init__.py": "y = 1\n", "secret/k.py": "k = 1\n", "node_modules/m.js": "x", "c.bin": "x", ".hid/z.py": "z"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return str(tmp_path)


def test_scan_index_and_reconcile(spark, tree, tmp_path_factory):
    import os

    got = {r.file_path: r.language for r in files.scan_files(spark, tree, "p").collect()}
    assert got == {"a.py": "python", "sub/__init__.py": "python"}
    store, provider = Store(spark, str(tmp_path_factory.mktemp("store"))), embedding.HashProvider()
    assert indexer.index_status(store, "p")["status"] == "not_indexed"
    assert indexer.index_codebase(store, tree, "p", provider)["chunk_count"] == 2
    result = stats.index_result(indexer.index_files(store, tree, "p", ["a.py", "nope.py"], provider)).first()
    assert (result.succeeded, result.failed) == (1, 1) and "nope.py" in result.errors
    assert indexer.index_branch(store, tree, "p", "code_p__b", ["a.py"], provider) == 1
    os.remove(f"{tree}/a.py")
    assert indexer.reconcile(store, tree, "p")["orphans_removed"] == 1
    assert indexer.clear_index(store, "p")["status"] == "cleared" and not store.has("code_p")
    assert files.changed_files(tree, "nope") == []


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("dup", "v1", [1.0], 1), ("dup", "v2", [1.0], 2), ("distinct", "d", [2.0], 3)], "id string, content string, embedding array<float>, ord int")
    store.upsert("c", rows, "ord")
    assert sorted((r.id, r.content) for r in store.read("c").collect()) == [("distinct", "d"), ("dup", "v2")]
    with pytest.raises(search.DimensionMismatch):
        store.upsert("c", rows.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")), "ord")
    with pytest.raises(ValueError):
        store.upsert("c", rows.withColumn("embedding", F.lit(None).cast("array<float>")), "ord")
    store.delete_where("c", F.col("content") == "d")
    assert store.count("c") == 1
    store.validate(1)
    with pytest.raises(search.DimensionMismatch):
        store.validate(2)
    store.drop("c")
    assert store.count("c") == 0 and store.collections().count() == 0


def test_snapshots_and_front_matter(spark, tmp_path):
    folder = str(tmp_path / "snap")
    assert files.load_snapshot(spark, folder, "p") is None
    rows = spark.createDataFrame([("a", "1")], "path string, hash string")
    files.save_snapshot(rows, folder, "p")
    assert files.load_snapshot(spark, folder, "p").collect() == [("a", "1")] and files.load_snapshot(spark, folder, "q") is None
    texts = spark.createDataFrame([(1, "---\ntype: note\nname: 'n'\n---\n body \n"), (2, "plain"), (3, "body"), (4, "--- x")], "ord int, text string")
    got = {r.ord: (r.node_type, r.summary, r.content) for r in files.front_matter(texts).collect()}
    assert got == {1: ("note", "n", "body"), 2: ("memory", None, "plain"), 3: ("memory", None, "body"), 4: ("memory", None, "--- x")}
    fresh = files.new_memories(files.front_matter(texts), spark.createDataFrame([("plain",)], "content string"), "ord")
    assert sorted(r.ord for r in fresh.collect()) == [1, 4]


def test_embedding_cache_and_halving(spark):
    calls = []

    def embed(texts):
        calls.append(len(texts))
        if len(texts) > 1 or len(texts[0]) > 2:
            raise embedding.TextTooLong
        return [[float(len(texts[0]))]]

    assert embedding.halved(embed, ["abc", "x"]) == [[1.5], [1.0]]
    rows = spark.createDataFrame([(1, "t"), (2, "t"), (3, "u")], "id int, content string")
    empty = spark.createDataFrame([], "content_hash string, provider string, embedding array<float>")
    first, fresh = embedding.embed_cached(rows, empty, embedding.HashProvider())
    assert first.filter("hit").count() == 0 and fresh.count() == 2
    again, more = embedding.embed_cached(rows, fresh, embedding.HashProvider())
    assert again.filter("hit").count() == 3 and more.count() == 0


def test_settings_history_and_coordination(spark, tree, tmp_path_factory):
    import os

    from tessera.config import Config

    assert Config.from_env({"TESSERA_CHUNK_SIZE": "10"}).chunk_size == 10 and Config.from_env({}).lock_ttl_minutes == 60
    samples = spark.range(100).select(F.lit("m").alias("metric"), F.col("id").alias("taken_at"))
    assert stats.recent_history(samples).agg(F.min("taken_at")).first()[0] == 40
    assert stats.as_json(samples.limit(1)).first().value == '{"metric":"m","taken_at":0}'
    log = locks(spark, [("other", "p", "src/*", at(1), "main")])
    subs = spark.createDataFrame([("me", "p", "b.py")], "agent_id string, project string, file_pattern string")
    modified = spark.createDataFrame([("src/a.py",), ("b.py",)], "path string")
    held, new = coordination.auto_coordinate(log, subs, modified, "me", "p", now_())
    # Another's lock keeps a file back only if it names it; one that matches it doesn't, as with the workspace's tool.
    assert sorted(r.pattern for r in held.collect()) == ["b.py", "src/a.py"] and [r.file_pattern for r in new.collect()] == ["src/a.py"]
    named = locks(spark, [("other", "p", "b.py", at(1), "main")])
    held, _ = coordination.auto_coordinate(named, subs, modified, "me", "p", now_())
    assert [r.pattern for r in held.collect()] == ["src/a.py"]
    os.makedirs(f"{tree}/.git")
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    assert list(indexer.index_repositories(store, os.path.dirname(tree), embedding.HashProvider())) == [os.path.basename(tree)]
