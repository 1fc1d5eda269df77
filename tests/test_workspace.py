"""All tools of a workspace, one after another, as agents would call them."""

import datetime as dt

import pytest

from tessera.sources.embedding import HashProvider
from tessera.workspace import Workspace

T0 = dt.datetime(2024, 1, 1, 12)


def later(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture
def space(spark, tmp_path):
    return Workspace(spark, str(tmp_path / "space"), HashProvider())


def test_code(spark, space, tmp_path):
    root = tmp_path / "code"
    root.mkdir()
    (root / "a.py").write_text("def first():\n    x = 1\n    return x\n")
    (root / "b.py").write_text("import a\n\n\ndef second():\n    y = first()\n    return y\n")
    assert space.search_code("x").count() == 0 and space.find_symbol("first") is None
    assert space.index_codebase(str(root), "p")["chunk_count"] == 3
    assert space.index_status("p")["file_count"] == 2
    assert [r.file_path for r in space.find_symbol("first").collect()] == ["a.py"]
    assert {r.file_path for r in space.dependents("first", "a.py", 2).collect()} == {"b.py"}
    assert {r.matched_term for r in space.change_impact(["a.py"], ["second"]).collect()} >= {"a.py"}
    (root / "a.py").write_text("def first():\n    x = 2\n    return x\n")
    assert space.index_branch(str(root), "p", "feat/x", ["a.py"]) == 1
    assert [tuple(r) for r in space.branches("p").collect()] == [("feat--x", 1)]
    shown = space.search_code("first", "p", branch="feat/x").collect()
    assert [r.snippet for r in shown if r.file_path == "a.py"] == ["# a.py (L1-L3)\ndef first():\n    x = 2\n    return x"] and space.find_similar_code("x").count() == 4
    assert {r.kind for r in space.merge_impact(T0, "p", ["a.py"]).collect()} == {"overlay"}
    assert space.cleanup_branch("p", "feat/x")["dropped"] and not space.cleanup_branch("p", "feat/x")["dropped"]
    assert space.clear_index("p")["status"] == "cleared"


def test_memory(spark, space):
    assert [tuple(r) for r in space.memory_subscribe(T0, "bravo", ["src/*.py"], "p").collect()] == [("bravo", "p", "src/*.py")]
    assert space.memory_subscribe(T0, "bravo", ["src/*.py"], "p").count() == 0
    key = space.memory_store(T0, "note", "The engine restarts twice", None, ["k"], "src/engine.py", "h1", "1-2", "p", "alpha")["id"]
    space.memory_store(later(1), "pattern", "Another thing", agent="bravo")
    with pytest.raises(ValueError):
        space.memory_store(T0, "note", "x", file_path="a.py")
    first = space.memory_search("engine restarts").first()
    assert first.id == key and space.memory_search("engine restarts", node_type="pattern").filter("node_type = 'note'").count() == 0
    assert [r.agent_id for r in space.memory_feed(later(2), "bravo").collect()] == ["alpha"]
    assert [r.file_path for r in space.memory_notifications(later(2), "bravo")] == ["src/engine.py"]
    assert space.memory_notifications(later(3), "bravo") == [] and space.memory_notifications(later(3), "alpha") == []
    now = spark.createDataFrame([("src/engine.py", "h2")], "file_path string, hash string")
    assert [r.current_hash for r in space.stale_check(now).collect()] == ["h2"]
    assert space.memory_promote(later(4), key)["status"] == "promoted" and space.nodes.state().filter(f"id = '{key}' and project_path is null").count() == 1
    assert space.lock_acquire(T0, "alpha", "p", ["src/*"], "feat/x")["status"] == "acquired"
    done = space.notify_merge(later(5), "p", "feat/x", ["src/engine.py"])
    assert done["notifications_created"] == 1 and len(done["stale_anchors"]) == 1 and done["released_locks"] == 1
    assert space.anchors.state().filter("is_stale").count() == 1
    assert [r.agent_id for r in space.watchers_of("p", ["src/a.py"]).collect()] == ["bravo"]


def test_coordination(space):
    space.register(T0, "a", "p", "/w", "main")
    space.register(later(1), "a", "p", "/w", "feat")
    row = space.agents(later(2)).collect()
    assert [(r.agent_id, r.branch, r.status, r.connected_at) for r in row] == [("a", "feat", "active", T0)]
    assert space.agents(later(4)).first().status == "idle" and space.agents(later(60 * 30)).count() == 0
    assert space.lock_acquire(T0, "a", "p", ["src/auth/*"])["status"] == "acquired"
    refused = space.lock_acquire(T0, "b", "p", ["src/auth/login.py"])
    assert (refused["status"], refused["agent_id"]) == ("conflict", "a")
    assert space.lock_acquire(T0, "a", "p", ["src/auth/login.py"])["status"] == "acquired"
    assert space.lock_acquire(T0, "b", "q", ["src/auth/*"])["status"] == "acquired"
    assert [(r.agent_a, r.agent_b) for r in space.conflicts(T0).collect()] == [("a", "b")]
    assert space.lock_query(T0, "p", "src/auth/login.py").count() == 1 and space.lock_query(T0, "p", "lib/x").count() == 0
    assert space.lock_query(later(61), "p").count() == 0
    assert space.heartbeat(later(61), "a") == 1 and space.lock_query(later(70), "p").count() == 1
    assert space.lock_release("a", "p")["count"] == 1 and space.lock_release("a", "p")["count"] == 0
    counts = {r.metric: r.value for r in space.stats(T0).collect()}
    assert counts["active_locks"] == 1 and counts["memory_nodes"] == 0
    assert space.prune(later(61 + 10)) == 1 and space.agents(later(72)).count() == 0


class CountingProvider(HashProvider):
    """Notes every text that it embeds in a file."""

    def __init__(self, path):
        self.path = path

    def embed_batch(self, texts):
        with open(self.path, "a") as f:
            f.write("x\n" * len(texts))
        return super().embed_batch(texts)


def test_indexing_embeds_behind_the_cache(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name in ("a", "b"):
        (tmp_path / "src" / f"{name}.py").write_text("def same():\n    return 1\n")
    (tmp_path / "src" / "c.py").write_text("def other():\n    return 2\n")
    calls = tmp_path / "calls"
    calls.touch()
    count = lambda: len(calls.read_text().split())
    work = Workspace(spark, str(tmp_path / "store"), CountingProvider(str(calls)))
    done = work.index_codebase(str(tmp_path / "src"), "p")
    texts = work.store.read("code_p").select("id", "content", "embedding").collect()
    distinct = len({r.content for r in texts})
    assert count() == distinct <= done["chunk_count"]
    for r in texts:
        assert list(r.embedding) == pytest.approx(HashProvider().embed_batch([r.content])[0])
    assert work.index_codebase(str(tmp_path / "src"), "p", force=True) == done and count() == distinct
    (tmp_path / "src" / "c.py").write_text("def third():\n    return 3\n")
    assert [(r.chunks, r.error) for r in work.index_files(str(tmp_path / "src"), "p", ["c.py"]).collect()] == [(1, None)]
    assert count() == distinct + 1
    assert work.clear_embedding_cache() == {"status": "cleared"} and work.store.cached().count() == 0
    assert work.index_codebase(str(tmp_path / "src"), "p", force=True)["chunk_count"] == done["chunk_count"] and count() == 2 * distinct + 1
