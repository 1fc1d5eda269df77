"""Logs by day, trees listed by executors and buckets of the store: results, what is read, and what is left alone."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import coordination
from tessera.sources import daylog, files, walk
from tessera.sources.store import BUCKETS, Store, bucket

COLUMNS = "seq long, agent_id string, project string, acquired_at timestamp"
START = dt.datetime(2024, 3, 1)


def partitions_read(df):
    """How many partitions each file scan of a plan that has run has read."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            if node.metrics().contains("numPartitions"):
                out.append(node.metrics().apply("numPartitions").value())
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return out


# -- logs


@pytest.fixture()
def log(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"a{rng.randint(0, 9)}", rng.choice("pq"), START + dt.timedelta(minutes=rng.randint(0, 40 * 24 * 60))) for i in range(800)]
    made = daylog.DayLog(spark, str(tmp_path), COLUMNS, "acquired_at")
    made.append(spark.createDataFrame(rows[:500], COLUMNS))
    made.append(spark.createDataFrame(rows[500:], COLUMNS))
    return made, rows


def test_a_time_reads_its_days_only(spark, log):
    made, rows = log
    since = START + dt.timedelta(days=38, hours=5)
    got = made.rows(F.lit(since))
    assert sorted(r.seq for r in got.collect()) == sorted(r[0] for r in rows if r[3] >= since)
    assert all(n <= 3 for n in partitions_read(got)) and partitions_read(got)


def test_locks_in_force_equal_those_of_the_whole_log(spark, log):
    made, rows = log
    now = F.lit(START + dt.timedelta(days=40))
    got = daylog.locks_in_force(made, now, 600)
    want = coordination.lock_state(spark.createDataFrame(rows, COLUMNS), now, 600)
    assert sorted(map(tuple, got.select("agent_id", "project", "seq").collect())) == sorted(map(tuple, want.select("agent_id", "project", "seq").collect()))
    assert all(n <= 2 for n in partitions_read(got.select("agent_id", "project", "seq"))) or not partitions_read(got)


def test_states_come_from_the_snapshot_and_the_days_after(spark, log):
    made, rows = log
    keys, order = ["agent_id", "project"], ["acquired_at", "seq"]
    want = sorted(map(tuple, coordination.latest(spark.createDataFrame(rows, COLUMNS), keys, order).collect()))
    assert sorted(tuple(r[c] for c in ("agent_id", "project", "seq", "acquired_at")) for r in made.state(keys, order).collect()) == want
    for day in (10, 35, 20):
        made.snapshot(keys, order, (START + dt.timedelta(days=day)).date())
        state = made.state(keys, order)
        assert sorted(tuple(r[c] for c in ("agent_id", "project", "seq", "acquired_at")) for r in state.collect()) == want
    assert max(partitions_read(state)) <= 6
    # A snapshot that was never finished doesn't count.
    os.makedirs(f"{made.folder}/state/agent_id-project/upto=2025-01-01")
    assert made.state(keys, order).count() == len(want)


def test_the_newest_rows_read_the_last_days(spark, log):
    made, rows = log
    got = made.newest(30, F.desc("seq"))
    assert [r.seq for r in got.collect()] == [r[0] for r in sorted(rows, key=lambda r: (r[3], r[0]), reverse=True)[:30]]
    assert max(partitions_read(got)) <= 4
    assert made.newest(10_000, F.desc("seq")).count() == 800


def test_an_empty_log(spark, tmp_path):
    none = daylog.DayLog(spark, str(tmp_path / "none"), COLUMNS, "acquired_at")
    assert none.rows().count() == 0 and none.newest(5).count() == 0 and none.state(["agent_id"], ["seq"]).count() == 0


# -- trees


@pytest.fixture()
def root(spark, tmp_path):
    made = {f"src/p{i % 3}/f{i}.py": f"x{i}" for i in range(40)} | {
        ".gitignore": "*.log\nsecret/\nsrc/p1/f4.*\n", "a.log": "x", "secret/k.py": "x", "node_modules/m.js": "x", ".hid/z.py": "x", "pkg/__init__.py": "", "README.MD": "# r\n", "d.bin": "x", "big.txt": "x" * (files.LARGEST + 1),
    }
    rows = spark.createDataFrame(sorted(made.items()), "path string, text string")
    assert walk.write_tree(rows, str(tmp_path)) == len(made)
    os.symlink(tmp_path / "src", tmp_path / "link")
    return str(tmp_path)


def test_walks_find_what_the_driver_finds(spark, root):
    got = {r.path: r.bytes for r in walk.walk(spark, root, extensions=set(X.LANGUAGES)).collect()}
    assert got == dict(files.listing(root)) and "src/p1/f4.py" not in got and len(got) == 41
    scanned = {tuple(r) for r in walk.scan_tree(spark, root, "p", ["README*"]).collect()}
    assert scanned == {tuple(r) for r in files.scan_files(spark, root, "p", ["README*"]).collect()}
    assert {tuple(r) for r in walk.hashes(spark, root).collect()} == {tuple(r) for r in files.scan_hashes(spark, root).collect()}


def test_ignored_folders_are_never_listed(spark, root):
    os.chmod(f"{root}/secret", 0)
    levels = []

    def save(df):
        levels.append(df.cache())
        return levels[-1]

    walk.walk(spark, root, save=save).collect()
    seen = {r.path for df in levels for r in df.filter("folder").collect()}
    assert seen == {"src", "src/p0", "src/p1", "src/p2", "pkg"} and len(levels) == 3
    os.chmod(f"{root}/secret", 0o755)


def test_memory_files_are_found_by_pattern(spark, tmp_path):
    made = {"p/memory/a.md": "---\ntype: note\nname: n\n---\nbody", "q/memory/b.md": "plain", "q/memory/deep/c.md": "x", "q/other/d.md": "x", "memory/e.md": "x", "p/memory/f.txt": "x"}
    walk.write_tree(spark.createDataFrame(sorted(made.items()), "path string, text string"), str(tmp_path))
    got = {r.path: (r.node_type, r.content) for r in files.front_matter(walk.memory_files(spark, str(tmp_path))).collect()}
    assert got == {"p/memory/a.md": ("note", "body"), "q/memory/b.md": ("memory", "plain")}
    assert walk.memory_files(spark, str(tmp_path / "nowhere")).count() == 0


# -- the store


def test_changes_rewrite_only_their_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit("v1").alias("content"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"), F.lit(1).alias("ord"))
    store.upsert("c", rows, "ord")
    folders = lambda: {b: v for b, v in store._current("c")[0].items()}
    before = folders()
    assert len(before) == BUCKETS
    one = rows.filter("id = '17'")
    mine = one.select(bucket()).first()[0]
    store.upsert("c", one.withColumn("content", F.lit("v2")), "ord")
    after = folders()
    assert {b for b in before if before[b] != after[b]} == {mine}
    assert store.read("c").filter("content = 'v2'").count() == 1 and store.count("c") == 200
    store.delete("c", one.select("id"))
    assert {b for b in after if after[b] != folders()[b]} == {mine} and store.count("c") == 199
    last = folders()
    store.delete("c", spark.createDataFrame([("nobody",)], "id string"))
    assert folders() == last
    store.delete_where("c", F.col("content") == "v1")
    assert store.count("c") == 0 and store.read("c").columns == ["id", "content", "embedding"]
    store.upsert("c", one, "ord")
    assert [r.id for r in store.read("c").collect()] == ["17"]
