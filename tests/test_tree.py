"""Tree snapshots: comparison and updates against flat ones, and what they read."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import sync, tree

FILES = "path string, hash string"


def frame(spark, files):
    return spark.createDataFrame(sorted(files.items()), FILES)


def made(seed, n=120):
    rng = random.Random(seed)
    files = {}
    for _ in range(n):
        path = "/".join([rng.choice("abc") for _ in range(rng.randint(0, 4))] + [f"f{rng.randint(0, 30)}"])
        files[path] = f"h{rng.randint(0, 3)}"
    return files


def altered(files, seed):
    rng = random.Random(seed)
    out = dict(files)
    for path in rng.sample(sorted(files), 8):
        out[path] = "changed"
    gone = rng.choice([p for p in files if "/" in p]).rsplit("/", 1)[0] + "/"
    out = {p: h for p, h in out.items() if not p.startswith(gone)}
    return out | {"new/deep/er/x": "n", "a/f99": "n"}


def flat(old, new):
    return sorted((p, "added" if p not in old else "removed" if p not in new else "modified") for p in {*old, *new} if old.get(p) != new.get(p))


def hashes(spark, files):
    depth = max((p.count("/") for p in files), default=0)
    return {r.path: r.hash for r in sync.folder_hashes(frame(spark, files), depth).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_compare_and_update(spark, tmp_path, seed):
    files = made(seed)
    later = altered(files, seed)
    old, new = (tree.Snapshot.write(frame(spark, f), str(tmp_path), parts=8) for f in (files, later))
    assert sorted(tuple(r) for r in tree.compare(old, new).collect()) == flat(files, later)
    assert sorted(tuple(r) for r in tree.compare(new, old).collect()) == flat(later, files)
    assert {r.path: r.hash for r in old.folder_hashes().collect()} == hashes(spark, files)
    changes = spark.createDataFrame([(p, later.get(p)) for p, _ in flat(files, later)], FILES)
    told = {r.path: r.hash for r in tree.update(old, changes).filter("kind = 'd'").collect()}
    want = hashes(spark, later)
    assert {r.path: r.hash for r in old.folder_hashes().collect()} == want
    assert {r.path: r.hash for r in old.files().collect()} == later and old.entries().count() == new.entries().count()
    before = hashes(spark, files)
    assert told[""] == want[""] and {p for p in {*before, *want} if before.get(p) != want.get(p)} <= told.keys() and all(want.get(p) == h for p, h in told.items())
    assert tree.compare(old, new).count() == 0


def test_a_file_in_place_of_a_folder(spark, tmp_path):
    a, b = {"x/y": "1", "z": "1"}, {"x": "1", "z/y": "1"}
    old, new = (tree.Snapshot.write(frame(spark, f), str(tmp_path)) for f in (a, b))
    assert sorted(tuple(r) for r in tree.compare(old, new).collect()) == flat(a, b)


def test_empty_trees(spark, tmp_path):
    none = tree.Snapshot.write(spark.createDataFrame([], FILES), str(tmp_path))
    some = tree.Snapshot.write(frame(spark, {"a/b": "1"}), str(tmp_path))
    assert tree.compare(none, none).count() == 0
    assert [tuple(r) for r in tree.compare(none, some).collect()] == [("a/b", "added")] and [tuple(r) for r in tree.compare(some, none).collect()] == [("a/b", "removed")]


def test_unchanged_folders_are_not_opened(spark, tmp_path):
    files = {f"d{i}/e{j}/f{k}": "h" for i in range(20) for j in range(5) for k in range(10)}
    later = files | {"d3/e1/f7": "other"}
    old, new = (tree.Snapshot.write(frame(spark, f), str(tmp_path), parts=64) for f in (files, later))
    opened = []

    def save(df):
        df = df.cache()
        opened.append(df.count())
        return df

    seen = []
    of = tree.Snapshot.of

    class Watched(tree.Snapshot):
        def of(self, folders):
            rows = of(self, folders)
            seen.append(rows.count())
            return rows

    found = tree.compare(Watched(spark, old.folder), Watched(spark, new.folder), save)
    assert [tuple(r) for r in found.collect()] == [("d3/e1/f7", "modified")]
    # The root's 20 folders, d3's five and e1's ten files, of each snapshot, and of each level what differs.
    assert seen == [20, 20, 5, 5, 10, 10] and opened == [1, 1, 1]
    plan = old.of(spark.createDataFrame([("d3/e1",)], "path string"))
    parts = plan.select(F.col("part")).distinct().count()
    assert parts == 1 and "PartitionFilters: [isnotnull(part" in plan._jdf.queryExecution().executedPlan().toString() or "part#" in plan._jdf.queryExecution().executedPlan().toString()
