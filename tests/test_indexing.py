"""Indexing reads every file once, over many tasks, and holds a bounded part of a batch."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.shared import PIECE_BYTES
from tessera.sources import embedding, indexer, walk
from tessera.sources.store import Store


class Calls:
    """A token counter that notes each call in a file, and can take a tree away at its first."""

    def __init__(self, log, gone=None):
        self.log, self.gone = str(log), gone

    def __call__(self, text):
        with open(self.log, "a") as f:
            f.write("x")
        if self.gone:
            shutil.rmtree(self.gone, ignore_errors=True)
        return 1


@pytest.fixture()
def tree(spark, tmp_path):
    root = str(tmp_path / "tree")
    walk.write_tree(spark.range(450).select(F.concat(F.lit("d/f"), "id", F.lit(".md")).alias("path"), F.concat(F.lit("text "), "id").alias("text")), root)
    return root


def test_every_file_is_split_once(spark, tree, tmp_path):
    store, log = Store(spark, str(tmp_path / "s")), tmp_path / "log"
    caps = indexer.Caps(tokens=Calls(log), most_tokens=1)
    assert indexer.index_codebase(store, tree, "p", embedding.HashProvider(), caps=caps)["chunk_count"] == 450
    assert len(log.read_text()) == 450
    got = indexer.index_files(store, tree, "p", ["d/f1.md", "d/f2.md", "nope.md"], embedding.HashProvider(), caps)
    assert sorted((r.path, r.chunks, r.error is None) for r in got.collect()) == [("d/f1.md", 1, True), ("d/f2.md", 1, True), ("nope.md", 0, False)]
    assert len(log.read_text()) == 452 and store.count("code_p") == 450


def test_a_file_is_split_before_the_rest_of_its_batch_is_read(spark, tmp_path):
    root, store = tmp_path / "tree", Store(spark, str(tmp_path / "s"))
    root.mkdir()
    for i in range(5):
        Path(root, f"f{i}.md").write_text("x" * (PIECE_BYTES // 2 + 1))
    caps = indexer.Caps(tokens=Calls(tmp_path / "log", str(root)), most_tokens=1)
    got = indexer.index_files(store, str(root), "p", [f"f{i}.md" for i in range(5)], embedding.HashProvider(), caps).collect()
    # The paths are one batch; there are only the file that was split when the tree went, and the one that didn't go with it.
    assert sum(r.error is None and r.chunks > 0 for r in got) in (1, 2) and len(got) == 5


def test_files_of_one_folder_are_read_by_many_tasks(spark, tree):
    paths = walk.walk(spark, tree)
    assert paths.filter("path like 'd/%'").select(F.spark_partition_id()).distinct().count() == 1
    for made in (walk.texts(spark, tree, "p", paths), walk.hashes(spark, tree)):
        assert made.count() == 450 and made.select(F.spark_partition_id()).distinct().count() == 4


def test_files_without_chunks_and_with_bad_bytes(spark, tmp_path):
    root, store = tmp_path / "tree", Store(spark, str(tmp_path / "s"))
    root.mkdir()
    Path(root, "blank.md").write_text(" \n")
    Path(root, "bad.md").write_bytes(b"a\xffb")
    got = indexer.index_files(store, str(root), "p", ["blank.md", "bad.md"], embedding.HashProvider())
    assert sorted((r.path, r.chunks, r.error) for r in got.collect()) == [("bad.md", 1, None), ("blank.md", 0, None)]
    assert store.read("code_p").first().content.endswith("a�b")
    Path(root, "bad.md").write_text("")
    indexer.index_files(store, str(root), "p", ["bad.md"], embedding.HashProvider())
    assert store.count("code_p") == 0


def test_many_entries_of_a_folder_are_handed_on_in_parts(spark, tmp_path, monkeypatch):
    for i in range(25):
        Path(tmp_path, f"f{i}").write_text("x" * i)
    Path(tmp_path, "d").mkdir()
    want = {(f"f{i}", i) for i in range(25)}
    monkeypatch.setattr(walk, "ENTRIES_AT_ONCE", 10)
    assert {(r.path, r.bytes) for r in walk.walk(spark, str(tmp_path)).collect()} == want


def test_sync_hands_on_tables(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    changed, removed, dropped = indexer.sync(store, tree, "p", embedding.HashProvider())
    assert changed.count() == 450 and removed.count() == 0 and dropped == 0
    Path(tree, "d/f7.md").write_text("other")
    Path(tree, "d/f8.md").unlink()
    changed, removed, dropped = indexer.sync(store, tree, "p", embedding.HashProvider())
    assert [r.path for r in changed.collect()] == ["d/f7.md"] and [r.path for r in removed.collect()] == ["d/f8.md"] and dropped == 1
    assert store.count("code_p") == 449
