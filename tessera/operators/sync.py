"""Snapshots of file hashes: differences, folder hashes, orphans, pending changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of paths that were added, removed or modified between two snapshots (path, hash)."""
    both = old.select("path", F.col("hash").alias("was")).join(new.select("path", F.col("hash").alias("is")), "path", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "modified")
    return both.select("path", status.alias("status")).filter(F.col("status").isNotNull())


def entry_digest(entries: DataFrame, digest=F.md5) -> DataFrame:
    """(parent, hash) of folders from their entries (parent, name, kind, hash): files first, then folders, each by name."""
    lines = F.struct(F.when(F.col("kind") == "f", 0).otherwise(1).alias("o"), "name", F.concat_ws(":", "kind", "name", "hash").alias("line"))
    return entries.groupBy("parent").agg(digest(F.array_join(F.transform(F.array_sort(F.collect_list(lines)), lambda e: e["line"]), "")).alias("hash"))


def folder_hashes(files: DataFrame, depth: int, digest=F.md5) -> DataFrame:
    """(path, hash) of every folder, the root as "": a digest of its sorted entries, from the deepest level up.

    ``depth`` is the number of folder levels, a bound on the loop; each level is one aggregation.
    """
    level_of = lambda p: F.size(F.split(p, "/"))
    entries = files.select("path", F.lit("f").alias("kind"), "hash", level_of(F.col("path")).alias("level"))
    out = None
    for level in range(depth + 1, 0, -1):
        here = entries.filter(F.col("level") == level)
        parent = F.when(F.lit(level == 1), F.lit("")).otherwise(F.substring_index("path", "/", level - 1))
        made = entry_digest(here.select(parent.alias("parent"), X.base_name(F.col("path")).alias("name"), "kind", "hash"), digest).withColumnRenamed("parent", "path")
        out = made if out is None else out.unionByName(made)
        if level > 1:
            entries = entries.filter(F.col("level") < level).unionByName(made.select("path", F.lit("d").alias("kind"), "hash", F.lit(level - 1).alias("level")))
    return out


def orphans(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks whose file is not there; a chunk without a file is one."""
    return chunks.join(files.select("file_path").distinct(), "file_path", "left_anti")


def without_files(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    return chunks.join(gone.select("file_path").distinct(), "file_path", "left_anti")


def changed_only(chunks: DataFrame, changed: DataFrame) -> DataFrame:
    return chunks.join(changed.select("file_path").distinct(), "file_path", "left_semi")


def by_top_folder(diff: DataFrame) -> DataFrame:
    return diff.groupBy(X.top_folder(F.col("path")).alias("top")).agg(F.array_sort(F.collect_list(F.when(F.col("status") != "removed", F.col("path")))).alias("changed"), F.array_sort(F.collect_list(F.when(F.col("status") == "removed", F.col("path")))).alias("removed"))


def file_moves(events: DataFrame) -> DataFrame:
    """Events with a move as the removal of its source and the addition of its target (path, to_path, kind, ts)."""
    pairs = F.when(F.col("kind") == "moved", F.array(F.struct(F.col("path").alias("p"), F.lit("deleted").alias("k")), F.struct(F.col("to_path").alias("p"), F.lit("created").alias("k")))).otherwise(F.array(F.struct(F.col("path").alias("p"), F.col("kind").alias("k"))))
    return events.select(*[c for c in events.columns if c not in ("path", "to_path", "kind")], F.explode(pairs).alias("e")).select("*", F.col("e.p").alias("path"), F.col("e.k").alias("kind")).drop("e")


def pending(events: DataFrame, window: Column | None = None) -> DataFrame:
    """The last kind of each path; with ``window``, within each."""
    keys = ["path"] if window is None else [window.alias("window"), "path"]
    return events.groupBy(*keys).agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"))
