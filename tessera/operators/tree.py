"""Snapshots of folder trees whose comparison descends only where folders' hashes differ.

A snapshot is a folder with ``entries``: of every folder its files and folders with their hashes, partitioned by a
hash of the folder's path, so that what is in a few folders is read from a few partitions. A folder's hash is the
digest of its entries; equal hashes mean equal trees, and such folders are never opened. A change of some files
rewrites the hashes of their folders up to the root, from the entries of those folders alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..shared import checkpointed
from .sync import entry_digest, folder_hashes

PARTS = 64
ENTRIES = "parent string, name string, kind string, hash string, part int"
Save = Callable[[DataFrame], DataFrame]


def _parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.substring(path, F.lit(1), F.length(path) - F.length(X.base_name(path)) - 1)).otherwise(F.lit(""))


def _joined(parent: Column, name: Column) -> Column:
    return F.when(parent == "", name).otherwise(F.concat(parent, F.lit("/"), name))


def _level(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


@dataclass(frozen=True)
class Snapshot:
    spark: SparkSession
    folder: str
    parts: int = PARTS

    @staticmethod
    def write(files: DataFrame, folder: str, digest=F.md5, parts: int = PARTS) -> Snapshot:
        """A snapshot of ``files`` (path, hash) in a new folder. Paths have no empty parts."""
        out = Snapshot(files.sparkSession, f"{folder}/{uuid.uuid4().hex}", parts)
        depth = files.agg(F.max(_level(F.col("path")))).first()[0] or 0
        folders = folder_hashes(files, max(0, depth - 1), digest).filter("path <> ''") if depth > 1 else files.limit(0)
        rows = files.select("path", "hash", F.lit("f").alias("kind")).unionByName(folders.select("path", "hash", F.lit("d").alias("kind")))
        out._rows(rows).repartition("part").sortWithinPartitions("part", "parent", "name").write.partitionBy("part").parquet(f"{out.folder}/entries")
        return out

    def _part(self, parent: Column) -> Column:
        return F.pmod(F.xxhash64(parent), F.lit(self.parts)).cast("int")

    def _rows(self, rows: DataFrame) -> DataFrame:
        """Entries from (path, kind, hash)."""
        parent = _parent(F.col("path"))
        return rows.select(parent.alias("parent"), X.base_name(F.col("path")).alias("name"), "kind", "hash", self._part(parent).alias("part"))

    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRIES).parquet(f"{self.folder}/entries")

    def of(self, folders: DataFrame) -> DataFrame:
        """The entries of some folders (path); the only partitions that are read are theirs, of which there are ``parts`` at most."""
        parts = [r[0] for r in folders.select(self._part(F.col("path")).alias("p")).distinct().collect()]
        wanted = folders.select(F.col("path").alias("parent")).distinct()
        return self.entries().filter(F.col("part").isin(parts)).join(wanted, "parent", "left_semi")

    def files(self) -> DataFrame:
        return self.entries().filter("kind = 'f'").select(_joined(F.col("parent"), F.col("name")).alias("path"), "hash")

    def folder_hashes(self, digest=F.md5) -> DataFrame:
        """(path, hash) of every folder; the root's is that of its entries."""
        rows = self.entries().filter("kind = 'd'").select(_joined(F.col("parent"), F.col("name")).alias("path"), "hash")
        root = entry_digest(self.of(self.spark.createDataFrame([("",)], "path string")), digest).select(F.col("parent").alias("path"), "hash")
        return rows.unionByName(root)


def compare(old: Snapshot, new: Snapshot, save: Save = checkpointed) -> DataFrame:
    """(path, status) of files that were added, removed or modified. Folders of equal hashes are not opened.

    The folders to open are a table, first the root; a step opens all of one level. ``save`` materialises a level.
    """
    spark = new.spark
    left, found = spark.createDataFrame([("",)], "path string"), []
    while True:
        was = old.of(left).select("parent", "name", "kind", F.col("hash").alias("was"))
        now = new.of(left).select("parent", "name", "kind", F.col("hash").alias("is"))
        both = save(was.join(now, ["parent", "name", "kind"], "full_outer").filter(~F.col("was").eqNullSafe(F.col("is"))).select(_joined(F.col("parent"), F.col("name")).alias("path"), "kind", "was", "is"))
        status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("modified")
        found.append(both.filter("kind = 'f'").select("path", status.alias("status")))
        left = both.filter("kind = 'd'").select("path")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)


def changed_entries(snapshot: Snapshot, changes: DataFrame, digest=F.md5, save: Save = checkpointed) -> DataFrame:
    """(path, kind, hash) of all entries that ``changes`` (path, hash; null for a removed file) alter: files, and the
    folders above them. A folder without entries is gone, so its hash is null. Only folders above changed files are read."""
    files = changes.select("path", F.lit("f").alias("kind"), "hash")
    deepest = files.agg(F.max(_level(F.col("path")))).first()[0] or 0
    done, told = [files], files
    for level in range(deepest - 1, -1, -1):
        # Folders of this level with an altered entry: what they had, without it, and what it is now.
        here = told.filter(_level(F.col("path")) == level + 1)
        folders = here.select(_parent(F.col("path")).alias("path")).distinct()
        kept = snapshot.of(folders).select("parent", "name", "kind", "hash").join(here.select(_parent(F.col("path")).alias("parent"), X.base_name(F.col("path")).alias("name"), "kind"), ["parent", "name", "kind"], "left_anti")
        now = kept.unionByName(here.filter(F.col("hash").isNotNull()).select(_parent(F.col("path")).alias("parent"), X.base_name(F.col("path")).alias("name"), "kind", "hash"))
        hashes = entry_digest(now, digest)
        made = save(folders.join(hashes.select(F.col("parent").alias("path"), "hash"), "path", "left").select("path", F.lit("d").alias("kind"), "hash"))
        done.append(made)
        told = files.unionByName(made)
    return reduce(DataFrame.unionByName, done)


def update(snapshot: Snapshot, changes: DataFrame, digest=F.md5, save: Save = checkpointed) -> DataFrame:
    """Changes a snapshot in place by ``changes`` (path, hash; null for a removed file) and returns what was altered, the root as "".

    Only the partitions of folders above changed files are written anew.
    """
    altered = save(changed_entries(snapshot, changes, digest, save))
    rows = snapshot._rows(altered.filter("path <> ''"))
    parts = [r[0] for r in rows.select("part").distinct().collect()]
    kept = snapshot.entries().filter(F.col("part").isin(parts)).join(rows.select("part", "parent", "name", "kind"), ["part", "parent", "name", "kind"], "left_anti")
    whole = save(kept.select("parent", "name", "kind", "hash", "part").unionByName(rows.filter(F.col("hash").isNotNull())))
    # A partition that loses all of its rows is written as one without any.
    empty = [p for p in parts if p not in {r[0] for r in whole.select("part").distinct().collect()}]
    for p in empty:
        place = snapshot.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{snapshot.folder}/entries/part={p}")
        place.getFileSystem(snapshot.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    whole.repartition("part").sortWithinPartitions("part", "parent", "name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{snapshot.folder}/entries")
    return altered
