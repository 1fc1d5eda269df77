"""Listing trees level by level in executors: what is ignored is never opened, and no list of paths passes the driver."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..shared import PIECE_BYTES, checkpointed, pieces
from . import files

#: Folders that one task lists, and entries that it hands on at once.
FOLDERS_A_TASK, ENTRIES_AT_ONCE = 200, 5000
#: Files that one task reads, and so few that dealing them out further doesn't pay.
FILES_A_TASK, FEW_FILES = 2000, 100
_ENTRIES = "path string, folder boolean, bytes long"


def combined(patterns: list[str]) -> re.Pattern | None:
    """One expression for all patterns; None without any."""
    return re.compile("|".join(f"(?:{fnmatch.translate(p)})" for p in patterns)) if patterns else None


def _left_out(patterns: list[str]):
    """Whether patterns ignore a path, as files.ignored() has it, with each kind of them in one expression."""
    bare, whole = combined([p.rstrip("/") for p in patterns]), combined(patterns)

    def ignored(path: str, name: str, folder: bool) -> bool:
        return bool(patterns) and bool(bare.match(path) or bare.match(name) or whole.match(path + "/" * folder))

    return ignored


def _scanned(folder: str) -> Iterator[os.DirEntry]:
    """A folder's entries as they come, so a large folder isn't held; none of one that can't be read."""
    try:
        with os.scandir(folder) as entries:
            yield from entries
    except OSError:
        return


def walk(spark: SparkSession, root: str, patterns: list[str] | None = None, extensions: set[str] | None = None, hidden: bool = False, left_out: tuple[str, ...] = files.SKIPPED, largest: int | None = files.LARGEST, save=checkpointed) -> DataFrame:
    """(path, bytes) of the files below ``root``, which all executors can read.

    A level is a table of folders that are listed in parallel; a folder that ``left_out`` names, that is hidden
    (unless ``hidden``) or that the root's .gitignore or ``patterns`` ignore is not in it, so nothing below is
    ever listed. Links, files of other ``extensions`` (None: any), ignored and too large ones are left out, and
    folders that can't be read. ``save`` materialises a level.
    """
    ignored = _left_out((files.ignore_patterns(root) if not hidden else []) + (patterns or []))

    def one(folder: str):
        for e in _scanned(os.path.join(root, folder)):
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_dir(follow_symlinks=False):
                if e.name not in left_out and (hidden or not e.name.startswith(".")) and not ignored(path, e.name, True):
                    yield path, True, 0
            elif e.is_file(follow_symlinks=False) and e.name not in left_out and (extensions is None or Path(e.name).suffix.lower() in extensions) and not ignored(path, e.name, False):
                size = e.stat().st_size
                if largest is None or size <= largest:
                    yield path, False, size

    def listed(batches):
        for pdf in batches:
            entries = (x for folder in pdf["path"] for x in one(folder))
            while found := list(islice(entries, ENTRIES_AT_ONCE)):
                yield pd.DataFrame(found, columns=["path", "folder", "bytes"])

    level, found, folders = spark.createDataFrame([("",)], "path string"), [], 1
    while folders:
        entries = save(level.repartition(max(min(folders, spark.sparkContext.defaultParallelism), folders // FOLDERS_A_TASK)).mapInPandas(listed, _ENTRIES))
        found.append(entries.filter("not folder").select("path", "bytes"))
        level = entries.filter("folder").select("path")
        folders = level.count()
    return reduce(DataFrame.unionByName, found)


def dealt(paths: DataFrame) -> DataFrame:
    """A table of paths, which is counted, over as many tasks as reading their files takes, however the paths lay."""
    n = paths.count()
    return paths.select("path").repartition(max(1, min(paths.sparkSession.sparkContext.defaultParallelism, n // FEW_FILES), n // FILES_A_TASK), "path")


def read(root: str, paths: Iterable[str]) -> Iterator[list[tuple[str, str | None, str | None]]]:
    """(path, text, error) of files in lists of at most PIECE_BYTES, or of one larger file; bad bytes are replaced. One file is read ahead."""
    out, held = [], 0
    for p in paths:
        try:
            data, error = Path(root, p).read_bytes(), None
        except OSError as e:
            data, error = None, str(e)
        size = len(data or b"")
        if out and held + size > PIECE_BYTES:
            yield out
            out, held = [], 0
        out.append((p, None if data is None else data.decode("utf-8", "replace"), error))
        held += size
    if out:
        yield out


def texts(spark: SparkSession, root: str, project: str, paths: DataFrame) -> DataFrame:
    """(project, file_path, language, text, error) of a table of paths (path), read by executors; bad bytes are replaced."""

    def run(batches):
        for pdf in batches:
            for part in read(root, pdf["path"]):
                yield pd.DataFrame(part, columns=["file_path", "text", "error"])

    made = dealt(paths).mapInPandas(run, "file_path string, text string, error string")
    return made.select(F.lit(project).alias("project"), "file_path", X.language_of(F.col("file_path")).alias("language"), "text", "error")


def scan_tree(spark: SparkSession, root: str, project: str, patterns: list[str] | None = None, extensions: set[str] | None = None) -> DataFrame:
    """What files.scan_files() reads, with the tree listed by executors."""
    return texts(spark, root, project, walk(spark, root, patterns, extensions or set(X.LANGUAGES)))


def hashes(spark: SparkSession, root: str, digest: str = "xxh3") -> DataFrame:
    """(path, hash) of all files below ``root`` but those in folders that are never hashed; what can't be read is left out."""

    def run(batches):
        for pdf in batches:
            found = [(p, h) for p in pdf["path"] if (h := files._digest(os.path.join(root, p), digest)) is not None]
            yield pd.DataFrame(found, columns=["path", "hash"])

    paths = walk(spark, root, hidden=True, left_out=tuple(sorted(files.UNHASHED)), largest=None)
    return dealt(paths).mapInPandas(run, "path string, hash string")


def memory_files(spark: SparkSession, root: str, save=checkpointed) -> DataFrame:
    """(path, text) of the Markdown files in every project's folder ``memory`` below ``root``."""
    paths = walk(spark, root, extensions={".md"}, hidden=True, left_out=(), largest=None, save=save).filter(F.regexp_like("path", F.lit(r"^[^/]+/memory/[^/]+\.md$")))
    return texts(spark, root, "", paths.select("path")).filter(F.col("text").isNotNull()).select(F.col("file_path").alias("path"), "text")


def write_tree(rows: DataFrame, root: str) -> int:
    """Writes (path, text) as files below a folder that all executors share; how many. A file that is there is replaced."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                for path, text in zip(part.column("path").to_pylist(), part.column("text").to_pylist(), strict=True):
                    place = Path(root, path)
                    place.parent.mkdir(parents=True, exist_ok=True)
                    place.write_text(text or "")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return rows.select("path", "text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
