"""Reading trees of source files, ignore rules, snapshots and memory files."""

from __future__ import annotations

import fnmatch
import hashlib
import os
import subprocess
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from .store import remove

LARGEST = 1_048_576
# Folders that are never read.
SKIPPED = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".tox", "dist", "build", ".next", ".nuxt", "target", ".eggs", "*.egg-info",
)
# Names that are left out when a tree is hashed.
UNHASHED = frozenset(".git __pycache__ node_modules .venv venv .mypy_cache .pytest_cache .ruff_cache dist build .egg-info .tox .nox".split())
FILES_A_TASK = 500


def ignore_patterns(root: str) -> list[str]:
    """The lines of the root's .gitignore that are neither blank nor comments."""
    path = Path(root, ".gitignore")
    lines = path.read_text(errors="replace").splitlines() if path.is_file() else []
    return [s for line in lines if (s := line.strip()) and not s.startswith("#")]


def ignored(path: str, folder: bool, patterns: list[str]) -> bool:
    name = path.rsplit("/", 1)[-1]
    return any(fnmatch.fnmatch(path, p.rstrip("/")) or fnmatch.fnmatch(path + "/" * folder, p) or fnmatch.fnmatch(name, p.rstrip("/")) for p in patterns)


def listing(root: str, patterns: list[str] | None = None, extensions: set[str] | None = None) -> Iterator[tuple[str, int]]:
    """(relative path, bytes) of the files to index, in order; links, skipped and hidden folders and ignored paths are left out."""
    patterns = ignore_patterns(root) + (patterns or [])
    extensions = extensions or set(X.LANGUAGES)
    left = [""]
    while left:
        folder = left.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:  # a folder that can't be read is left out
            continue
        deeper = []
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_dir(follow_symlinks=False):
                if e.name not in SKIPPED and not e.name.startswith(".") and not ignored(path, True, patterns):
                    deeper.append(path)
            elif e.is_file(follow_symlinks=False) and Path(e.name).suffix.lower() in extensions and not ignored(path, False, patterns):
                size = e.stat().st_size
                if size <= LARGEST:
                    yield path, size
        left += reversed(deeper)


def scan_files(spark: SparkSession, root: str, project: str, patterns: list[str] | None = None, extensions: set[str] | None = None) -> DataFrame:
    """(project, file_path, language, text) of a tree that all executors can read at ``root``.

    The driver lists paths; executors read them, so no text passes through the driver. Unreadable files give a
    null text; bad bytes are replaced.
    """
    return read_paths(spark, root, project, sorted(p for p, _ in listing(root, patterns, extensions)))


def read_paths(spark: SparkSession, root: str, project: str, paths: list[str]) -> DataFrame:
    """The same for given paths, of any extension and size; ``error`` has what kept a file from being read."""
    listed = spark.createDataFrame([(p,) for p in paths], "file_path string").repartition(max(1, len(paths) // FILES_A_TASK))

    def run(batches):
        for pdf in batches:
            texts, errors = [], []
            for p in pdf.file_path:
                try:
                    texts.append(Path(root, p).read_bytes().decode("utf-8", "replace"))
                    errors.append(None)
                except OSError as e:
                    texts.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"file_path": pdf.file_path, "text": texts, "error": errors})

    read = listed.mapInPandas(run, "file_path string, text string, error string")
    return read.select(F.lit(project).alias("project"), "file_path", X.language_of(F.col("file_path")).alias("language"), "text", "error")


def tree_paths(root: str, left_out: frozenset[str] = UNHASHED) -> list[str]:
    """All files below ``root`` for hashing, in order; only names in ``left_out`` are passed over, at any level."""
    out = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f not in left_out)
        below = os.path.relpath(folder, root).replace(os.sep, "/")
        out += [n if below == "." else f"{below}/{n}" for n in names if n not in left_out and os.path.isfile(os.path.join(folder, n))]
    return sorted(out)


def scan_hashes(spark: SparkSession, root: str, left_out: frozenset[str] = UNHASHED, digest: str = "xxh3") -> DataFrame:
    """(path, hash) of a tree for tree_diff(): the driver lists names, executors read and hash; what can't be read is left out."""
    paths = tree_paths(root, left_out)
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths) // FILES_A_TASK))

    def run(batches):
        for pdf in batches:
            found = [(p, h) for p in pdf.path if (h := _digest(os.path.join(root, p), digest)) is not None]
            yield pd.DataFrame(found, columns=["path", "hash"])

    return listed.mapInPandas(run, "path string, hash string")


def _digest(path: str, digest: str) -> str | None:
    state = xxhash.xxh3_64() if digest == "xxh3" else hashlib.new(digest)
    try:
        with open(path, "rb") as f:
            while block := f.read(1 << 20):
                state.update(block)
    except OSError:
        return None
    return state.hexdigest()


def changed_files(root: str, branch: str, base: str = "main") -> list[str]:
    """Paths that a branch changed since it left ``base``; none where git can't tell."""
    done = subprocess.run(["git", "diff", "--name-only", f"{base}...{branch}"], cwd=root, capture_output=True, text=True, timeout=30)
    return [x for x in done.stdout.splitlines() if x.strip()] if done.returncode == 0 else []


SNAPSHOT = "path string, hash string, seq long, project string, snapshot string"


def _snapshots(spark: SparkSession, folder: str, project: str) -> DataFrame | None:
    try:
        return spark.read.schema(SNAPSHOT).parquet(folder).filter(F.col("project") == project)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def save_snapshot(files: DataFrame, folder: str, project: str) -> str:
    """Writes (path, hash) as the next snapshot of a project and returns its id; older ones stay readable."""
    known, snapshot = _snapshots(files.sparkSession, folder, project), uuid.uuid4().hex
    last = 0 if known is None else known.agg(F.max("seq")).first()[0] or 0
    files.withColumn("seq", F.lit(last + 1).cast("long")).write.parquet(f"{folder}/project={project}/snapshot={snapshot}")
    return snapshot


def load_snapshot(spark: SparkSession, folder: str, project: str) -> DataFrame | None:
    """The newest snapshot's (path, hash), or None if there is none."""
    rows = _snapshots(spark, folder, project)
    newest = None if rows is None else rows.agg(F.max_by("snapshot", "seq")).first()[0]
    return None if newest is None else rows.filter(F.col("snapshot") == newest).select("path", "hash")


def delete_snapshots(spark: SparkSession, folder: str, project: str) -> None:
    remove(spark, f"{folder}/project={project}")


def front_matter(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with node_type, summary and content from "---" front matter of key: value lines; content without it if there is a body."""
    value = F.col(text)
    has = value.startswith("---") & (F.size(F.split(value, "---", 3)) == 3)
    parts = F.split(value, "---", 3)
    lines = F.filter(F.split(F.trim(F.get(parts, F.lit(1))), "\n"), lambda x: x.contains(":"))

    def entry(line):
        key = F.trim(F.substring_index(line, ":", 1))
        raw = F.trim(F.substr(line, F.locate(":", line) + 1))
        return F.struct(key.alias("k"), F.regexp_replace(raw, "^['\"]+|['\"]+$", "").alias("v"))

    pairs = F.filter(F.transform(lines, entry), lambda e: (e["k"] != "") & (e["v"] != ""))
    # Of a key given twice, the last value counts.
    last = lambda key: F.get(F.reverse(F.filter(pairs, lambda e: e["k"] == key)), F.lit(0))["v"]
    body = F.regexp_replace(F.get(parts, F.lit(2)), r"^\s+|\s+$", "")
    meta = lambda key: F.when(has, last(key))
    return texts.withColumns({"node_type": F.coalesce(meta("type"), F.lit("memory")), "summary": F.coalesce(meta("description"), meta("name")), "content": F.when(has & (body != ""), body).otherwise(value)})


def new_memories(parsed: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Of memories with equal content the first by ``order``, without those whose content is stored (content) already."""
    own = parsed.withColumn("content_sha1", F.sha1("content"))
    first = own.groupBy("content_sha1").agg(F.min_by(F.struct(*own.columns), order).alias("r")).select("r.*")
    return first.join(existing.select(F.sha1("content").alias("content_sha1")), "content_sha1", "left_anti")
