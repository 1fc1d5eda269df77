"""Indexing a tree or a branch into the store: scan, split, embed behind the cache, upsert."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import LANGUAGES, language_of
from ..functions.hashing import xxh3_hex
from ..operators.chunking import CAP, CHUNKS, Chunk, columns_of, documents, split_source
from ..operators.sync import tree_diff
from ..shared import checkpointed
from . import walk
from .embedding import Provider, embed_cached
from .files import delete_snapshots, load_snapshot, save_snapshot
from .store import Store, remove


@dataclass(frozen=True)
class Caps:
    """Bounds of a chunk: characters, and tokens where ``tokens`` counts them (it is sent to executors)."""

    characters: int = CAP
    tokens: Callable[[str], int] | None = None
    most_tokens: int | None = None


#: A file that has no chunk, or that can't be read (error), is one row without a piece.
_SPLIT = f"file_path string, language string, error string, {CHUNKS}"


@contextmanager
def _split(store: Store, root: str, project: str, paths: DataFrame, collection: str, caps: Caps) -> Iterator[DataFrame]:
    """The chunks of files (path) with content_hash and error, as a table that is there inside ``with``.

    Executors read a file and split it in one go, a bounded number of bytes at once, so every file is read once and
    no text is handed from one Python process to another before it is split.
    """

    def run(batches):
        for batch in batches:
            names, languages = batch.column("file_path").to_pylist(), batch.column("language").to_pylist()
            language = dict(zip(names, languages, strict=True))
            for part in walk.read(root, names):
                rows = []
                for path, text, error in part:
                    found = [] if text is None else split_source(text, language[path], cap=caps.characters, tokens=caps.tokens, most=caps.most_tokens)
                    rows += [(path, error, numbered) for numbered in enumerate(found)] or [(path, error, (None, Chunk(None, None, None, None)))]
                own = {"file_path": [r[0] for r in rows], "language": [language[r[0]] for r in rows], "error": [r[1] for r in rows]}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) for k, v in own.items()} | columns_of([r[2] for r in rows]))

    read = walk.dealt(paths).select(F.col("path").alias("file_path"), language_of(F.col("path")).alias("language")).mapInArrow(run, _SPLIT)
    docs = documents(read.select(F.lit(project).alias("project"), "*")).withColumn("collection", F.lit(collection)).withColumn("project_name", F.col("project")).withColumn("content_hash", xxh3_hex(F.col("content")))
    made = f"{store.folder}/data/{uuid.uuid4().hex}"
    try:
        docs.write.parquet(made)
        yield store.spark.read.schema(docs.schema).parquet(made)
    finally:
        remove(store.spark, made)


def _chunks(store: Store, split: DataFrame, provider: Provider) -> DataFrame:
    """Chunks with vectors from the store's cache, which first gets those it doesn't have."""
    docs = split.filter(F.col("piece").isNotNull()).drop("error")
    store.cache(embed_cached(docs, store.cached(), provider)[1])
    # Only looked up: a filter on vectors would be pushed down to the provider's calls and make them again.
    known = store.cached().filter(F.col("provider") == provider.name).select("content_hash", "embedding")
    return docs.join(known, "content_hash", "left").select(*[c for c in docs.columns if c != "content_hash"], "embedding").withColumn("ord", F.col("piece"))


def index_codebase(store: Store, root: str, project: str, provider: Provider, force: bool = False, patterns: list[str] | None = None, extensions: set[str] | None = None, caps: Caps = Caps()) -> dict:
    """Indexes a tree into the project's base collection; one that exists stays as it is unless ``force``."""
    collection = f"code_{project}"
    if store.has(collection) and not force:
        return {"project": project, "status": "indexed", "chunk_count": store.count(collection)}
    store.drop(collection)
    store.create(collection, provider.dimension)
    with _split(store, root, project, walk.walk(store.spark, root, patterns, extensions or set(LANGUAGES)), collection, caps) as split:
        store.upsert(collection, _chunks(store, split, provider), "ord", provider.name)
    return {"project": project, "status": "indexed", "chunk_count": store.count(collection)}


def _paths(store: Store, paths: list[str] | DataFrame) -> DataFrame:
    return paths.select("path") if isinstance(paths, DataFrame) else store.spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string")


def index_files(store: Store, root: str, project: str, paths: list[str] | DataFrame, provider: Provider, caps: Caps = Caps()) -> DataFrame:
    """Replaces the chunks of given files (a list, or a table with path) in one new version; returns (path, chunks, error), and a file that fails stops no other.

    Where the provider fails, the collection stays as it was.
    """
    collection = f"code_{project}"
    store.create(collection, provider.dimension)
    with _split(store, root, project, _paths(store, paths), collection, caps) as split:
        files = checkpointed(split.groupBy("file_path").agg(F.count("piece").alias("chunks"), F.max("error").alias("error")))
        old = store.read(collection)
        gone = None if old is None else old.join(files.filter(F.col("error").isNull()), "file_path", "left_semi").select("id")
        store.upsert(collection, _chunks(store, split, provider), "ord", provider.name, gone)
    return files.select(F.col("file_path").alias("path"), "chunks", "error")


def drop_files(store: Store, project: str, paths: list[str] | DataFrame) -> int:
    """Deletes the chunks of files that are gone; how many."""
    collection = f"code_{project}"
    old = store.read(collection)
    gone = _paths(store, paths).withColumnRenamed("path", "file_path")
    if old is None or gone.isEmpty():
        return 0
    before = old.count()
    store.delete(collection, old.join(gone, "file_path", "left_semi").select("id"))
    return before - store.count(collection)


def sync(store: Store, root: str, project: str, provider: Provider, caps: Caps = Caps()) -> tuple[DataFrame, DataFrame, int]:
    """Brings a project's index up to its tree: hashes, compares with the last snapshot, re-indexes and drops what differs.

    Returns the paths that changed, those that are gone, and how many chunks were dropped. The snapshot is saved last,
    so what failed is tried again. Files that indexing wouldn't take are left alone.
    """
    now, old = checkpointed(walk.hashes(store.spark, root)), load_snapshot(store.spark, store.snapshots, project)
    empty = store.spark.createDataFrame([], "path string, hash string")
    diff = checkpointed(tree_diff(empty if old is None else old, now))
    indexable = walk.walk(store.spark, root, extensions=set(LANGUAGES)).select("path")
    changed = checkpointed(diff.filter("status <> 'removed'").join(indexable, "path", "left_semi").select("path"))
    removed = diff.filter("status = 'removed'").select("path")
    if not changed.isEmpty():
        index_files(store, root, project, changed, provider, caps)
    dropped = drop_files(store, project, removed)
    if old is None or not diff.isEmpty():
        save_snapshot(now, store.snapshots, project)
    return changed, removed, dropped


def sync_once(store: Store, root: str, project: str, provider: Provider, caps: Caps = Caps()) -> dict:
    """What sync() does, with a report that names the files."""
    changed, removed, dropped = sync(store, root, project, provider, caps)
    names = lambda df: sorted(r["path"] for r in df.collect())
    return {"project": project, "changed": names(changed), "removed": names(removed), "chunks_dropped": dropped}


def index_branch(store: Store, root: str, project: str, branch_collection: str, changed: list[str], provider: Provider, caps: Caps = Caps()) -> int:
    """Indexes a branch's changed files into its overlay; the number of chunks."""
    if not changed:
        return 0
    only = walk.walk(store.spark, root, extensions=set(LANGUAGES)).join(_paths(store, changed), "path", "left_semi")
    with _split(store, root, project, only, branch_collection, caps) as split:
        rows = _chunks(store, split, provider)
        if rows.isEmpty():
            return 0
        store.create(branch_collection, provider.dimension)
        store.upsert(branch_collection, rows, "ord", provider.name)
    return store.count(branch_collection)


def index_status(store: Store, project: str) -> dict:
    rows = store.read(f"code_{project}")
    if rows is None:
        return {"project": project, "status": "not_indexed", "file_count": 0, "chunk_count": 0}
    n = rows.agg(F.count_distinct("file_path").alias("files"), F.count("*").alias("chunks")).first()
    return {"project": project, "status": "indexed", "file_count": n["files"], "chunk_count": n["chunks"]}


def clear_index(store: Store, project: str) -> dict:
    """Drops the base collection, not overlays, and forgets the snapshots."""
    store.drop(f"code_{project}")
    delete_snapshots(store.spark, store.snapshots, project)
    return {"project": project, "status": "cleared"}


def clear_embedding_cache(store: Store) -> dict:
    store.clear_cache()
    return {"status": "cleared"}


def reconcile(store: Store, root: str, project: str) -> dict:
    """Drops chunks of files that are not there any more."""
    import os

    collection = f"code_{project}"
    if not store.has(collection):
        return {"project": project, "status": "no_collection", "orphans_removed": 0}
    if not os.path.isdir(root):
        return {"project": project, "status": "path_not_found", "orphans_removed": 0}
    before = store.count(collection)
    there = walk.walk(store.spark, root, extensions=set(LANGUAGES)).select(F.col("path").alias("file_path")).select("file_path")
    rows = store.read(collection)
    if rows is not None:
        store.delete(collection, rows.join(there, "file_path", "left_anti").select("id"))
    return {"project": project, "status": "reconciled", "orphans_removed": before - store.count(collection)}


def index_repositories(store: Store, base: str, provider: Provider, depth: int = 2) -> dict[str, dict]:
    """Indexes every repository (a folder with .git) down to ``depth`` below ``base`` that isn't indexed yet."""
    import os

    out, left = {}, [(base, 0)]
    while left:
        folder, level = left.pop()
        if os.path.exists(os.path.join(folder, ".git")):
            out[os.path.basename(folder)] = index_codebase(store, folder, os.path.basename(folder), provider)
        elif level < depth:
            left += [(e.path, level + 1) for e in os.scandir(folder) if e.is_dir(follow_symlinks=False) and not e.name.startswith(".")]
    return out
