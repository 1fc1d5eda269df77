"""All of the engine's tools over one folder: collections in the store, everything else in append-only logs.

Every method takes names and literals and returns a DataFrame or a small dict. ``now`` is an argument wherever time
matters. One workspace writes at a time; any number may read.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import coordination, memory, search, stats, sync
from .operators.matching import glob_join
from .sources import indexer
from .sources.embedding import Provider, embed
from .sources.files import changed_files
from .sources.store import Store, remove
from .streaming import jobs


class Log:
    """Rows by key in an append-only table: the row of the highest ``seq`` counts, and is gone if ``deleted``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: tuple[str, ...]):
        self.spark, self.path, self.key = spark, path, list(key)
        self.schema = f"{schema}, seq long, deleted boolean"

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def state(self) -> DataFrame:
        return coordination.latest(self.rows(), self.key, ["seq"]).filter(~F.col("deleted"))

    def append(self, rows: DataFrame, deleted: bool = False) -> None:
        """Adds rows after all that are there; those already in the log keep to one batch, so one number serves all."""
        seq = (self.rows().agg(F.max("seq")).first()[0] or 0) + 1
        names = [f.split()[0] for f in self.schema.split(", ")]
        ready = rows.drop("seq", "deleted").withColumns({"seq": F.lit(seq).cast("long"), "deleted": F.lit(deleted)})
        have = set(ready.columns)
        kinds = self.spark.createDataFrame([], self.schema).schema
        ready.select(*[(F.col(n) if n in have else F.lit(None)).cast(kinds[n].dataType).alias(n) for n in names]).write.mode("append").parquet(self.path)


    def compact(self) -> int:
        """Writes the state as the log's only rows and deletes the files before it; how many these were.

        Between the two, rows are there twice with the same number, which changes no state.
        """
        files = self.rows().inputFiles()
        state = self.state()
        if files:
            state.write.mode("append").parquet(self.path)
        for f in files:
            remove(self.spark, f)
        return len(files)


class Workspace:
    """``roots`` (project: folder) are kept in sync from the first search on, every ``every`` seconds."""

    def __init__(self, spark: SparkSession, folder: str, provider: Provider, caps: indexer.Caps = indexer.Caps(), roots: dict[str, str] | None = None, every: int = 300):
        self.spark, self.folder, self.provider, self.caps = spark, folder, provider, caps
        self.roots, self.every, self.syncs, self._coordinated = roots or {}, every, {}, {}
        self.store = Store(spark, f"{folder}/collections")
        log = lambda name, schema, *key: Log(spark, f"{folder}/{name}", schema, key)
        self.nodes = log("nodes", "id string, node_type string, content string, summary string, keywords string, file_path string, line_range string, source string, project_path string, archived boolean, created_at timestamp, updated_at timestamp, agent_id string, embedding array<float>", "id")
        self.anchors = log("anchors", "anchor_id string, memory_id string, file_path string, stored_hash string, line_start int, line_end int, is_stale boolean", "anchor_id")
        self.locks = log("locks", "agent_id string, project string, lock_id string, file_patterns array<string>, branch string, acquired_at timestamp, expires_at timestamp", "agent_id", "project")
        self.subscriptions = log("subscriptions", "agent_id string, project string, file_pattern string, created_at timestamp", "agent_id", "project", "file_pattern")
        self.notices = log("notifications", "id string, subscriber_agent_id string, memory_id string, memory_summary string, file_path string, author_agent_id string, created_at timestamp, read_at timestamp", "id")
        self.sessions = log("sessions", "agent_id string, project string, worktree_path string, branch string, connected_at timestamp, last_activity_at timestamp, status string", "agent_id")

    def _frame(self, schema: str, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)

    def _embed(self, text: str) -> list[float]:
        return self.provider.embed_batch([text])[0]

    def _chunks(self, prefix: str = "code_") -> DataFrame | None:
        names = sorted(r["collection"] for r in self.store.collections().filter(F.col("collection").startswith(prefix)).collect())
        tables = [t for t in map(self.store.read, names) if t is not None]
        return reduce(DataFrame.unionByName, tables) if tables else None

    # -- indexing

    def index_codebase(self, root: str, project: str, force: bool = False, branch: str | None = None, patterns: list[str] | None = None, extensions: set[str] | None = None) -> dict:
        if branch is None:
            return indexer.index_codebase(self.store, root, project, self.provider, force, patterns, extensions, self.caps)
        n = self.index_branch(root, project, branch, changed_files(root, branch))
        return {"project": project, "branch": branch, "status": "indexed", "chunk_count": n}

    def index_branch(self, root: str, project: str, branch: str, changed: list[str]) -> int:
        return indexer.index_branch(self.store, root, project, self._overlay(project, branch), changed, self.provider, self.caps)

    def _overlay(self, project: str, branch: str) -> str:
        return self.spark.range(1).select(X.overlay_collection(F.lit(project), F.lit(branch))).first()[0]

    def index_files(self, root: str, project: str, paths: list[str]) -> DataFrame:
        return indexer.index_files(self.store, root, project, paths, self.provider, self.caps)

    def index_status(self, project: str) -> dict:
        return indexer.index_status(self.store, project)

    def clear_index(self, project: str) -> dict:
        return indexer.clear_index(self.store, project)

    def clear_embedding_cache(self) -> dict:
        return indexer.clear_embedding_cache(self.store)

    def branches(self, project: str) -> DataFrame:
        rows = self._chunks(f"code_{project}__")
        return self._frame("branch string, chunk_count long") if rows is None else stats.branch_counts(rows, project)

    def cleanup_branch(self, project: str, branch: str, reindex_base: bool = False, root: str | None = None) -> dict:
        """Drops a branch's overlay; with ``reindex_base`` the base is indexed anew from ``root``."""
        name = self._overlay(project, branch)
        had = self.store.has(name)
        self.store.drop(name)
        out = {"project": project, "branch": branch, "dropped": had}
        if not reindex_base:
            return out
        if root is None:
            raise ValueError("re-indexing the base needs its root")
        return out | {"reindex_status": self.index_codebase(root, project, force=True)["status"]}

    def sync_once(self, project: str, root: str) -> dict:
        return indexer.sync_once(self.store, root, project, self.provider, self.caps)

    def start_sync(self) -> None:
        """Starts what keeps ``roots`` in sync, once; a round that fails is tried again with the next."""
        for project, root in self.roots.items():
            if project not in self.syncs:
                self.syncs[project] = jobs.every(self.spark, lambda project=project, root=root: self.sync_once(project, root), f"{self.every} seconds")

    def stop_sync(self) -> None:
        for running in self.syncs.values():
            running.stop()
        self.syncs.clear()

    def reconcile(self, root: str, project: str) -> dict:
        return indexer.reconcile(self.store, root, project)

    # -- code search

    def search_code(self, query: str, project: str | None = None, limit: int = 10, language: str | None = None, branch: str | None = None) -> DataFrame:
        self.start_sync()
        where = None if language is None else F.col("language") == language
        rows = self._chunks() if project is None else self._chunks(f"code_{project}")
        if rows is None:
            return self._frame("file_path string, start_line int, end_line int, snippet string, score double, project string")
        if project is not None and branch is not None:
            found = search.overlay_search(rows, self._embed(query), f"code_{project}", self._overlay(project, branch), limit, where)
        else:
            found = search.top_k(rows if project is None else rows.filter(F.col("collection") == f"code_{project}"), self._embed(query), limit, where)
        return found.select("file_path", "start_line", "end_line", F.col("content").alias("snippet"), "score", F.col("project_name").alias("project"))

    def find_similar_code(self, snippet: str, limit: int = 10) -> DataFrame:
        return self.search_code(snippet, limit=limit)

    def find_symbol(self, name: str, file_path: str | None = None, kind: str | None = None) -> DataFrame | None:
        rows = self._chunks()
        return None if rows is None else search.find_symbol(rows, name, file_path, kind)

    def change_impact(self, files: list[str] | None = None, symbols: list[str] | None = None) -> DataFrame | None:
        rows = self._chunks()
        return None if rows is None else search.change_impact(rows, search.impact_terms(files or [], symbols or []))

    def dependents(self, symbol: str, file_path: str | None = None, depth: int = 1) -> DataFrame | None:
        rows = self._chunks()
        return None if rows is None else search.dependents(self.spark, rows, symbol, file_path, depth)

    # -- memory

    def memory_store(self, now: dt.datetime, node_type: str, content: str, summary: str | None = None, keywords: list[str] | None = None, file_path: str | None = None, file_hash: str | None = None, line_range: str | None = None, project: str | None = None, agent: str | None = None, source: str = "agent") -> dict:
        """Stores a node with its vector, its anchor if there is a file, and notifications to its subscribers."""
        if file_path is not None and file_hash is None:
            raise ValueError("a file needs its hash")
        key = uuid.uuid4().hex
        row = self._frame("id string, node_type string, content string, summary string, keywords array<string>, file_path string, line_range string, source string, project_path string, agent_id string, created_at timestamp", (key, node_type, content, summary, keywords or [], file_path, line_range, source, project, agent, now))
        ready = embed(row.withColumns({"keywords": X.joined_keywords(F.col("keywords")), "archived": F.lit(False), "updated_at": F.col("created_at")}), self.provider)
        self.nodes.append(ready)
        if file_path is not None:
            self.anchors.append(memory.anchors_for(row, self._frame("file_path string, hash string", (file_path, file_hash))))
            if agent is not None and project is not None:
                self._notify(now, project, [file_path], agent, key, (summary or content)[:200])
        return {"id": key, "status": "stored"}

    def _notify(self, now: dt.datetime, project: str, files: list[str], author: str, memory_id: str, summary: str) -> int:
        changed = self._frame("project string, file_path string, author string", *[(project, f, author) for f in files])
        told = coordination.notify(self.subscriptions.state(), changed)
        rows = told.select(F.expr("uuid()").alias("id"), F.col("agent_id").alias("subscriber_agent_id"), F.lit(memory_id).alias("memory_id"), F.lit(summary).alias("memory_summary"), "file_path", F.col("author").alias("author_agent_id"), F.lit(now).alias("created_at"))
        n = told.count()
        if n:
            self.notices.append(rows)
        return n

    def memory_search(self, query: str, limit: int = 10, node_type: str | None = None) -> DataFrame:
        nodes = self.nodes.state()
        where = ~F.coalesce("archived", F.lit(False)) & (F.lit(True) if node_type is None else F.col("node_type") == node_type)
        near = search.top_k(nodes, self._embed(query), limit, where).select("id", "score")
        return memory.hybrid_search(nodes.drop("embedding"), near, query, limit, node_type).orderBy(F.desc("score"), "id")

    def memory_node(self, node_id: str) -> dict | None:
        row = memory.node(self.nodes.state().drop("embedding", "seq", "deleted"), node_id).first()
        return row.asDict() if row else None

    def embed_missing(self) -> int:
        """Gives live nodes without a vector theirs; how many."""
        nodes = self.nodes.state()
        found = memory.unembedded(nodes, nodes.filter(F.col("embedding").isNotNull()))
        n = found.count()
        if n:
            self.nodes.append(embed(found.drop("embedding"), self.provider))
        return n

    def memory_promote(self, now: dt.datetime, node_id: str, scope: str | None = None) -> dict:
        found = self.nodes.state().filter(F.col("id") == node_id)
        if not found.isEmpty():
            self.nodes.append(memory.promote(found, node_id, scope, F.lit(now)))
        return {"id": node_id, "status": "promoted"}

    def stale_check(self, files: DataFrame, project: str | None = None) -> DataFrame:
        """Anchors whose file differs from ``files`` (file_path, hash), which has the hashes of now."""
        return memory.stale_anchors(self.anchors.state(), self.nodes.state(), files, project)

    def memory_feed(self, now: dt.datetime, agent: str | None = None, minutes: int = 60, project: str | None = None) -> DataFrame:
        return memory.feed(self.nodes.state(), F.lit(now), agent, minutes, project).select("id", "node_type", X.shown_summary(F.col("summary"), F.col("content")).alias("summary"), "agent_id", "file_path", "created_at")

    def memory_subscribe(self, now: dt.datetime, agent: str, patterns: list[str], project: str) -> DataFrame:
        wanted = self._frame("agent_id string, project string, file_pattern string", *[(agent, project, p) for p in patterns])
        new = coordination.subscribe_new(self.subscriptions.state(), wanted)
        made = self._frame("agent_id string, project string, file_pattern string", *[tuple(r) for r in new.select("agent_id", "project", "file_pattern").collect()])
        if not made.isEmpty():
            self.subscriptions.append(made.withColumn("created_at", F.lit(now)))
        return made

    def memory_notifications(self, now: dt.datetime, agent: str) -> list:
        """An agent's unread notifications, newest first, which are read by this: exactly those that are returned."""
        unread = coordination.unread(self.notices.state(), agent)
        found = unread.collect()
        if found:
            self.notices.append(self.spark.createDataFrame(found, unread.schema).withColumn("read_at", F.lit(now)))
        return found

    # -- coordination

    def register(self, now: dt.datetime, agent: str, project: str, worktree: str | None = None, branch: str | None = None) -> dict:
        new = self._frame("agent_id string, project string, worktree_path string, branch string", (agent, project, worktree, branch)).withColumns({"connected_at": F.lit(now), "last_activity_at": F.lit(now), "status": F.lit("active")})
        old = self.sessions.state().filter(F.col("agent_id") == agent).select(*new.columns)
        self.sessions.append(coordination.register(old, new))
        return {"agent_id": agent, "status": "active"}

    def agents(self, now: dt.datetime) -> DataFrame:
        state = X.session_state(F.col("last_activity_at"), F.lit(now), F.col("status"))
        return self.sessions.state().withColumn("status", state).filter(F.col("status").isNotNull()).orderBy(F.desc("last_activity_at"), "agent_id")

    def prune(self, now: dt.datetime) -> int:
        """Forgets disconnected agents; how many."""
        gone = self.agents(now).filter(F.col("status") == "disconnected")
        n = gone.count()
        if n:
            self.sessions.append(gone, deleted=True)
        return n

    def _held(self, now: dt.datetime) -> DataFrame:
        return self.locks.state().filter(F.col("expires_at") >= F.lit(now))

    def _patterns(self, now: dt.datetime) -> DataFrame:
        return self._held(now).withColumn("pattern", F.explode("file_patterns"))

    def lock_acquire(self, now: dt.datetime, agent: str, project: str, patterns: list[str], branch: str = "main", ttl_minutes: int = 60) -> dict:
        wanted = self._frame("wanted_agent string, project string, wanted_pattern string", *[(agent, project, p) for p in patterns])
        way = coordination.first_conflicts(self._patterns(now), wanted).first()
        if way is not None:
            return {"status": "conflict", "agent_id": way["agent_id"], "patterns": way["file_patterns"], "lock_id": way["lock_id"]}
        key = str(uuid.uuid4())
        self.locks.append(self._frame("agent_id string, project string, lock_id string, file_patterns array<string>, branch string, acquired_at timestamp, expires_at timestamp", (agent, project, key, patterns, branch, now, now + dt.timedelta(minutes=ttl_minutes))))
        return {"status": "acquired", "lock_id": key}

    def auto_coordinate(self, now: dt.datetime, agent: str, project: str, modified: list[str], branch: str = "main", ttl_minutes: int = 480) -> dict:
        """Locks an agent's modified files that no other's lock names, and subscribes it to all; the same set again does nothing."""
        if self._coordinated.get((agent, project)) == set(modified):
            return {"status": "unchanged"}
        paths = self._frame("path string", *[(p,) for p in modified])
        others = self._patterns(now).filter((F.col("project") == project) & (F.col("agent_id") != agent))
        free = sorted(r["path"] for r in coordination.lockable(paths, others).collect())
        locked = self.lock_acquire(now, agent, project, free, branch, ttl_minutes)["status"] if free else "nothing to lock"
        subscribed = len(self.memory_subscribe(now, agent, modified, project).collect()) if modified else 0
        self._coordinated[agent, project] = set(modified)
        return {"status": locked, "locked": free if locked == "acquired" else [], "subscribed": subscribed}

    def lock_release(self, agent: str, project: str) -> dict:
        mine = self.locks.state().filter((F.col("agent_id") == agent) & (F.col("project") == project))
        n = mine.count()
        if n:
            self.locks.append(mine, deleted=True)
        return {"status": "released", "count": n}

    def lock_query(self, now: dt.datetime, project: str, file_path: str | None = None) -> DataFrame:
        held = self._held(now).filter(F.col("project") == project)
        if file_path is None:
            return held.orderBy(F.desc("acquired_at"), "agent_id")
        return held.filter(F.exists("file_patterns", lambda p: X.globs_overlap(p, F.lit(file_path)))).orderBy(F.desc("acquired_at"), "agent_id")

    def heartbeat(self, now: dt.datetime, agent: str, ttl_minutes: int = 480, project: str | None = None, modified: list[str] | None = None) -> int:
        """Extends all of an agent's locks and touches its session; the number of locks. With ``modified``, coordinates those files too."""
        if project is not None and modified is not None:
            self.auto_coordinate(now, agent, project, modified, ttl_minutes=ttl_minutes)
        mine = self.locks.state().filter(F.col("agent_id") == agent)
        n = mine.count()
        if n:
            self.locks.append(coordination.heartbeat(mine, agent, F.lit(now), ttl_minutes))
        seen = self.sessions.state().filter(F.col("agent_id") == agent)
        if not seen.isEmpty():
            self.sessions.append(seen.withColumns({"last_activity_at": F.lit(now), "status": F.lit("active")}))
        return n

    def merge_impact(self, now: dt.datetime, project: str, files: list[str]) -> DataFrame:
        rows = self._chunks()
        chunks = self._frame("collection string, file_path string") if rows is None else rows
        paths = self._frame("file_path string", *[(f,) for f in files])
        return coordination.merge_impact(paths, project, self._patterns(now), self.subscriptions.state(), chunks, self.anchors.state(), self.nodes.state())

    def notify_merge(self, now: dt.datetime, project: str, branch: str, files: list[str]) -> dict:
        """Notifies subscribers of the files, marks their anchors stale and releases the branch's locks."""
        author = f"merge:{branch}"
        told = self._notify(now, project, files, author, f"merge-{branch}-{uuid.uuid4().hex[:8]}", f"merged {branch}")
        paths = self._frame("file_path string", *[(f,) for f in files])
        live = self.nodes.state().filter(~F.coalesce("archived", F.lit(False))).select(F.col("id").alias("memory_id"))
        hit = self.anchors.state().join(paths, "file_path", "left_semi").join(live, "memory_id", "left_semi")
        stale = [r["anchor_id"] for r in hit.select("anchor_id").collect()]
        if stale:
            self.anchors.append(hit.withColumn("is_stale", F.lit(True)))
        held = self.locks.state().filter((F.col("project") == project) & (F.col("branch") == branch))
        n = held.count()
        if n:
            self.locks.append(held, deleted=True)
        return {"notifications_created": told, "stale_anchors": stale, "released_locks": n}

    # -- monitoring

    def stats(self, now: dt.datetime, cache: DataFrame | None = None) -> DataFrame:
        rows = self._chunks()
        chunks = self._frame("collection string") if rows is None else rows
        return stats.fleet_stats(chunks, self.nodes.state(), self.anchors.state(), self._held(now), self.subscriptions.state(), self.notices.state(), self.agents(now), self._frame("content_hash string") if cache is None else cache)

    def compact(self) -> dict[str, int]:
        """Compacts all logs, so that states needn't read their whole history."""
        return {name: getattr(self, name).compact() for name in ("nodes", "anchors", "locks", "subscriptions", "notices", "sessions")}

    def conflicts(self, now: dt.datetime) -> DataFrame:
        return coordination.lock_conflicts(self._patterns(now))

    def watchers_of(self, project: str, files: list[str]) -> DataFrame:
        """Subscriptions that the files would wake."""
        return glob_join(self._frame("file_path string", *[(f,) for f in files]), self.subscriptions.state().filter(F.col("project") == project), "file_path", "file_pattern").select("agent_id", "file_pattern", "file_path")

    def pending_changes(self, project: str, now: DataFrame, snapshot: DataFrame) -> DataFrame:
        return sync.by_top_folder(sync.tree_diff(snapshot, now))
