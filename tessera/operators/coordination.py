"""Locks, subscriptions, notifications, merges and sessions as states of append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .matching import glob_join, overlap_join


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: one value a key is combined before the shuffle, whatever the key's rows."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in log.columns if c not in keys]), F.struct(*order)).alias("r")).select(*keys, "r.*")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("r")).select(*keys, "r.*")


# -- locks


def lock_state(log: DataFrame, now: Column, ttl_minutes: int = 60) -> DataFrame:
    """Locks in force: of each agent and project the newest, unless it has expired."""
    newest = latest(log, ["agent_id", "project"], ["acquired_at", "seq"])
    return newest.withColumn("expires_at", F.col("acquired_at") + F.make_dt_interval(mins=F.lit(ttl_minutes))).filter(F.col("expires_at") >= now)


def lock_conflicts(locks: DataFrame, same_project: bool = False) -> DataFrame:
    """(agent_a, agent_b, patterns) of locks of two agents that overlap; a before b. Across projects unless told otherwise."""
    side = lambda s: locks.select(F.col("agent_id").alias(f"agent_{s}"), F.col("project").alias(f"project_{s}"), F.col("pattern").alias(f"pattern_{s}"))
    met = overlap_join(side("a"), side("b"), "pattern_a", "pattern_b", more=F.expr("agent_a < agent_b" + " and project_a = project_b" * same_project))
    both = F.collect_list(F.array("pattern_a", "pattern_b"))
    return met.groupBy("agent_a", "agent_b").agg(F.array_sort(F.array_distinct(F.flatten(both))).alias("patterns"))


def wanted_against(locks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs of wanted locks (wanted_agent, project, wanted_pattern) and others' locks in force that overlap."""
    return overlap_join(wanted, locks, "wanted_pattern", "pattern", ("project",), F.expr("wanted_agent <> agent_id"))


def first_conflicts(locks: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted agent and project that can't have its lock: the earliest lock in its way."""
    return first_of(wanted_against(locks, wanted), ["wanted_agent", "project"], ["acquired_at", "seq", "wanted_pattern"])


def acquire(log: DataFrame, wanted: DataFrame, now: Column, ttl_minutes: int = 60) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts) for wanted locks; an agent's older lock in the project gives way to the new."""
    conflicts = first_conflicts(lock_state(log, now, ttl_minutes), wanted)
    granted = wanted.join(conflicts.select("wanted_agent", "project"), ["wanted_agent", "project"], "left_anti")
    return granted.select(F.col("wanted_agent").alias("agent_id"), "project", F.col("wanted_pattern").alias("pattern"), now.alias("acquired_at")), conflicts


def release(locks: DataFrame, agent: str, project: str) -> DataFrame:
    return locks.filter(~((F.col("agent_id") == agent) & (F.col("project") == project)))


def heartbeat(locks: DataFrame, agent: str, now: Column, ttl_minutes: int = 480) -> DataFrame:
    """All of an agent's locks with their time extended, expired ones too."""
    return locks.withColumn("expires_at", F.when(F.col("agent_id") == agent, now + F.make_dt_interval(mins=F.lit(ttl_minutes))).otherwise(F.col("expires_at")))


def locks_on(locks: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs of files (file_path) and locks whose pattern and path match either way."""
    return overlap_join(files, locks, "file_path", "pattern")


def lockable(modified: DataFrame, others: DataFrame) -> DataFrame:
    """Modified paths that no other agent's lock names exactly."""
    return modified.join(others.select(F.col("pattern").alias("path")), "path", "left_anti")


def auto_coordinate(log: DataFrame, subscriptions: DataFrame, modified: DataFrame, agent: str, project: str, now: Column, ttl_minutes: int = 480, matched: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lock rows, subscriptions) to append for an agent's modified paths (path): it locks those that nobody else's
    lock names, and subscribes to all. With ``matched``, paths that another's lock matches are left out too, for which
    an acquire would be refused."""
    others = lock_state(log, now, ttl_minutes).filter((F.col("project") == project) & (F.col("agent_id") != agent))
    free = lockable(modified, others)
    if matched:
        free = free.join(overlap_join(modified, others, "path", "pattern").select("path").distinct(), "path", "left_anti")
    locks = free.select(F.lit(agent).alias("agent_id"), F.lit(project).alias("project"), F.col("path").alias("pattern"), now.alias("acquired_at"))
    return locks, subscribe_new(subscriptions, modified.select(F.lit(agent).alias("agent_id"), F.lit(project).alias("project"), F.col("path").alias("file_pattern")))


# -- subscriptions and notifications


def subscribe_new(subscriptions: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.distinct().join(subscriptions.select("agent_id", "project", "file_pattern"), ["agent_id", "project", "file_pattern"], "left_anti")


def notify(subscriptions: DataFrame, files: DataFrame) -> DataFrame:
    """A notification for each subscription that matches a changed file (project, file_path, author), but not to its author."""
    met = glob_join(files, subscriptions, "file_path", "file_pattern", ("project",), F.col("agent_id") != F.col("author"))
    return met.select("agent_id", "project", "file_pattern", "file_path", "author")


def unread(notifications: DataFrame, agent: str | None = None) -> DataFrame:
    rows = notifications.filter(F.col("read_at").isNull())
    rows = rows if agent is None else rows.filter(F.col("subscriber_agent_id") == agent)
    return rows.orderBy(F.desc("created_at"), F.desc("id"))


def mark_read(notifications: DataFrame, agent: str, now: Column) -> DataFrame:
    mine = (F.col("subscriber_agent_id") == agent) & F.col("read_at").isNull()
    return notifications.withColumn("read_at", F.when(mine, now).otherwise(F.col("read_at")))


# -- merges


def merge_impact(files: DataFrame, project: str, locks: DataFrame, subscriptions: DataFrame, chunks: DataFrame, anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """What merging ``files`` (file_path) touches, tagged by ``kind``: locked and subscribed agents with their first
    pattern, overlay collections with a chunk of a file, and live nodes' anchors on a file."""
    held = locks_on(locks.filter(F.col("project") == project), files)
    locked = first_of(held, ["agent_id"], ["acquired_at", "pattern"]).select(F.lit("locked_agent").alias("kind"), F.col("agent_id").alias("key"), F.col("pattern").alias("detail"))
    heard = glob_join(files, subscriptions.filter(F.col("project") == project), "file_path", "file_pattern")
    heard = heard.groupBy("agent_id").agg(F.min("file_pattern").alias("detail")).select(F.lit("subscribed_agent").alias("kind"), F.col("agent_id").alias("key"), "detail")
    over = chunks.filter(F.col("collection").contains("__")).join(files, "file_path", "left_semi").select(F.lit("overlay").alias("kind"), F.col("collection").alias("key"), F.lit("").alias("detail")).distinct()
    stale = anchors.join(files, "file_path", "left_semi").join(nodes.filter(~F.coalesce("archived", F.lit(False))).select(F.col("id").alias("memory_id")), "memory_id")
    stale = stale.select(F.lit("stale_anchor").alias("kind"), F.col("anchor_id").cast("string").alias("key"), F.col("file_path").alias("detail"))
    return locked.unionByName(heard).unionByName(over).unionByName(stale)


def after_merge(files: DataFrame, project: str, branch: str, subscriptions: DataFrame, anchors: DataFrame, nodes: DataFrame, locks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notifications, anchors with those on the files marked stale, locks without the branch's) after a merge."""
    changed = files.select(F.lit(project).alias("project"), "file_path", F.lit(f"merge:{branch}").alias("author"))
    live = nodes.filter(~F.coalesce("archived", F.lit(False))).select(F.col("id").alias("memory_id"))
    hit = anchors.join(files, "file_path", "left_semi").join(live, "memory_id", "left_semi").select("anchor_id", F.lit(True).alias("hit"))
    marked = anchors.join(hit, "anchor_id", "left").withColumn("is_stale", F.coalesce("hit", F.lit(False))).drop("hit")
    return notify(subscriptions, changed), marked, locks.filter(~((F.col("project") == project) & (F.col("branch") == branch)))


# -- sessions


def sessions(activity: DataFrame, now: Column) -> DataFrame:
    """The state of every agent seen within a day (agent_id, seen_at): its first and last sight and its status."""
    seen = activity.groupBy("agent_id").agg(F.min("seen_at").alias("connected_at"), F.max("seen_at").alias("last_activity_at"))
    return seen.withColumn("status", X.session_state(F.col("last_activity_at"), now, F.lit("active"))).filter(F.col("status").isNotNull()).orderBy(F.desc("last_activity_at"), "agent_id")


def register(known: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions with new registrations: one row an agent, the latest one's columns, but the first connection's time."""
    both = known.unionByName(new)
    kept = latest(both, ["agent_id"], ["last_activity_at"])
    return kept.drop("connected_at").join(both.groupBy("agent_id").agg(F.min("connected_at").alias("connected_at")), "agent_id").withColumn("status", F.lit("active"))


def pruned(known: DataFrame) -> DataFrame:
    return known.filter(F.col("status") != "disconnected")
