"""Counts for monitoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def collection_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection").agg(F.count("*").alias("n"))


def branch_counts(chunks: DataFrame, project: str) -> DataFrame:
    """(branch, chunk_count) of a project's overlays."""
    prefix = f"code_{project}__"
    rows = chunks.filter(F.col("collection").startswith(prefix))
    return rows.groupBy(F.substring("collection", len(prefix) + 1, 1 << 20).alias("branch")).agg(F.count("*").alias("chunk_count"))


def fleet_stats(chunks: DataFrame, nodes: DataFrame, anchors: DataFrame, locks: DataFrame, subscriptions: DataFrame, notifications: DataFrame, sessions: DataFrame, cached: DataFrame) -> DataFrame:
    """(metric, value) of every table; each is one pass whose partial counts are all that moves."""
    one = lambda df, metric, value=F.count("*"): df.agg(value.alias("value")).select(F.lit(metric).alias("metric"), F.col("value").cast("long").alias("value"))
    parts = [
        one(chunks.filter(F.col("collection").startswith("code_")), "total_chunks"), one(nodes, "memory_nodes"), one(anchors, "file_anchors"), one(locks, "active_locks"), one(subscriptions, "subscriptions"),
        one(notifications, "unread_notifications", F.count_if(F.col("read_at").isNull())), one(sessions, "active_agents", F.count_if(F.col("status") == "active")), one(cached, "cached_embeddings"),
    ]
    per = collection_counts(chunks).select(F.concat(F.lit("chunks:"), "collection").alias("metric"), F.col("n").alias("value"))
    return reduce(DataFrame.unionByName, parts).unionByName(per)


def subscriptions_by_agent(subscriptions: DataFrame) -> DataFrame:
    """(agent_id, n, patterns) with the most subscribed first."""
    return subscriptions.groupBy("agent_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("file_pattern")).alias("patterns")).orderBy(F.desc("n"), "agent_id")


def latest_notifications(notifications: DataFrame, n: int = 50) -> DataFrame:
    return notifications.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def agents_view(sessions: DataFrame, locks: DataFrame, containing: str = "", hide_disconnected: bool = False) -> DataFrame:
    """Sessions whose agent's name has the text in any case, whether it holds a lock, and display columns."""
    rows = sessions.filter(F.lower("agent_id").contains(containing.lower()))
    rows = rows.filter(F.col("status") != "disconnected") if hide_disconnected else rows
    holders = locks.select("agent_id").distinct().withColumn("holds", F.lit(True))
    shown = rows.join(holders, "agent_id", "left").withColumn("has_lock", F.coalesce("holds", F.lit(False))).drop("holds")
    return shown.withColumn("worktree", X.shortened_path(F.col("worktree_path"))) if "worktree_path" in sessions.columns else shown


def index_result(files: DataFrame) -> DataFrame:
    """One row: inserted, succeeded, failed and the errors by path, from (path, chunks, error)."""
    return files.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("inserted"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("path", "error"))))).alias("errors"))


def index_counts(files: DataFrame) -> DataFrame:
    """One row: inserted, succeeded and failed, from (path, chunks, error)."""
    return files.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("inserted"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def index_errors(files: DataFrame) -> DataFrame:
    """(path, error) of the files that failed, a row each, however many."""
    return files.filter(F.col("error").isNotNull()).select("path", "error")


def recent_history(samples: DataFrame, key: str = "metric", order: str = "taken_at", n: int = 60) -> DataFrame:
    """The last ``n`` samples of each metric."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return samples.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n)


def as_json(rows: DataFrame) -> DataFrame:
    """Rows as the JSON objects that a monitor reads."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
