"""Agent memory: phrase and vector recall, fusion, anchors, feeds, promotion, storing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .search import clamp

MISSING = "<missing>"


def phrase_hits(nodes: DataFrame, query: str, k: int = 10, order: str = "id") -> DataFrame:
    """The first ``k`` live nodes, by ``order``, whose content or summary has the phrase, with ``rank`` from 1."""
    text = X.phrase_text(F.col("content"), F.col("summary")) if "summary" in nodes.columns else X.phrase_text(F.col("content"))
    hits = nodes.filter(~F.coalesce("archived", F.lit(False))).filter(X.has_phrase(text, query)).orderBy(order).limit(clamp(k))
    # At most k rows are ranked.
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(order)))


def fused(phrase: DataFrame, vector: DataFrame, k: int = 10, damping: int = 0) -> DataFrame:
    """(id, score) of the ``k`` best by reciprocal rank: the sum over both lists of 1 / (damping + rank), ties by id."""
    one = lambda df, name: df.select("id", (1.0 / (F.lit(float(damping)) + F.col("rank"))).alias(name))
    both = one(phrase, "p").join(one(vector, "v"), "id", "full_outer")
    return both.select("id", (F.coalesce("p", F.lit(0.0)) + F.coalesce("v", F.lit(0.0))).alias("score")).orderBy(F.desc("score"), "id").limit(clamp(k))


def hybrid_search(nodes: DataFrame, vectors: DataFrame, query: str, k: int = 10, node_type: str | None = None) -> DataFrame:
    """Fusion of the phrase list and ``vectors`` (id, score; the best ``k`` already chosen) with the nodes' columns.

    The node type restricts the phrase half only after the cut, so fewer than ``k`` rows may return.
    """
    ranked = vectors.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", "rank")
    best = fused(phrase_hits(nodes, query, k), ranked, k)
    found = nodes.join(F.broadcast(best), "id")  # k rows
    return found if node_type is None else found.filter(F.col("node_type") == node_type)


def feed(nodes: DataFrame, now: Column, agent: str | None = None, minutes: int = 60, project: str | None = None) -> DataFrame:
    """Live nodes of the last minutes, newest first, without the agent's own; of no agent counts as of others."""
    rows = nodes.filter(~F.coalesce("archived", F.lit(False)) & (F.col("created_at") >= X.before(now, minutes)))
    rows = rows if agent is None else rows.filter(F.col("agent_id").isNull() | (F.col("agent_id") != agent))
    rows = rows if project is None else rows.filter(F.col("project_path") == project)
    return rows.orderBy(F.desc("created_at"), "id")


def stale_anchors(anchors: DataFrame, nodes: DataFrame, files: DataFrame, project: str | None = None) -> DataFrame:
    """Anchors of existing nodes whose file's hash is another now; a file that is gone has the hash "<missing>"."""
    own = nodes if project is None else nodes.filter(F.col("project_path") == project)
    live = anchors.join(own.select(F.col("id").alias("memory_id")), "memory_id")
    current = live.join(files.select("file_path", F.col("hash").alias("current_hash")), "file_path", "left")
    current = current.withColumn("current_hash", F.coalesce("current_hash", F.lit(MISSING)))
    return current.filter(F.col("stored_hash") != F.col("current_hash")).select("memory_id", "anchor_id", "file_path", "stored_hash", "current_hash")


def promote(nodes: DataFrame, node_id, scope: str | None, now: Column | None = None) -> DataFrame:
    """``nodes`` with one node's project replaced (null: all projects) and its update time set."""
    here = F.col("id") == node_id
    out = nodes.withColumn("project_path", F.when(here, F.lit(scope)).otherwise(F.col("project_path")))
    return out if now is None else out.withColumn("updated_at", F.when(here, now).otherwise(F.col("updated_at")))


def store(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` with new ones: a missing summary is the content's first 200 characters, keywords are joined by commas."""
    row = new.withColumn("summary", X.shown_summary(F.col("summary"), F.col("content"))).withColumn("keywords", X.joined_keywords(F.col("keywords")))
    return nodes.unionByName(row.withColumn("archived", F.lit(False)), allowMissingColumns=True)


def anchors_for(new: DataFrame, files: DataFrame) -> DataFrame:
    """An anchor for each new node with a file: the file's hash now, and the line range if "a-b"."""
    span = X.line_range(F.col("line_range"))
    rows = new.filter(F.col("file_path").isNotNull()).join(files.select("file_path", F.col("hash").alias("stored_hash")), "file_path")
    return rows.select(F.md5(F.concat_ws(":", F.col("id").cast("string"), "file_path")).alias("anchor_id"), F.col("id").alias("memory_id"), "file_path", "stored_hash", span["first"].alias("line_start"), span["last"].alias("line_end"), F.lit(False).alias("is_stale"))


def node(nodes: DataFrame, node_id) -> DataFrame:
    """The node of an id, which reaches the scan as a filter."""
    return nodes.filter(F.col("id") == node_id)


def nodes_of(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of many ids (id) at once."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def unembedded(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Live nodes that no vector stands for yet."""
    return nodes.filter(~F.coalesce("archived", F.lit(False))).join(vectors.select("id"), "id", "left_anti")


def backfilled(nodes: DataFrame, vectors: DataFrame, embed) -> DataFrame:
    """(id, embedding) to append for live nodes without a vector; ``embed`` adds the embedding of a frame's content."""
    return embed(unembedded(nodes, vectors)).select("id", "embedding")
