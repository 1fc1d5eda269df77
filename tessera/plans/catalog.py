"""The driver's queries for the engine's own operators, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.hashing import chunk_id, xxh3_hex
from ..operators import chunking, coordination, memory, search, stats, sync
from ..operators.matching import glob_join
from ..shared import checkpointed
from ..sources import embedding, files
from ..sources.store import last_wins
from ..streaming import jobs
from .views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The time that queries take as now: the events' last moment.
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
PHRASE, SYMBOL, NAME, TERMS = "of the", "Erer", "The", ["src/thble reing.py", "ththth"]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _now():
    return F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One row's vector, by a filter that reaches the scan."""
    row = _read(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0])


_save = checkpointed


# -- vectors

DISTANCE = "list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
SCORE = "round(1.0 / (1.0 + " + DISTANCE + "), 9)"
_SCORED = ",\nq AS (SELECT embedding AS q FROM v_vec WHERE id = 0), s AS (SELECT v_vec.*, " + SCORE.format(a="embedding", b="q") + " AS score FROM v_vec, q)\n"


@query(with_views("v_vec") + _SCORED + "SELECT id, score FROM s ORDER BY score DESC, id LIMIT 10")
def vector_topk(spark, sf_dir):
    return search.top_k(view(spark, sf_dir, "v_vec"), _vector(spark, sf_dir, 0), 10).select("id", "score")


@query(with_views("v_vec") + _SCORED + "SELECT id, label, score FROM s WHERE label = 3 ORDER BY score DESC, id LIMIT 10")
def vector_topk_filtered(spark, sf_dir):
    return search.top_k(view(spark, sf_dir, "v_vec"), _vector(spark, sf_dir, 0), 10, F.col("label") == 3).select("id", "label", "score")


@query(with_views("v_vec") + ",\np AS (SELECT a.id AS query_id, b.id, " + SCORE.format(a="b.embedding", b="a.embedding") + """ AS score FROM v_vec a, v_vec b WHERE a.id % 20 = 0)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM p QUALIFY rank <= 5""")
def vector_topk_multi(spark, sf_dir):
    rows = view(spark, sf_dir, "v_vec")
    return search.top_k_each(rows, rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), 5)


@query(with_views("v_vec") + _SCORED + "SELECT id, collection, file_path, score FROM s WHERE starts_with(collection, 'code_') ORDER BY score DESC, id LIMIT 10")
def search_all_collections(spark, sf_dir):
    return search.top_k(view(spark, sf_dir, "v_vec"), _vector(spark, sf_dir, 0), 10, F.col("collection").startswith("code_")).select("id", "collection", "file_path", "score")


@query(with_views("v_vec") + _SCORED + """, o AS (SELECT *, 0 AS source FROM s WHERE collection = 'code_proj__feat--x' ORDER BY score DESC, id LIMIT 10),
b AS (SELECT *, 1 AS source FROM s WHERE collection = 'code_proj' ORDER BY score DESC, id LIMIT 10),
u AS (SELECT * FROM o UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.file_path = b.file_path))
SELECT id, collection, file_path, score FROM u ORDER BY score DESC, source, id LIMIT 10""")
def overlay_search(spark, sf_dir):
    found = search.overlay_search(view(spark, sf_dir, "v_vec"), _vector(spark, sf_dir, 0), "code_proj", "code_proj__feat--x", 10)
    return found.select("id", "collection", "file_path", "score")


@query(with_views("v_vec") + ",\nq AS (SELECT embedding AS q FROM v_vec WHERE id = 7), s AS (SELECT v_vec.*, " + SCORE.format(a="embedding", b="q") + " AS score FROM v_vec, q)\nSELECT id, file_path, score FROM s ORDER BY score DESC, id LIMIT 25")
def find_similar(spark, sf_dir):
    return search.top_k(view(spark, sf_dir, "v_vec"), _vector(spark, sf_dir, 7), 25).select("id", "file_path", "score")


@query()
def ann_topk_lsh(spark, sf_dir):
    rows = search.hyperplane_index(view(spark, sf_dir, "v_vec"))
    return search.approximate_top_k_each(rows, rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), 10)


# -- symbols and text


@query(with_views("v_chunks") + f"\nSELECT id, file_path, chunk_type, project_name FROM v_chunks WHERE name = '{NAME}' AND starts_with(collection, 'code_')")
def find_symbol(spark, sf_dir):
    return search.find_symbol(view(spark, sf_dir, "v_chunks"), NAME).select("id", "file_path", "chunk_type", "project_name")


@query(with_views("v_chunks") + """, t AS (SELECT * FROM (VALUES (0, 'thble reing.py'), (1, 'thble reing'), (2, 'ththth')) AS t(pos, term)),
h AS (SELECT id, file_path, collection, term, row_number() OVER (PARTITION BY id ORDER BY collection, pos) AS rn FROM v_chunks, t WHERE contains(content, term) AND starts_with(collection, 'code_'))
SELECT id, file_path, term AS matched_term FROM h WHERE rn = 1""")
def change_impact(spark, sf_dir):
    return search.change_impact(view(spark, sf_dir, "v_chunks"), search.impact_terms(TERMS[:1], TERMS[1:])).select("id", "file_path", "matched_term")


@query(with_views("v_chunks", recursive=True) + f""",
b AS (SELECT id, name, 1 AS depth FROM v_chunks WHERE contains(content, '{SYMBOL}')
      UNION SELECT c.id, c.name, b.depth + 1 FROM b JOIN v_chunks c ON contains(c.content, b.name) WHERE b.depth < 2 AND b.name <> '' AND b.name <> '{SYMBOL}')
SELECT id, min(depth) AS depth FROM b GROUP BY id""")
def dependents_bfs(spark, sf_dir):
    return search.dependents(spark, view(spark, sf_dir, "v_chunks").select("id", "collection", "file_path", "name", "content"), SYMBOL, None, 2, _save).select("id", "depth")


_PHRASE = "concat(' ', array_to_string(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+'), ' '), ' ')"


@query(with_views("v_memory") + f"\nSELECT id, node_type, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS rank FROM v_memory WHERE NOT archived AND contains({_PHRASE}, ' {PHRASE} ') ORDER BY id LIMIT 50")
def fts_phrase(spark, sf_dir):
    return memory.phrase_hits(view(spark, sf_dir, "v_memory"), PHRASE, 50).select("id", "node_type", "rank")


@query(with_views("v_memory", "v_vec") + _SCORED + f""", f AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM v_memory WHERE NOT archived AND contains({_PHRASE}, ' {PHRASE} ') ORDER BY id LIMIT 20),
v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM s ORDER BY score DESC, id LIMIT 20),
x AS (SELECT coalesce(f.id, v.id) AS id, round(coalesce(1.0 / CAST(f.r AS DOUBLE), 0.0) + coalesce(1.0 / CAST(v.r AS DOUBLE), 0.0), 9) AS score FROM f FULL JOIN v ON f.id = v.id ORDER BY score DESC, id LIMIT 20)
SELECT x.id, m.node_type, x.score FROM x JOIN v_memory m ON m.id = x.id""")
def hybrid_rrf(spark, sf_dir):
    near = search.top_k(view(spark, sf_dir, "v_vec"), _vector(spark, sf_dir, 0), 20).select("id", "score")
    found = memory.hybrid_search(view(spark, sf_dir, "v_memory"), near, PHRASE, 20)
    return found.select("id", "node_type", F.round("score", 9).alias("score"))


@query(f"SELECT event_id AS id, user_id, event_type AS node_type, ts AS created_at FROM events WHERE ts >= {NOW} - INTERVAL 600 MINUTE AND user_id <> 5")
def memory_feed(spark, sf_dir):
    nodes = _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("user_id").cast("string").alias("agent_id"), F.col("event_type").alias("node_type"), F.col("ts").alias("created_at"), F.lit(False).alias("archived"))
    return memory.feed(nodes, _now(), "5", 600).select("id", "user_id", "node_type", "created_at")


@query(with_views("v_anchors", "v_files_now") + """
SELECT memory_id, anchor_id, a.file_path, stored_hash, coalesce(hash, '<missing>') AS current_hash FROM v_anchors a LEFT JOIN v_files_now f ON a.file_path = f.file_path WHERE coalesce(hash, '<missing>') <> stored_hash""")
def stale_check(spark, sf_dir):
    return memory.stale_anchors(view(spark, sf_dir, "v_anchors"), view(spark, sf_dir, "v_memory"), view(spark, sf_dir, "v_files_now"))


@query(with_views("v_memory") + "\nSELECT id, CASE WHEN id = 42 THEN NULL ELSE project_path END AS project_path FROM v_memory")
def memory_promote(spark, sf_dir):
    return memory.promote(view(spark, sf_dir, "v_memory"), 42, None).select("id", "project_path")


# -- coordination

_LOCKS = f"""l AS (SELECT *, row_number() OVER (PARTITION BY agent_id, project ORDER BY acquired_at DESC, seq DESC) AS rn FROM v_lock_log),
locks AS (SELECT agent_id, project, pattern, branch, acquired_at, seq, acquired_at + INTERVAL 480 MINUTE AS expires_at FROM l WHERE rn = 1 AND acquired_at + INTERVAL 480 MINUTE >= {NOW})
"""


def _locks(spark, sf_dir) -> DataFrame:
    return coordination.lock_state(view(spark, sf_dir, "v_lock_log"), _now(), 480)


@query(with_views("v_lock_log") + ",\n" + _LOCKS + "SELECT agent_id, project, pattern, acquired_at, expires_at FROM locks")
def lock_state(spark, sf_dir):
    return _locks(spark, sf_dir).select("agent_id", "project", "pattern", "acquired_at", "expires_at")


@query(with_views("v_lock_log") + ",\n" + _LOCKS + """, c AS (SELECT a.agent_id AS agent_a, b.agent_id AS agent_b, a.pattern AS pa, b.pattern AS pb FROM locks a, locks b WHERE a.agent_id < b.agent_id AND (a.pattern GLOB b.pattern OR b.pattern GLOB a.pattern)),
p AS (SELECT agent_a, agent_b, pa AS pattern FROM c UNION SELECT agent_a, agent_b, pb FROM c)
SELECT agent_a, agent_b, list(pattern ORDER BY pattern) AS patterns FROM p GROUP BY agent_a, agent_b""")
def lock_conflicts(spark, sf_dir):
    return coordination.lock_conflicts(_locks(spark, sf_dir))


def _wanted(spark) -> DataFrame:
    return spark.range(10).select(F.concat(F.lit("new-"), "id").alias("wanted_agent"), F.lit("click").alias("project"), F.concat(F.lit("src/k"), "id", F.lit("*")).alias("wanted_pattern"))


_WANTED = "w AS (SELECT concat('new-', CAST(range AS VARCHAR)) AS wanted_agent, 'click' AS project, concat('src/k', CAST(range AS VARCHAR), '*') AS wanted_pattern FROM range(10))"


@query(with_views("v_lock_log") + ",\n" + _LOCKS + ", " + _WANTED + """, c AS (SELECT wanted_agent, agent_id, pattern, row_number() OVER (PARTITION BY wanted_agent ORDER BY acquired_at, seq) AS rn FROM w JOIN locks ON w.project = locks.project WHERE wanted_pattern GLOB pattern OR pattern GLOB wanted_pattern)
SELECT wanted_agent, agent_id, pattern FROM c WHERE rn = 1""")
def lock_acquire_conflict(spark, sf_dir):
    return coordination.first_conflicts(_locks(spark, sf_dir), _wanted(spark)).select("wanted_agent", "agent_id", "pattern")


@query(with_views("v_lock_log") + ",\n" + _LOCKS + "SELECT DISTINCT f.file_path, agent_id, project, pattern FROM locks, (SELECT concat('src/k', CAST(range AS VARCHAR), '.py') AS file_path FROM range(40)) f WHERE f.file_path GLOB pattern OR pattern GLOB f.file_path")
def lock_query_file(spark, sf_dir):
    paths = spark.range(40).select(F.concat(F.lit("src/k"), "id", F.lit(".py")).alias("file_path"))
    return coordination.locks_on(_locks(spark, sf_dir).select("agent_id", "project", "pattern"), paths).select("file_path", "agent_id", "project", "pattern")


_CHANGED = "f AS (SELECT DISTINCT file_path, 'BUILDING' AS project, concat('agent-', CAST(memory_id % 40 AS VARCHAR)) AS author FROM v_anchors)"


def _changed(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "v_anchors").select("file_path", F.lit("BUILDING").alias("project"), F.concat(F.lit("agent-"), F.col("memory_id") % 40).alias("author")).distinct()


@query(with_views("v_subs", "v_anchors") + ", " + _CHANGED + "\nSELECT agent_id, f.project, file_pattern, file_path, author FROM f JOIN v_subs s ON s.project = f.project WHERE file_path GLOB file_pattern AND agent_id <> author")
def notify_fanout(spark, sf_dir):
    return coordination.notify(view(spark, sf_dir, "v_subs"), _changed(spark, sf_dir))


@query(with_views("v_subs") + """, w AS (SELECT DISTINCT agent_id, project, replace(file_pattern, '*', '?.py') AS file_pattern FROM v_subs)
SELECT agent_id, project, file_pattern FROM w WHERE NOT EXISTS (SELECT 1 FROM v_subs s WHERE s.agent_id = w.agent_id AND s.project = w.project AND s.file_pattern = w.file_pattern)""")
def subscribe_new(spark, sf_dir):
    subs = view(spark, sf_dir, "v_subs")
    wanted = subs.select("agent_id", "project", F.replace("file_pattern", F.lit("*"), F.lit("?.py")).alias("file_pattern"))
    return coordination.subscribe_new(subs, wanted)


@query(with_views("v_notifs") + "\nSELECT id, subscriber_agent_id, created_at FROM v_notifs WHERE read_at IS NULL")
def unread_notifications(spark, sf_dir):
    return coordination.unread(view(spark, sf_dir, "v_notifs")).select("id", "subscriber_agent_id", "created_at")


_FILES = "f AS (SELECT concat('src/f', CAST(range AS VARCHAR), '.py') AS file_path FROM range(0, 60, 3))"


def _merged(spark) -> DataFrame:
    return spark.range(0, 60, 3).select(F.concat(F.lit("src/f"), "id", F.lit(".py")).alias("file_path"))


@query(with_views("v_subs", "v_vec", "v_anchors", "v_memory", "v_lock_log") + ",\n" + _LOCKS + ", " + _FILES + """,
k AS (SELECT agent_id, replace(pattern, 'src/k', 'src/f') AS pattern, acquired_at FROM locks WHERE project = 'click'),
h AS (SELECT agent_id, pattern, row_number() OVER (PARTITION BY agent_id ORDER BY acquired_at, pattern) AS rn FROM k, f WHERE file_path GLOB pattern OR pattern GLOB file_path)
SELECT 'locked_agent' AS kind, agent_id AS key, pattern AS detail FROM h WHERE rn = 1
UNION ALL SELECT 'subscribed_agent', agent_id, min(file_pattern) FROM v_subs, f WHERE project = 'click' AND file_path GLOB file_pattern GROUP BY agent_id
UNION ALL SELECT DISTINCT 'overlay', collection, '' FROM v_vec JOIN f USING (file_path) WHERE contains(collection, '__')
UNION ALL SELECT 'stale_anchor', CAST(anchor_id AS VARCHAR), file_path FROM v_anchors JOIN f USING (file_path) JOIN v_memory m ON m.id = memory_id WHERE NOT archived""".replace("project = 'click' AND file_path GLOB file_pattern", "project = 'BUILDING' AND file_path GLOB file_pattern"))
def merge_impact(spark, sf_dir):
    locks = _locks(spark, sf_dir).filter("project = 'click'").withColumns({"pattern": F.replace("pattern", F.lit("src/k"), F.lit("src/f")), "project": F.lit("BUILDING")})
    return coordination.merge_impact(_merged(spark), "BUILDING", locks, view(spark, sf_dir, "v_subs"), view(spark, sf_dir, "v_vec"), view(spark, sf_dir, "v_anchors"), view(spark, sf_dir, "v_memory"))


@query(with_views("v_subs", "v_anchors", "v_memory", "v_lock_log") + ",\n" + _LOCKS + ", " + _FILES + """
SELECT 'notification' AS kind, concat(agent_id, ' ', file_pattern, ' ', file_path) AS key FROM v_subs, f WHERE project = 'BUILDING' AND file_path GLOB file_pattern
UNION ALL SELECT 'stale_anchor', CAST(anchor_id AS VARCHAR) FROM v_anchors JOIN f USING (file_path) JOIN v_memory m ON m.id = memory_id WHERE NOT archived
UNION ALL SELECT 'lock', concat(agent_id, ' ', project) FROM locks WHERE NOT (project = 'click' AND branch = 'feat/x')""")
def notify_merge_state(spark, sf_dir):
    anchors, nodes, locks = view(spark, sf_dir, "v_anchors"), view(spark, sf_dir, "v_memory"), _locks(spark, sf_dir)
    told, marked, _ = coordination.after_merge(_merged(spark), "BUILDING", "feat/x", view(spark, sf_dir, "v_subs"), anchors, nodes, locks)
    left = coordination.after_merge(_merged(spark), "click", "feat/x", view(spark, sf_dir, "v_subs"), anchors, nodes, locks)[2]
    a = told.select(F.lit("notification").alias("kind"), F.concat_ws(" ", "agent_id", "file_pattern", "file_path").alias("key"))
    b = marked.filter("is_stale").select(F.lit("stale_anchor").alias("kind"), F.col("anchor_id").cast("string").alias("key"))
    return a.unionByName(b).unionByName(left.select(F.lit("lock").alias("kind"), F.concat_ws(" ", "agent_id", "project").alias("key")))


@query(f"""WITH s AS (SELECT concat('agent-', CAST(user_id AS VARCHAR)) AS agent_id, min(ts) AS connected_at, max(ts) AS last_activity_at FROM events GROUP BY user_id)
SELECT *, CASE WHEN last_activity_at < {NOW} - INTERVAL 5 MINUTE THEN 'disconnected' WHEN last_activity_at < {NOW} - INTERVAL 2 MINUTE THEN 'idle' ELSE 'active' END AS status FROM s WHERE last_activity_at >= {NOW} - INTERVAL 24 HOUR""")
def session_status(spark, sf_dir):
    return coordination.sessions(_activity(spark, sf_dir).withColumnRenamed("ts", "seen_at"), _now())


def _activity(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.concat(F.lit("agent-"), "user_id").alias("agent_id"), "ts")


# -- sync


@query(with_views("v_files_old", "v_files_new") + """
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS status
FROM v_files_old o FULL JOIN v_files_new n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash""")
def tree_diff(spark, sf_dir):
    return sync.tree_diff(view(spark, sf_dir, "v_files_old"), view(spark, sf_dir, "v_files_new"))


@query(with_views("v_files_old") + """, a AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path, md5(string_agg(concat('f:', regexp_extract(path, '[^/]*$'), ':', hash), '' ORDER BY regexp_extract(path, '[^/]*$'))) AS hash FROM v_files_old GROUP BY 1),
b AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path, md5(string_agg(concat('d:', regexp_extract(path, '[^/]*$'), ':', hash), '' ORDER BY path)) AS hash FROM a GROUP BY 1),
c AS (SELECT '' AS path, md5(string_agg(concat('d:', path, ':', hash), '' ORDER BY path)) AS hash FROM b)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def dir_rollup(spark, sf_dir):
    return sync.folder_hashes(view(spark, sf_dir, "v_files_old"), 2)


@query("SELECT doc_id AS id, source AS file_path FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def reconcile_orphans(spark, sf_dir):
    chunks = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source"), F.col("doc_id").cast("string").alias("file_path"))
    there = _read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("file_path"))
    return sync.orphans(chunks, there).select("id", F.col("source").alias("file_path"))


@query(with_views("v_files_old", "v_files_new") + """, d AS (SELECT coalesce(o.path, n.path) AS path, n.path IS NULL AS gone FROM v_files_old o FULL JOIN v_files_new n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash)
SELECT split_part(path, '/', 1) AS top, list(path ORDER BY path) FILTER (WHERE NOT gone) AS changed, list(path ORDER BY path) FILTER (WHERE gone) AS removed FROM d GROUP BY 1""")
def changes_by_folder(spark, sf_dir):
    return sync.by_top_folder(sync.tree_diff(view(spark, sf_dir, "v_files_old"), view(spark, sf_dir, "v_files_new")))


# -- counts


@query(with_views("v_vec") + "\nSELECT replace(collection, 'code_proj__', '') AS branch, count(*) AS chunk_count FROM v_vec WHERE starts_with(collection, 'code_proj__') GROUP BY 1")
def branch_counts(spark, sf_dir):
    return stats.branch_counts(view(spark, sf_dir, "v_vec"), "proj")


@query(with_views("v_vec", "v_memory", "v_anchors", "v_lock_log", "v_subs", "v_notifs") + ",\n" + _LOCKS + f"""
SELECT 'total_chunks' AS metric, count(*) AS value FROM v_vec UNION ALL SELECT 'memory_nodes', count(*) FROM v_memory UNION ALL SELECT 'file_anchors', count(*) FROM v_anchors
UNION ALL SELECT 'active_locks', count(*) FROM locks UNION ALL SELECT 'subscriptions', count(*) FROM v_subs UNION ALL SELECT 'unread_notifications', count(*) FROM v_notifs WHERE read_at IS NULL
UNION ALL SELECT 'active_agents', count(*) FROM (SELECT user_id, max(ts) AS m FROM events GROUP BY user_id) WHERE m >= {NOW} - INTERVAL 2 MINUTE
UNION ALL SELECT 'cached_embeddings', count(*) FROM embeddings UNION ALL SELECT concat('chunks:', collection), count(*) FROM v_vec GROUP BY collection""")
def fleet_stats(spark, sf_dir):
    v = lambda name: view(spark, sf_dir, name)
    states = coordination.sessions(_activity(spark, sf_dir).withColumnRenamed("ts", "seen_at"), _now())
    return stats.fleet_stats(v("v_vec"), v("v_memory"), v("v_anchors"), _locks(spark, sf_dir), v("v_subs"), v("v_notifs"), states, _read(spark, sf_dir, "embeddings"))


@query(with_views("v_subs") + "\nSELECT agent_id, count(*) AS n, list(file_pattern ORDER BY file_pattern) AS patterns FROM v_subs GROUP BY agent_id")
def subs_by_agent(spark, sf_dir):
    return stats.subscriptions_by_agent(view(spark, sf_dir, "v_subs"))


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS kind, max(event_id) AS ord FROM events GROUP BY user_id")
def upsert_last_wins(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), F.col("event_id").alias("ord"))
    return last_wins(rows, "ord").select("id", "kind", "ord")


@query("""WITH c AS (SELECT DISTINCT md5(text) AS h FROM documents JOIN labels USING (doc_id)), d AS (SELECT md5(text) AS h FROM documents)
SELECT count(*) AS texts, count(c.h) AS hits, count(*) - count(c.h) AS misses, count(DISTINCT CASE WHEN c.h IS NULL THEN d.h END) AS to_embed FROM d LEFT JOIN c ON c.h = d.h""")
def cache_hits(spark, sf_dir):
    texts = _read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("content_hash"))
    return embedding.cache_use(texts, texts.join(_read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"))


# -- chunks

SIZE, GAP = 500, 60
_WINDOWS = f"""WITH RECURSIVE w AS (
  SELECT doc_id, text AS t, 0 AS a, 0 AS e, false AS snap, true AS first FROM documents WHERE regexp_matches(text, '\\S')
  UNION ALL
  SELECT doc_id, t, n AS a,
    CASE WHEN n + {SIZE} >= length(t) THEN length(t) WHEN contains(substr(t, n + 2, {SIZE - 1}), chr(10)) THEN n + {SIZE} - length(string_split(substr(t, n + 1, {SIZE}), chr(10))[-1]) ELSE n + {SIZE} END AS e,
    n + {SIZE} < length(t) AND contains(substr(t, n + 2, {SIZE - 1}), chr(10)) AS snap, false AS first
  FROM (SELECT *, CASE WHEN first THEN 0 WHEN snap THEN e ELSE greatest(0, e - {GAP}) END AS n FROM w WHERE first OR e < length(t))),
c AS (SELECT doc_id, a, e, substr(t, a + 1, e - a) AS content, 1 + length(substr(t, 1, a)) - length(replace(substr(t, 1, a), chr(10), '')) AS start_line,
  1 + length(substr(t, 1, e - 1)) - length(replace(substr(t, 1, e - 1), chr(10), '')) AS end_line FROM w WHERE NOT first)
"""


@query(_WINDOWS + "SELECT doc_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, md5(content) AS content_md5 FROM c WHERE regexp_matches(content, '\\S')")
def split_text(spark, sf_dir):
    rows = chunking.text_chunks(_read(spark, sf_dir, "documents"), ["doc_id"], size=SIZE, overlap=GAP)
    return rows.select("doc_id", "start_line", "end_line", F.md5("content").alias("content_md5"))


@query(_WINDOWS + "SELECT md5(concat('# src/', CAST(doc_id AS VARCHAR), '.txt (L', CAST(start_line AS VARCHAR), '-L', CAST(end_line AS VARCHAR), ')', chr(10), content)) AS content_md5, doc_id FROM c WHERE regexp_matches(content, '\\S')")
def chunk_docs(spark, sf_dir):
    rows = chunking.text_chunks(_read(spark, sf_dir, "documents"), ["doc_id"], size=SIZE, overlap=GAP)
    placed = rows.withColumns({"project": F.lit("proj"), "file_path": F.concat(F.lit("src/"), "doc_id", F.lit(".txt"))})
    return chunking.documents(placed).select(F.md5("content").alias("content_md5"), "doc_id")


@query(f"""WITH RECURSIVE p AS (
  SELECT doc_id, '' AS place, text AS t FROM documents
  UNION ALL
  SELECT doc_id, concat(place, side), CASE WHEN side = 'a' THEN substr(t, 1, cut) ELSE substr(t, cut + 1) END FROM (
    SELECT doc_id, place, t, CASE WHEN s <= 0 OR s >= length(t) THEN m ELSE s END AS cut FROM (
      SELECT *, CASE WHEN l < 0 AND r < 0 THEN m WHEN l < 0 THEN r + 1 WHEN r < 0 THEN l + 1 WHEN m - l <= r - m THEN l + 1 ELSE r + 1 END AS s FROM (
        SELECT *, length(t) // 2 AS m,
          CASE WHEN contains(substr(t, 1, length(t) // 2), chr(10)) THEN length(t) // 2 - length(string_split(substr(t, 1, length(t) // 2), chr(10))[-1]) - 1 ELSE -1 END AS l,
          CASE WHEN contains(substr(t, length(t) // 2 + 1), chr(10)) THEN length(t) // 2 + strpos(substr(t, length(t) // 2 + 1), chr(10)) - 1 ELSE -1 END AS r
        FROM p WHERE length(t) > 700))), (VALUES ('a'), ('b')) AS z(side))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS piece, md5(t) AS content_md5 FROM p WHERE length(t) <= 700""")
def cap_chunks(spark, sf_dir):
    return chunking.cap_chunks(_read(spark, sf_dir, "documents"), ["doc_id"], cap=700).select("doc_id", "piece", F.md5("content").alias("content_md5"))


@query()
def chunk_id_xxh3(spark, sf_dir):
    rows = chunking.text_chunks(_read(spark, sf_dir, "documents"), ["doc_id"], size=SIZE, overlap=GAP)
    return rows.select("doc_id", chunk_id(F.lit("proj"), F.col("doc_id").cast("string"), F.col("start_line"), F.col("end_line")).alias("chunk_id"), xxh3_hex(F.col("content")).alias("content_hash"))


# -- expressions


@query("SELECT p_partkey, regexp_replace(replace(concat('feat/', p_name, '#', p_brand), '/', '--'), '[^a-zA-Z0-9_-]', '', 'g') AS branch FROM part")
def branch_sanitize(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", X.branch_key(F.concat(F.lit("feat/"), "p_name", F.lit("#"), "p_brand")).alias("branch"))


@query(with_views("v_chunks") + "\nSELECT id, regexp_extract(file_path, '[^/]*$') AS name, regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]*$', '') AS stem, regexp_extract(file_path, '\\.[^.]*$') AS ext, split_part(file_path, '/', 1) AS top FROM v_chunks")
def path_parts(spark, sf_dir):
    p = F.col("file_path")
    return view(spark, sf_dir, "v_chunks").select("id", X.base_name(p).alias("name"), X.stem(p).alias("stem"), X.extension(p).alias("ext"), X.top_folder(p).alias("top"))


@query(with_views("v_chunks") + """, g AS (SELECT * FROM (VALUES ('src/*/f1?.en'), ('*.fr'), ('src/src[0-4]/*'), ('src/src[!0-4]/f9.*'), ('src/src1/f1.en')) AS g(pattern))
SELECT id, pattern FROM v_chunks, g WHERE file_path GLOB pattern""")
def glob_match(spark, sf_dir):
    patterns = spark.createDataFrame([("src/*/f1?.en",), ("*.fr",), ("src/src[0-4]/*",), ("src/src[!0-4]/f9.*",), ("src/src1/f1.en",)], "pattern string")
    return glob_join(view(spark, sf_dir, "v_chunks").select("id", "file_path"), patterns, "file_path", "pattern").select("id", "pattern")


@query(with_views("v_front") + """, p AS (SELECT ord, regexp_extract(text, 'type: ([a-z]*)', 1) AS node_type, regexp_extract(text, 'name: "(n[0-9]*)"', 1) AS summary, regexp_replace(substr(text, strpos(text, concat(chr(10), '---', chr(10))) + 5), '^\\s+|\\s+$', '', 'g') AS content FROM v_front)
SELECT node_type, summary, sha1(content) AS content_sha1 FROM p QUALIFY row_number() OVER (PARTITION BY content ORDER BY ord) = 1""")
def frontmatter_import(spark, sf_dir):
    parsed = files.front_matter(view(spark, sf_dir, "v_front"))
    none = spark.createDataFrame([], "content string")
    return files.new_memories(parsed, none, "ord").select("node_type", "summary", "content_sha1")


# -- streams

_GAP = "5 minutes"


@query(with_views("v_watch") + """, m AS (SELECT *, ts - lag(ts) OVER (PARTITION BY project ORDER BY ts, event_id) AS since FROM v_watch),
g AS (SELECT *, sum(CASE WHEN since IS NULL OR since > INTERVAL 5 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY ts, event_id) AS burst FROM m),
l AS (SELECT project, burst, path, arg_max(kind, (ts, event_id)) AS kind FROM g GROUP BY ALL),
b AS (SELECT project, burst, min(ts) AS started_at, count(*) AS n_events FROM g GROUP BY ALL),
c AS (SELECT project, burst, coalesce(list(path ORDER BY path) FILTER (WHERE kind <> 'deleted'), []) AS changed, coalesce(list(path ORDER BY path) FILTER (WHERE kind = 'deleted'), []) AS removed FROM l GROUP BY ALL)
SELECT project, started_at, n_events, changed, removed FROM b JOIN c USING (project, burst)""")
def watch_debounce(spark, sf_dir):
    return jobs.debounced(view(spark, sf_dir, "v_watch"), _GAP)


def _streamed(spark, sf_dir, make, mode: str = "append") -> DataFrame:
    """What a streaming query over the events writes until it has read all there is."""
    from uuid import uuid4

    _save(spark.range(1))
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid4().hex}"
    # Timers need this store; the caller's session keeps its own.
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = session.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "*events.parquet").parquet(sf_dir)
    running = make(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query()
def watch_debounce_stream(spark, sf_dir):
    watch = lambda e: e.select("event_id", F.col("event_type").alias("project"), F.concat(F.lit("f"), F.col("user_id") % 20, F.lit(".py")).alias("path"), F.when(F.col("event_id") % 4 == 0, "deleted").otherwise("modified").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return _streamed(spark, sf_dir, lambda e: jobs.debounced(watch(e), _GAP)).withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


@query()
def session_status_stream(spark, sf_dir):
    active = lambda e: e.select(F.concat(F.lit("agent-"), "user_id").alias("agent_id"), F.col("ts").cast("timestamp").alias("ts"))
    return _streamed(spark, sf_dir, lambda e: jobs.session_changes(active(e))).withColumn("at", F.col("at").cast("timestamp_ntz"))


from . import indexed, lifecycle, streams  # noqa: E402, F401  register their queries
from . import layouts  # noqa: E402, F401  register their queries
