"""The engine's logical tables as views over the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = {"v_chunks": "documents", "v_vec": "embeddings", "v_memory": "documents", "v_anchors": "documents", "v_files_old": "documents", "v_files_new": "documents", "v_files_now": "documents", "v_lock_log": "events", "v_subs": "customer", "v_notifs": "events", "v_front": "conversations", "v_watch": "events", "v_tree_old": "documents", "v_tree_new": "documents"}

_TEXT = {
    "v_chunks": """SELECT concat('c', CAST(doc_id AS {S})) AS id, CASE WHEN doc_id % 4 = 0 THEN 'code_proj__feat--x' ELSE 'code_proj' END AS collection,
        concat('src/', source, '/f', CAST(doc_id % 97 AS {S}), '.', lang) AS file_path, lang AS language, regexp_extract(text, '^([A-Za-z]+)', 1) AS name,
        CASE WHEN doc_id % 3 = 0 THEN 'class' ELSE 'function' END AS chunk_type, source AS project_name, text AS content FROM {T}""",
    "v_vec": """SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN 'code_proj__feat--x' ELSE 'code_proj' END AS collection,
        concat('src/f', CAST(vec_id % 50 AS {S}), '.py') AS file_path, label, embedding FROM {T}""",
    "v_memory": """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'pattern' ELSE 'note' END AS node_type, text AS content, source AS project_path, doc_id % 11 = 0 AS archived FROM {T}""",
    "v_anchors": """SELECT doc_id AS anchor_id, doc_id AS memory_id, concat('src/f', CAST(doc_id % 60 AS {S}), '.py') AS file_path, md5(CAST(doc_id % 60 AS {S})) AS stored_hash FROM {T}""",
    "v_files_old": """SELECT concat('d', CAST(doc_id % 7 AS {S}), '/e', CAST(doc_id % 3 AS {S}), '/f', CAST(doc_id AS {S}), '.txt') AS path, md5(text) AS hash FROM {T} WHERE doc_id % 13 <> 0""",
    "v_files_new": """SELECT concat('d', CAST(doc_id % 7 AS {S}), '/e', CAST(doc_id % 3 AS {S}), '/f', CAST(doc_id AS {S}), '.txt') AS path, CASE WHEN doc_id % 17 = 0 THEN md5(concat(text, '!')) ELSE md5(text) END AS hash FROM {T} WHERE doc_id % 19 <> 0""",
    "v_files_now": """SELECT DISTINCT concat('src/f', CAST(doc_id % 60 AS {S}), '.py') AS file_path, CASE WHEN doc_id % 60 % 5 = 0 THEN md5('changed') ELSE md5(CAST(doc_id % 60 AS {S})) END AS hash FROM {T} WHERE doc_id % 60 % 7 <> 0""",
    "v_lock_log": """SELECT event_id AS seq, concat('agent-', CAST(user_id AS {S})) AS agent_id, event_type AS project,
        concat('src/k', regexp_extract(props, '([0-9]+)', 1), CASE WHEN event_id % 5 = 0 THEN '*' ELSE '.py' END) AS pattern, ts AS acquired_at,
        CASE WHEN event_id % 6 = 0 THEN 'feat/x' ELSE 'main' END AS branch FROM {T}""",
    "v_subs": """SELECT concat('agent-', CAST(c_custkey % 40 AS {S})) AS agent_id, c_mktsegment AS project, concat('src/f', CAST(c_custkey % 9 AS {S}), CASE WHEN c_custkey % 2 = 0 THEN '*' ELSE '?.py' END) AS file_pattern FROM {T}""",
    "v_notifs": """SELECT event_id AS id, concat('agent-', CAST(user_id AS {S})) AS subscriber_agent_id, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN ts END AS read_at FROM {T}""",
    "v_front": """SELECT conv_id * 1000 + turn AS ord, concat('---', chr(10), 'type: ', role, chr(10), 'name: "n', CAST(turn AS {S}), '"', chr(10), '---', chr(10), text) AS text FROM {T}""",
    "v_watch": """SELECT event_id, event_type AS project, concat('f', CAST(user_id % 20 AS {S}), '.py') AS path, CASE WHEN event_id % 4 = 0 THEN 'deleted' ELSE 'modified' END AS kind, ts FROM {T}""",
    "v_tree_old": """SELECT concat('d', CAST(doc_id % 7 AS {S}), '/e', CAST(doc_id % 31 AS {S}), '/g', CAST(doc_id % 5 AS {S}), '/f', CAST(doc_id AS {S}), '.txt') AS path, md5(text) AS hash FROM {T}""",
    "v_tree_new": """SELECT concat(CASE WHEN doc_id % 217 = 5 THEN 'new' ELSE 'd' END, CAST(doc_id % 7 AS {S}), '/e', CAST(doc_id % 31 AS {S}), '/g', CAST(doc_id % 5 AS {S}), '/f', CAST(doc_id AS {S}), '.txt') AS path,
        CASE WHEN doc_id % 217 = 3 THEN md5(concat(text, '!')) ELSE md5(text) END AS hash FROM {T} WHERE doc_id % 217 <> 8""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{SOURCES[name]}.parquet")
    return spark.sql(_TEXT[name].format(S="STRING", T="{source}"), source=rows)


def with_views(*names: str, recursive: bool = False) -> str:
    """The head of a DuckDB statement that has these views."""
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(f"{n} AS ({_TEXT[n].format(S='VARCHAR', T=SOURCES[n])})" for n in names)
