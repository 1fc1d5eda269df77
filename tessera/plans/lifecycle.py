"""More of the driver's queries: sources, the store's and the index's life, states after a tool has run, expressions, streams."""

from __future__ import annotations

import os
import re
from pathlib import Path
from uuid import uuid4

import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.hashing import pack_floats, unpack_floats, xxh3_hex
from ..operators import chunking, coordination, memory, search, stats, sync
from ..sources import embedding, files, indexer
from ..sources.store import Store
from ..streaming import jobs
from .catalog import _GAP, _LOCKS, NOW, ORACLES, _activity, _locks, _now, _read, _save, _streamed, query
from .views import view, with_views


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, as a path that Spark and Python read."""
    _save(spark.range(1))
    return re.sub(r"^file:/*", "/", f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}")


def _tree(spark: SparkSession, texts: dict[str, str]) -> str:
    root = _folder(spark, "tree")
    for path, text in texts.items():
        Path(root, path).parent.mkdir(parents=True, exist_ok=True)
        Path(root, path).write_text(text)
    return root


# -- sources

TREE = {f"src/f{i}.py": f"x = {i}\n" for i in range(20)} | {
    ".gitignore": "# none\n*.log\nsecret/\n", "a.log": "x", "secret/k.py": "x", "node_modules/m.js": "x", ".hid/z.py": "x", "pkg/__init__.py": "", "README.md": "# r\n", "data.bin": "x", "big.txt": "x" * (files.LARGEST + 1),
}


@query("""SELECT concat('src/f', CAST(range AS VARCHAR), '.py') AS file_path, 'python' AS language, md5(concat('x = ', CAST(range AS VARCHAR), chr(10))) AS text_md5 FROM range(20)
UNION ALL SELECT * FROM (VALUES ('pkg/__init__.py', 'python', md5('')), ('README.md', 'markdown', md5(concat('# r', chr(10)))))""")
def tree_scan(spark, sf_dir):
    return files.scan_files(spark, _tree(spark, TREE), "p").select("file_path", "language", F.md5("text").alias("text_md5"))


@query("""SELECT concat('src/f', CAST(range AS VARCHAR), '.py') AS path, md5(concat('x = ', CAST(range AS VARCHAR), chr(10))) AS hash FROM range(20)
UNION ALL SELECT path, md5(text) FROM (VALUES ('.gitignore', concat('# none', chr(10), '*.log', chr(10), 'secret/', chr(10))), ('a.log', 'x'), ('secret/k.py', 'x'), ('.hid/z.py', 'x'), ('pkg/__init__.py', ''), ('README.md', concat('# r', chr(10))), ('data.bin', 'x')) t(path, text)""")
def tree_scan_hash(spark, sf_dir):
    return files.scan_hashes(spark, _tree(spark, {k: v for k, v in TREE.items() if k != "big.txt"}), digest="md5")


_EXTENSIONS = [*X.LANGUAGES, "", ".none"]
_LABELS = [*X.LANGUAGES.values(), "unknown", "unknown"]


@query(f"""SELECT doc_id, {_LABELS}[doc_id % {len(_LABELS)} + 1] AS language FROM documents""")
def language_map(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("doc_id") % len(_EXTENSIONS) + 1).cast("int"))
    return _read(spark, sf_dir, "documents").select("doc_id", X.language_of(F.concat(F.lit("a.b/F"), "doc_id", F.upper(suffix))).alias("language"))


@query("SELECT vec_id AS id, CASE WHEN label = 1 THEN label + 100 ELSE label END AS label FROM embeddings WHERE label <> 3 AND vec_id % 7 <> 0")
def store_lifecycle(spark, sf_dir):
    store = Store(spark, _folder(spark, "store"))
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), "embedding", F.lit(1).alias("ord"))
    store.create("c", 64)
    store.upsert("c", rows, "ord")
    store.upsert("c", rows.filter("label = 1").unionByName(rows.filter("label = 1").withColumns({"label": F.col("label") + 100, "ord": F.lit(2)})), "ord")
    store.delete_where("c", F.col("label") == 3)
    store.delete("c", rows.filter("id % 7 = 0").select("id"))
    store.upsert("gone", rows.limit(1), "ord")
    store.drop("gone")
    assert [r["collection"] for r in store.collections().collect()] == ["c"]
    return store.read("c").select("id", "label")


def _program(i: int, value: int) -> str:
    return f"def f{i}():\n    return {value}\n"


@query("""WITH f AS (SELECT 'code_p' AS collection, range AS i, CASE WHEN range = 3 THEN 33 ELSE range END AS v FROM range(10) WHERE range NOT IN (5, 6) UNION ALL SELECT 'code_p__b', 7, 77)
SELECT collection, concat('f', CAST(i AS VARCHAR), '.py') AS file_path, concat('f', CAST(i AS VARCHAR)) AS name, concat('# f', CAST(i AS VARCHAR), '.py (L1-L2)', chr(10), 'def f', CAST(i AS VARCHAR), '():', chr(10), '    return ', CAST(v AS VARCHAR)) AS content FROM f""")
def index_lifecycle(spark, sf_dir):
    """Indexed, changed, synchronised, reconciled, and a branch's overlay on top."""
    root = _tree(spark, {f"f{i}.py": _program(i, i) for i in range(10)})
    store, provider = Store(spark, _folder(spark, "store")), embedding.HashProvider()
    indexer.index_codebase(store, root, "p", provider)
    files.save_snapshot(files.scan_hashes(spark, root), store.snapshots, "p")
    Path(root, "f3.py").write_text(_program(3, 33))
    os.remove(f"{root}/f5.py")
    indexer.sync_once(store, root, "p", provider)
    os.remove(f"{root}/f6.py")
    indexer.reconcile(store, root, "p")
    Path(root, "f7.py").write_text(_program(7, 77))
    indexer.index_branch(store, root, "p", "code_p__b", ["f7.py"], provider)
    return store.read("code_p").unionByName(store.read("code_p__b")).select("collection", "file_path", "name", "content")


@query("SELECT * FROM (VALUES ('p', 'indexed', 10, 10), ('q', 'not_indexed', 0, 0)) t(project, status, file_count, chunk_count)")
def index_status(spark, sf_dir):
    """The status of an indexed project, and of one that was cleared."""
    root = _tree(spark, {f"f{i}.py": _program(i, i) for i in range(10)})
    store, provider = Store(spark, _folder(spark, "store")), embedding.HashProvider()
    indexer.index_codebase(store, root, "p", provider)
    indexer.index_codebase(store, root, "q", provider)
    indexer.clear_index(store, "q")
    rows = [indexer.index_status(store, x) for x in "pq"]
    return spark.createDataFrame([(r["project"], r["status"], r["file_count"], r["chunk_count"]) for r in rows], "project string, status string, file_count int, chunk_count int")


# -- chunks

SOURCES = {
    "python": "import os\n\n\ndef greet(name):\n    return name\n\n\nclass K:\n    def m(self):\n        x = 1\n        return x\n\n    def s(self): return 1\n",
    "typescript": "import a from 'a';\n\nexport function Hello(p: P) {\n  return p;\n}\n\nexport class Counter {\n  private n = 0;\n\n  add() {\n    this.n++;\n  }\n}\n\nconst f = (a) => a;\n",
    "go": 'package main\n\ntype T struct {\n\ta int\n}\n\nfunc main() {\n\tx := "}"\n}\n',
    "rust": "use a::b;\n\nimpl A for B {\n    fn c(&self) {\n        1\n    }\n}\n\nenum E { X }\n",
    "text": "only text\n",
}


@query("""SELECT * FROM (VALUES ('python', 0, 'module_header', NULL, NULL, 1, 4), ('python', 1, 'function', 'greet', NULL, 4, 5), ('python', 2, 'function', 'm', 'K', 9, 11),
  ('typescript', 0, 'module_header', NULL, NULL, 1, 3), ('typescript', 1, 'export', 'Hello', NULL, 3, 5), ('typescript', 2, 'function', 'add', 'Counter', 10, 12), ('typescript', 3, 'variable', NULL, NULL, 15, 15),
  ('go', 0, 'module_header', NULL, NULL, 1, 3), ('go', 1, 'type', NULL, NULL, 3, 5), ('go', 2, 'function', 'main', NULL, 7, 9),
  ('rust', 0, 'module_header', NULL, NULL, 1, 3), ('rust', 1, 'function', 'c', 'B', 4, 6), ('rust', 2, 'enum', 'E', NULL, 9, 9), ('text', 0, 'text', NULL, NULL, 1, 1)) t(language, piece, chunk_type, name, parent_name, start_line, end_line)""")
def split_source(spark, sf_dir):
    rows = spark.createDataFrame([("p", f"f.{k}", k, v) for k, v in SOURCES.items()], "project string, file_path string, language string, text string")
    found = chunking.source_chunks(rows).select("language", "chunk_type", "name", "parent_name", "start_line", "end_line", "content")
    found = found.filter(F.trim(F.regexp_replace("content", r"\s", " ")) != "")
    order = F.row_number().over(search.Window.partitionBy("language").orderBy("start_line", "end_line")) - 1
    return found.withColumn("piece", order).drop("content")


@query(ORACLES["cap_chunks"])
def token_cap(spark, sf_dir):
    """Pieces of at most so many tokens, where each character counts as two."""
    return chunking.cap_chunks(_read(spark, sf_dir, "documents"), ["doc_id"], cap=0, tokens=lambda t: 2 * len(t), most=1400).select("doc_id", "piece", F.md5("content").alias("content_md5"))


_KINDS = "class_definition function_definition method_definition impl_item struct_item enum_item type_declaration export_statement lexical_declaration decorated_definition".split()


@query("SELECT * FROM (VALUES ('class_definition', 'class'), ('function_definition', 'function'), ('method_definition', 'function'), ('impl_item', 'impl'), ('struct_item', 'struct'), ('enum_item', 'enum'), ('type_declaration', 'type'), ('export_statement', 'export'), ('lexical_declaration', 'variable'), ('decorated_definition', 'definition')) t(kind, label)")
def chunk_labels(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in _KINDS], "kind string").select("kind", X.chunk_label(F.col("kind")).alias("label"))


# -- memory


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 200) ELSE source END AS summary, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat(lang, ',', source) END AS keywords, false AS archived FROM documents""")
def memory_store_rows(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents")
    new = rows.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")).alias("summary"), F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source")).alias("keywords"))
    none = spark.createDataFrame([], "id long, content string, summary string, keywords string, archived boolean")
    return memory.store(none, new).select("id", "summary", "keywords", "archived")


@query(with_views("v_files_now") + """, n AS (SELECT doc_id, concat('src/f', CAST(doc_id % 60 AS VARCHAR), '.py') AS file_path FROM documents WHERE doc_id % 2 = 0)
SELECT md5(concat(CAST(doc_id AS VARCHAR), ':', file_path)) AS anchor_id, doc_id AS memory_id, file_path, hash AS stored_hash, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 9 AS INTEGER) END AS line_start, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 9 + 4 AS INTEGER) END AS line_end, false AS is_stale FROM n JOIN v_files_now USING (file_path)""")
def anchors_new(spark, sf_dir):
    span = F.when(F.col("doc_id") % 3 == 0, F.concat((F.col("doc_id") % 9).cast("string"), F.lit("-"), (F.col("doc_id") % 9 + 4).cast("string"))).when(F.col("doc_id") % 3 == 1, "5").otherwise("a-b-c")
    new = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("src/f"), F.col("doc_id") % 60, F.lit(".py"))).alias("file_path"), span.alias("line_range"))
    return memory.anchors_for(new, view(spark, sf_dir, "v_files_now"))


@query(with_views("v_memory") + "\nSELECT id, node_type FROM v_memory WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1) OR id = 5")
def node_lookup(spark, sf_dir):
    nodes = view(spark, sf_dir, "v_memory").select("id", "node_type")
    wanted = _read(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return memory.nodes_of(nodes, wanted).union(memory.node(nodes, 5)).distinct()


_NIBBLES = "list_transform(range(1, 9), lambda i: CAST(CAST(CAST(concat('0x', substr(md5({t}), i, 1)) AS INTEGER) / 15.0 AS DOUBLE) AS FLOAT))"


@query(with_views("v_memory") + "\nSELECT id, " + _NIBBLES.format(t="content") + " AS embedding FROM v_memory WHERE NOT archived AND id % 5 <> 0")
def backfill_embed(spark, sf_dir):
    nodes = view(spark, sf_dir, "v_memory")
    return memory.backfilled(nodes, nodes.filter("id % 5 = 0").select("id"), lambda rows: embedding.embed(rows, embedding.HashProvider()))


class _ShortProvider(embedding.HashProvider):
    """Takes no text of over 1000 characters, so longer ones are halved, and their halves again."""

    def _one(self, texts: list[str]) -> list[list[float]]:
        if any(len(t) > 1000 for t in texts):
            raise embedding.TextTooLong
        return super().embed_batch(texts)

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return embedding.halved(self._one, texts)


@query("""WITH RECURSIVE p AS (SELECT doc_id, text AS t, CAST(1.0 AS DOUBLE) AS share FROM documents
  UNION ALL SELECT doc_id, CASE WHEN side = 0 THEN substr(t, 1, length(t) // 2) ELSE substr(t, length(t) // 2 + 1) END, share / 2 FROM p, (VALUES (0), (1)) z(side) WHERE length(t) > 1000),
n AS (SELECT doc_id, share, unnest(range(1, 9)) AS i, unnest(""" + _NIBBLES.format(t="t") + """) AS v FROM p WHERE length(t) <= 1000),
d AS (SELECT doc_id, i, sum(share * CAST(v AS DOUBLE)) AS x FROM n GROUP BY ALL)
SELECT doc_id, list(round(x + 0.0000003, 4) ORDER BY i) AS embedding FROM d GROUP BY doc_id""")
def embed_halved(spark, sf_dir):
    """Whole texts, halved until each piece is short enough; a text's vector is the mean of its halves'."""
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return embedding.embed(rows, _ShortProvider()).select("doc_id", F.transform(F.col("embedding"), lambda x: F.round(x.cast("double") + 0.0000003, 4)).alias("embedding"))


@query("SELECT doc_id, text IN (SELECT text FROM documents WHERE doc_id % 3 = 0) AS hit, " + _NIBBLES.format(t="text") + " AS embedding FROM documents")
def embed_cached(spark, sf_dir):
    rows, provider = _read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), embedding.HashProvider()
    empty = spark.createDataFrame([], Store.CACHE)
    cache = _save(embedding.embed_cached(rows.filter("doc_id % 3 = 0"), empty, provider)[1])
    return embedding.embed_cached(rows, cache, provider)[0].select("doc_id", "hit", "embedding")


# -- states


@query(with_views("v_files_old", "v_files_new") + "\nSELECT path AS file_path, hash FROM v_files_new WHERE path IN (SELECT path FROM v_files_old)")
def changed_restriction(spark, sf_dir):
    now = view(spark, sf_dir, "v_files_new").withColumnRenamed("path", "file_path")
    return sync.changed_only(now, view(spark, sf_dir, "v_files_old").select(F.col("path").alias("file_path")))


@query(with_views("v_files_old", "v_files_new") + "\nSELECT path AS file_path, hash FROM v_files_new WHERE path NOT IN (SELECT path FROM v_files_old)")
def removed_files(spark, sf_dir):
    now = view(spark, sf_dir, "v_files_new").withColumnRenamed("path", "file_path")
    return sync.without_files(now, view(spark, sf_dir, "v_files_old").select(F.col("path").alias("file_path")))


_MODIFIED = "m AS (SELECT concat('src/k', CAST(range AS VARCHAR), '.py') AS path FROM range(200))"


@query(with_views("v_lock_log") + ",\n" + _LOCKS + f", {_MODIFIED}\nSELECT path FROM m WHERE path NOT IN (SELECT pattern FROM locks WHERE agent_id <> 'agent-1')")
def lockable_files(spark, sf_dir):
    paths = spark.range(200).select(F.concat(F.lit("src/k"), "id", F.lit(".py")).alias("path"))
    return coordination.lockable(paths, _locks(spark, sf_dir).filter("agent_id <> 'agent-1'"))


@query(with_views("v_lock_log", "v_subs") + ",\n" + _LOCKS + f""", {_MODIFIED}
SELECT 'lock' AS kind, path FROM m WHERE NOT EXISTS (SELECT 1 FROM locks WHERE project = 'click' AND agent_id <> 'agent-1' AND (path GLOB pattern OR pattern GLOB path))
UNION ALL SELECT 'subscription', path FROM m WHERE path NOT IN (SELECT file_pattern FROM v_subs WHERE agent_id = 'agent-1' AND project = 'click')""")
def auto_coordinate(spark, sf_dir):
    paths = spark.range(200).select(F.concat(F.lit("src/k"), "id", F.lit(".py")).alias("path"))
    held, heard = coordination.auto_coordinate(view(spark, sf_dir, "v_lock_log"), view(spark, sf_dir, "v_subs"), paths, "agent-1", "click", _now(), matched=True)
    return held.select(F.lit("lock").alias("kind"), F.col("pattern").alias("path")).union(heard.select(F.lit("subscription"), "file_pattern"))


@query(with_views("v_lock_log") + ",\n" + _LOCKS + "SELECT agent_id, project, pattern FROM locks WHERE NOT (agent_id = 'agent-1' AND project = 'click')")
def lock_release(spark, sf_dir):
    return coordination.release(_locks(spark, sf_dir), "agent-1", "click").select("agent_id", "project", "pattern")


@query(with_views("v_lock_log") + ",\n" + _LOCKS + f"SELECT agent_id, project, CASE WHEN agent_id = 'agent-1' THEN {NOW} + INTERVAL 480 MINUTE ELSE expires_at END AS expires_at FROM locks")
def lock_heartbeat(spark, sf_dir):
    return coordination.heartbeat(_locks(spark, sf_dir), "agent-1", _now()).select("agent_id", "project", "expires_at")


@query(f"""WITH s AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id), n AS (SELECT user_id FROM s WHERE user_id % 2 = 0)
SELECT concat('agent-', CAST(user_id AS VARCHAR)) AS agent_id, CASE WHEN user_id % 2 = 0 THEN 'feat' ELSE 'main' END AS branch, a AS connected_at, CASE WHEN user_id % 2 = 0 THEN {NOW} + INTERVAL 1 DAY ELSE b END AS last_activity_at, 'active' AS status FROM s""")
def session_register(spark, sf_dir):
    seen = _activity(spark, sf_dir).groupBy("agent_id").agg(F.min("ts").alias("connected_at"), F.max("ts").alias("last_activity_at"))
    known = seen.withColumns({"branch": F.lit("main"), "status": F.lit("idle")})
    later = _now() + F.expr("INTERVAL 1 DAY")
    again = known.filter("cast(substring(agent_id, 7) as long) % 2 = 0").withColumns({"branch": F.lit("feat"), "connected_at": later, "last_activity_at": later, "status": F.lit("active")})
    return coordination.register(known, again).select("agent_id", "branch", "connected_at", "last_activity_at", "status")


@query(f"SELECT concat('agent-', CAST(user_id AS VARCHAR)) AS agent_id FROM (SELECT user_id, max(ts) AS m FROM events GROUP BY user_id) WHERE m >= {NOW} - INTERVAL 5 MINUTE")
def sessions_pruned(spark, sf_dir):
    return coordination.pruned(coordination.sessions(_activity(spark, sf_dir).withColumnRenamed("ts", "seen_at"), _now())).select("agent_id")


@query(with_views("v_notifs") + f"\nSELECT id, CASE WHEN subscriber_agent_id = 'agent-1' AND read_at IS NULL THEN {NOW} ELSE read_at END AS read_at FROM v_notifs")
def notifications_read(spark, sf_dir):
    return coordination.mark_read(view(spark, sf_dir, "v_notifs"), "agent-1", _now()).select("id", "read_at")


@query(with_views("v_notifs") + "\nSELECT id, created_at FROM v_notifs ORDER BY created_at DESC, id DESC LIMIT 50")
def last_notifications(spark, sf_dir):
    return stats.latest_notifications(view(spark, sf_dir, "v_notifs")).select("id", "created_at")


@query(with_views("v_lock_log") + ",\n" + _LOCKS + f""", s AS (SELECT concat('agent-', CAST(user_id AS VARCHAR)) AS agent_id, max(ts) AS m FROM events GROUP BY user_id)
SELECT agent_id, agent_id IN (SELECT agent_id FROM locks) AS has_lock, concat('...', right(concat('/work/trees/of/many/agents/that/work/', agent_id), 37)) AS worktree, strftime(m, '%Y-%m-%d %H:%M:%S') AS shown,
  m >= {NOW} - INTERVAL 5 MINUTE AS listed FROM s WHERE m >= {NOW} - INTERVAL 24 HOUR AND contains(agent_id, 'nt-1')""")
def agents_board(spark, sf_dir):
    """Agents of the last day by part of their names in any case, with flags, shortened columns, and whether the list without disconnected ones has them."""
    seen = coordination.sessions(_activity(spark, sf_dir).withColumnRenamed("ts", "seen_at"), _now()).withColumn("worktree_path", F.concat(F.lit("/work/trees/of/many/agents/that/work/"), "agent_id"))
    shown = stats.agents_view(seen, _locks(spark, sf_dir), "NT-1")
    there = stats.agents_view(seen, _locks(spark, sf_dir), "NT-1", hide_disconnected=True).select("agent_id", F.lit(True).alias("listed"))
    flags = shown.join(there, "agent_id", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return flags.select("agent_id", "has_lock", "worktree", X.shown_time(F.col("last_activity_at")).alias("shown"), "listed")


@query("""SELECT CAST(sum(CASE WHEN user_id % 3 <> 0 THEN event_id % 5 ELSE 0 END) AS BIGINT) AS inserted, count(*) FILTER (WHERE user_id % 3 <> 0) AS succeeded, count(*) FILTER (WHERE user_id % 3 = 0) AS failed, count(*) FILTER (WHERE user_id % 3 = 0) AS errors FROM events""")
def index_counters(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.when(F.col("user_id") % 3 != 0, F.col("event_id") % 5).otherwise(0).alias("chunks"), F.when(F.col("user_id") % 3 == 0, "bad").alias("error"))
    return stats.index_counts(rows).withColumn("errors", F.col("failed"))


@query("SELECT event_type AS metric, event_id AS taken_at, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS INTEGER) AS age FROM events QUALIFY age <= 60")
def history_samples(spark, sf_dir):
    return stats.recent_history(_read(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.col("event_id").alias("taken_at")))


@query(with_views("v_chunks") + "\nSELECT id FROM v_chunks WHERE name = 'The' AND starts_with(collection, 'code_') AND chunk_type = 'class' AND file_path = (SELECT min(file_path) FROM v_chunks WHERE name = 'The' AND chunk_type = 'class')")
def find_symbol_in_file(spark, sf_dir):
    rows = view(spark, sf_dir, "v_chunks")
    path = rows.filter("name = 'The' and chunk_type = 'class'").agg(F.min("file_path")).first()[0] or ""
    return search.find_symbol(rows, "The", path, "class").select("id")


@query("SELECT n, greatest(1, least(n, 100)) AS top_k, greatest(1, least(n, 5)) AS depth FROM (SELECT CAST(range - 20 AS INTEGER) AS n FROM range(200))")
def argument_clamps(spark, sf_dir):
    return spark.createDataFrame([(n, search.clamp(n), search.clamp(n, 1, 5)) for n in range(-20, 180)], "n int, top_k int, depth int")


@query(with_views("v_vec") + "\nSELECT collection, CASE collection WHEN 'code_proj' THEN 64 ELSE 8 END AS dimension, count(*) AS n, len(embedding) <> CASE collection WHEN 'code_proj' THEN 64 ELSE 8 END AS refused FROM v_vec GROUP BY ALL")
def dimension_guard(spark, sf_dir):
    """Which collections refuse the vectors that they are given, by all vectors' lengths."""
    known, rows = {"code_proj": 64}, []
    for r in view(spark, sf_dir, "v_vec").groupBy("collection", F.size("embedding").alias("got")).agg(F.count("*").alias("n")).collect():
        dimension = known.get(r["collection"], 8)
        try:
            search.check_dimension(dimension, r["got"], "m", r["collection"])
            rows.append((r["collection"], dimension, r["n"], False))
        except search.DimensionMismatch:
            rows.append((r["collection"], dimension, r["n"], True))
    return spark.createDataFrame(rows, "collection string, dimension int, n long, refused boolean")


# -- expressions


@query("SELECT range AS id, h AS hash FROM range(200) JOIN (SELECT unnest(range(200)) AS range, unnest([" + ", ".join(f"'{xxhash.xxh3_64_hexdigest(f'text-{i}é')}'" for i in range(200)) + "]) AS h) USING (range)")
def xxh3_values(spark, sf_dir):
    return spark.range(200).select("id", xxh3_hex(F.concat(F.lit("text-"), "id", F.lit("é"))).alias("hash"))


@query(r"""SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines, string_split(text, chr(10))[1] AS first, substr(text, 1, 60) AS shown FROM documents""")
def line_facts(spark, sf_dir):
    t = F.col("text")
    return _read(spark, sf_dir, "documents").select("doc_id", X.line_count(t).alias("n_lines"), X.first_line(t).alias("first"), X.shown_text(t).alias("shown"))


@query(with_views("v_subs") + """, g AS (SELECT agent_id, list(file_pattern ORDER BY file_pattern) AS patterns FROM v_subs GROUP BY agent_id)
SELECT agent_id, concat('["', array_to_string(patterns, '","'), '"]') AS packed, len(patterns) AS n FROM g""")
def patterns_json(spark, sf_dir):
    rows = stats.subscriptions_by_agent(view(spark, sf_dir, "v_subs")).select("agent_id", X.patterns_json(F.col("patterns")).alias("packed"))
    return rows.select("agent_id", "packed", F.size(X.patterns_of(F.col("packed"))).cast("long").alias("n"))


@query("SELECT vec_id, embedding, 4 * len(embedding) AS bytes FROM embeddings")
def packed_vectors(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", pack_floats(F.col("embedding")).alias("blob"))
    return rows.select("vec_id", unpack_floats(F.col("blob")).alias("embedding"), F.length("blob").cast("long").alias("bytes"))


@query("SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda p: round((CAST(p[1] AS DOUBLE) + CAST(p[2] AS DOUBLE)) / 2, 6)) AS mean FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def mean_vectors(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    both = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return both.select("vec_id", F.transform(X.mean_vector(F.col("a"), F.col("b")), lambda x: X.rounded(x, 6)).alias("mean"))


@query("SELECT p_partkey, concat('merge:', p_brand) AS author, concat('merge-', p_brand, '-', substr(md5(p_name), 1, 8)) AS id FROM part")
def merge_names(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", X.merge_author(F.col("p_brand")).alias("author"), X.merge_id(F.col("p_brand"), F.md5("p_name")).alias("id"))


@query("SELECT * FROM (VALUES (400, 'the input length exceeds', true), (400, 'Context Length of 8', true), (400, 'prompt too long', true), (400, 'bad model', false), (500, 'too long', false)) t(status, message, overflow)")
def overflow_errors(spark, sf_dir):
    cases = [(400, "the input length exceeds"), (400, "Context Length of 8"), (400, "prompt too long"), (400, "bad model"), (500, "too long")]
    return spark.createDataFrame([(*c, embedding.overflowed(*c)) for c in cases], "status int, message string, overflow boolean")


# -- streams


@query(with_views("v_subs") + """, f AS (SELECT DISTINCT event_id, concat('src/f', CAST(user_id % 60 AS VARCHAR), '.py') AS file_path, concat('agent-', CAST(event_id % 40 AS VARCHAR)) AS author FROM events)
SELECT agent_id, file_pattern, file_path, author FROM f JOIN v_subs ON project = 'BUILDING' WHERE file_path GLOB file_pattern AND agent_id <> author""")
def notify_stream(spark, sf_dir):
    changed = lambda e: e.select(F.lit("BUILDING").alias("project"), F.concat(F.lit("src/f"), F.col("user_id") % 60, F.lit(".py")).alias("file_path"), F.concat(F.lit("agent-"), F.col("event_id") % 40).alias("author"))
    # The stream stores what each change matches; notifications are made of it where they are read.
    matched = _streamed(spark, sf_dir, lambda e: jobs.matched_changes(changed(e), view(spark, sf_dir, "v_subs")))
    return jobs.delivered(matched, view(spark, sf_dir, "v_subs")).select("agent_id", "file_pattern", "file_path", "author")


@query("SELECT DISTINCT concat('n', CAST(user_id AS VARCHAR)) AS id FROM events")
def consumed_once_stream(spark, sf_dir):
    """Repeated deliveries within the watermark come out once."""
    told = lambda e: e.select(F.concat(F.lit("n"), "user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return _streamed(spark, sf_dir, lambda e: jobs.last_seen(told(e), "id", "60 days")).select("id")


@query(ORACLES["tree_diff"])
def poll_round(spark, sf_dir):
    """One round of the polling loop: the difference that it hands on."""
    handed, saved = [], []
    jobs.compared(spark, lambda: view(spark, sf_dir, "v_files_new"), lambda: view(spark, sf_dir, "v_files_old"), saved.append, handed.append)
    assert len(saved) == 1
    return handed[0]


ORACLES["watch_debounce_stream"] = ORACLES["watch_debounce"].replace("WITH ", "WITH last AS (SELECT max(ts) - INTERVAL 10 SECOND AS mark FROM events), ", 1).replace("min(ts) AS started_at, count(*) AS n_events FROM g GROUP BY ALL", f"min(ts) AS started_at, count(*) AS n_events FROM g GROUP BY ALL HAVING max(ts) + INTERVAL {_GAP} <= (SELECT mark FROM last)")
ORACLES["session_status_stream"] = """WITH s AS (SELECT concat('agent-', CAST(user_id AS VARCHAR)) AS agent_id, max(ts) AS m FROM events GROUP BY user_id), w AS (SELECT max(ts) - INTERVAL 1 MINUTE AS mark FROM events)
SELECT agent_id, 'active' AS status, date_trunc('millisecond', m) AS at FROM s UNION ALL SELECT agent_id, status, date_trunc('millisecond', m) + after AS at FROM s, w, (VALUES ('idle', INTERVAL 2 MINUTE), ('disconnected', INTERVAL 5 MINUTE), ('gone', INTERVAL 24 HOUR)) t(status, after)
WHERE date_trunc('millisecond', m) + after <= mark"""

