"""The driver's queries over logs laid out by day, trees made of the documents, and collections in buckets."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import memory, search, stats
from ..sources import daylog, embedding, files, indexer, walk
from ..sources.store import Store
from .catalog import ORACLES, _now, _read, _save, query
from .indexed import folder
from .views import view, with_views


@query(ORACLES["memory_feed"])
def memory_feed_days(spark, sf_dir):
    """The feed of the last ten hours from a log by day."""
    nodes = _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("user_id").cast("string").alias("agent_id"), F.col("event_type").alias("node_type"), F.col("ts").alias("created_at"), F.lit(False).alias("archived"))
    log = daylog.DayLog(spark, folder(spark), "id long, user_id long, agent_id string, node_type string, created_at timestamp_ntz, archived boolean", "created_at")
    log.append(nodes)
    return memory.feed(log.rows(X.before(_now(), 600)), _now(), "5", 600).select("id", "user_id", "node_type", "created_at")


_LOCK_COLUMNS = "seq long, agent_id string, project string, pattern string, acquired_at timestamp_ntz, branch string"


@query(ORACLES["lock_state"])
def lock_state_days(spark, sf_dir):
    """Locks in force, from the days that can still hold one."""
    log = daylog.DayLog(spark, folder(spark), _LOCK_COLUMNS, "acquired_at")
    log.append(view(spark, sf_dir, "v_lock_log"))
    return daylog.locks_in_force(log, _now(), 480).select("agent_id", "project", "pattern", "acquired_at", "expires_at")


@query(with_views("v_lock_log") + "\nSELECT agent_id, project, arg_max(pattern, (acquired_at, seq)) AS pattern, max(acquired_at) AS acquired_at FROM v_lock_log GROUP BY ALL")
def newest_locks_days(spark, sf_dir):
    """Each agent's newest lock, from a snapshot of half the days and the days after it."""
    log = daylog.DayLog(spark, folder(spark), _LOCK_COLUMNS, "acquired_at")
    log.append(view(spark, sf_dir, "v_lock_log"))
    for day in (dt.date(2024, 1, 10), dt.date(2024, 1, 15)):
        log.snapshot(["agent_id", "project"], ["acquired_at", "seq"], day)
    return log.state(["agent_id", "project"], ["acquired_at", "seq"]).select("agent_id", "project", "pattern", "acquired_at")


@query(with_views("v_notifs") + "\nSELECT id, created_at FROM v_notifs ORDER BY created_at DESC, id DESC LIMIT 500")
def newest_notices_days(spark, sf_dir):
    """The newest 500 notifications, from the last days that have so many."""
    log = daylog.DayLog(spark, folder(spark), "id long, subscriber_agent_id string, created_at timestamp_ntz, read_at timestamp_ntz", "created_at")
    log.append(view(spark, sf_dir, "v_notifs"))
    return log.newest(500, F.desc("id")).select("id", "created_at")


@query(ORACLES["search_all_collections"])
def search_partitioned(spark, sf_dir):
    """The nearest ten of all code collections, which lie in partitions, so others are not read."""
    at = folder(spark)
    rows = view(spark, sf_dir, "v_vec")
    other = rows.withColumns({"collection": F.lit("docs_proj"), "id": F.col("id") + 10**9})
    rows.union(other).repartition("collection").write.partitionBy("collection").parquet(at)
    query_vector = list(rows.filter("id = 0").select("embedding").first()[0])
    return search.top_k(spark.read.parquet(at), query_vector, 10, F.col("collection").startswith("code_")).select("id", "collection", "file_path", "score")


# -- trees

_EXT = "CASE WHEN doc_id % 5 = 0 THEN 'md' WHEN doc_id % 5 = 1 THEN 'bin' WHEN doc_id % 5 = 2 THEN 'PY' ELSE 'py' END"
_TOP = "CASE WHEN doc_id % 11 = 0 THEN 'node_modules/' WHEN doc_id % 13 = 0 THEN 'secret/' WHEN doc_id % 17 = 0 THEN '.hid/' WHEN doc_id % 19 = 0 THEN 'lib/build/' ELSE '' END"
_PATH = "concat({top}, 'src/', source, '/k', CAST(doc_id % 7 AS {s}), CASE WHEN doc_id % 23 = 0 THEN '/tmp_' ELSE '/f' END, CAST(doc_id AS {s}), '.', {ext})"
IGNORE = "# made\n*.log\nsecret/\ntmp_*\nsrc/*/k6\n"


def _made(spark: SparkSession, sf_dir: str) -> str:
    """A tree of the documents, with ignored, hidden and skipped folders, written by executors; a path that Python reads."""
    root = re.sub(r"^file:/*", "/", folder(spark))
    rows = _read(spark, sf_dir, "documents").select(F.expr(_PATH.format(top=_TOP, ext=_EXT, s="STRING")).alias("path"), "text")
    walk.write_tree(rows.union(spark.createDataFrame([(".gitignore", IGNORE)], "path string, text string")), root)
    return root


_TREE = "t AS (SELECT " + _PATH.format(top=_TOP, ext=_EXT, s="VARCHAR") + " AS path, source, doc_id, text FROM documents)"
_WALKED = "doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 19 <> 0 AND doc_id % 5 <> 1 AND doc_id % 23 <> 0 AND doc_id % 7 <> 6 AND strlen(text) <= 1048576"


@query(f"WITH {_TREE} SELECT path AS file_path, CASE WHEN doc_id % 5 = 0 THEN 'markdown' ELSE 'python' END AS language, md5(text) AS text_md5 FROM t WHERE {_WALKED}")
def tree_walk(spark, sf_dir):
    """The files of a tree of the documents that are to be indexed, listed level by level."""
    return walk.scan_tree(spark, _made(spark, sf_dir), "p").select("file_path", "language", F.md5("text").alias("text_md5"))


@query(f"WITH {_TREE} SELECT path, md5(text) AS hash FROM t WHERE doc_id % 11 <> 0 AND (doc_id % 19 <> 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0) UNION ALL SELECT '.gitignore', md5('{IGNORE}')".replace("\n", "' || chr(10) || '"))
def tree_walk_hash(spark, sf_dir):
    """Hashes of all of the tree's files but those in folders that are never hashed."""
    return walk.hashes(spark, _made(spark, sf_dir), "md5")


@query(f"WITH {_TREE} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS status FROM (SELECT path, md5(text) AS hash FROM t WHERE doc_id % 11 <> 0 AND (doc_id % 19 <> 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0)) o FULL JOIN (SELECT path, md5(CASE WHEN doc_id % 29 = 0 THEN '' ELSE text END) AS hash FROM t WHERE doc_id % 11 <> 0 AND (doc_id % 19 <> 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0) AND doc_id % 31 <> 0) n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash")
def snapshot_walk(spark, sf_dir):
    """What a saved snapshot of the tree's hashes and the next differ in."""
    from ..operators.sync import tree_diff

    root, at = _made(spark, sf_dir), folder(spark)
    files.save_snapshot(walk.hashes(spark, root, "md5"), at, "p")
    old = files.load_snapshot(spark, at, "p")
    again = _made_again(spark, sf_dir)
    files.save_snapshot(walk.hashes(spark, again, "md5"), at, "p")
    return tree_diff(old, files.load_snapshot(spark, at, "p"))


def _made_again(spark: SparkSession, sf_dir: str) -> str:
    root = re.sub(r"^file:/*", "/", folder(spark))
    rows = _read(spark, sf_dir, "documents").filter("doc_id % 31 <> 0").select(F.expr(_PATH.format(top=_TOP, ext=_EXT, s="STRING")).alias("path"), F.expr("CASE WHEN doc_id % 29 = 0 THEN '' ELSE text END").alias("text"))
    walk.write_tree(rows.union(spark.createDataFrame([(".gitignore", IGNORE)], "path string, text string")), root)
    return root


@query("""WITH f AS (SELECT conv_id, turn, concat('p', CAST(conv_id % 9 AS VARCHAR), CASE WHEN turn % 5 = 4 THEN '/notes/' ELSE '/memory/' END, 'm', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR), CASE WHEN turn % 7 = 6 THEN '.txt' ELSE '.md' END) AS path, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content FROM conversations),
k AS (SELECT * FROM f WHERE turn % 5 <> 4 AND turn % 7 <> 6 AND content <> '')
SELECT role AS node_type, 'n' || CAST(turn AS VARCHAR) AS summary, sha1(content) AS content_sha1, path FROM k QUALIFY row_number() OVER (PARTITION BY content ORDER BY path) = 1""")
def import_folder(spark, sf_dir):
    """Memory files of all projects' folders below a root, found by pattern, parsed, and each text once."""
    root = re.sub(r"^file:/*", "/", folder(spark))
    rows = _read(spark, sf_dir, "conversations").filter(F.regexp_replace("text", r"^\s+|\s+$", "") != "")
    kind = F.when(F.col("turn") % 5 == 4, "/notes/").otherwise("/memory/")
    path = F.concat(F.lit("p"), F.col("conv_id") % 9, kind, F.lit("m"), "conv_id", F.lit("-"), "turn", F.when(F.col("turn") % 7 == 6, ".txt").otherwise(".md"))
    text = F.concat(F.lit("---\ntype: "), "role", F.lit('\nname: "n'), "turn", F.lit('"\n---\n'), "text")
    walk.write_tree(rows.select(path.alias("path"), text.alias("text")), root)
    parsed = files.front_matter(walk.memory_files(spark, root))
    return files.new_memories(parsed, spark.createDataFrame([], "content string"), "path").select("node_type", "summary", "content_sha1", "path")


# -- the store

@query(with_views("v_vec") + "\nSELECT id, CASE WHEN id % 50 = 7 THEN 99 ELSE label END AS label FROM v_vec WHERE id % 100 <> 3 UNION ALL SELECT 5000000, 1")
def store_buckets(spark, sf_dir):
    """A collection after some ids were changed, some deleted and one added, in the buckets that they are in."""
    store = Store(spark, folder(spark))
    rows = view(spark, sf_dir, "v_vec").select(F.col("id").cast("string").alias("id"), "label", "embedding", F.lit(1).alias("ord"))
    store.upsert("c", rows, "ord")
    changed = rows.filter("cast(id as long) % 50 = 7").withColumn("label", F.lit(99))
    store.upsert("c", changed.union(rows.filter("id = '0'").withColumns({"id": F.lit("5000000"), "label": F.lit(1)})), "ord")
    store.delete("c", rows.filter("cast(id as long) % 100 = 3").select("id"))
    return store.read("c").select(F.col("id").cast("long").alias("id"), "label")


@query("SELECT path, error FROM (SELECT CAST(event_id AS VARCHAR) AS path, CASE WHEN user_id % 3 = 0 THEN 'bad' END AS error FROM events) WHERE error IS NOT NULL")
def index_errors(spark, sf_dir):
    """The files that an index run failed on, a row each."""
    rows = _read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.lit(1).alias("chunks"), F.when(F.col("user_id") % 3 == 0, "bad").alias("error"))
    return stats.index_errors(rows)


_REPOS = "concat('r', CAST(doc_id % 3 AS {s}), '/docs/d', CAST(doc_id % 5 AS {s}), '/f', CAST(doc_id AS {s}), '.md')"


def _repositories(spark: SparkSession, sf_dir: str) -> str:
    """A folder of three repositories and one folder that is none, of the documents' texts."""
    root = re.sub(r"^file:/*", "/", folder(spark))
    rows = _read(spark, sf_dir, "documents").select(F.expr(_REPOS.format(s="STRING")).alias("path"), "text")
    extra = [(f"r{i}/.git/HEAD", "ref") for i in range(3)] + [("none/f.md", "no repository")]
    walk.write_tree(rows.union(spark.createDataFrame(extra, "path string, text string")), root)
    return root


@query(f"SELECT split_part(path, '/', 1) AS project, count(*) AS file_count, true AS has_chunks FROM (SELECT {_REPOS.format(s='VARCHAR')} AS path, text FROM documents WHERE regexp_matches(text, '\\S')) GROUP BY 1")
def repositories_index(spark, sf_dir):
    """Every repository below a folder indexed, and what the status says of each."""
    store, root = Store(spark, folder(spark)), _repositories(spark, sf_dir)
    done = indexer.index_repositories(store, root, embedding.HashProvider())
    rows = [(s["project"], s["file_count"], s["chunk_count"] >= s["file_count"]) for s in (indexer.index_status(store, p) for p in sorted(done))]
    return spark.createDataFrame(rows, "project string, file_count long, has_chunks boolean")


@query(f"""WITH t AS (SELECT doc_id, substr({_REPOS.format(s='VARCHAR')}, 4) AS file_path, text FROM documents WHERE doc_id % 3 = 0),
n AS (SELECT doc_id, file_path, CASE WHEN doc_id % 4 = 0 THEN concat('changed ', text) ELSE text END AS text FROM t WHERE doc_id % 9 <> 0)
SELECT file_path, md5(text) AS text_md5 FROM n WHERE regexp_matches(text, '\\S')""")
def index_sync(spark, sf_dir):
    """A project's files after two rounds of sync, between which some were changed and some deleted."""
    store, provider = Store(spark, folder(spark)), embedding.HashProvider()
    caps = indexer.Caps(10**7)
    rows = _read(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select("doc_id", F.expr(f"substr({_REPOS.format(s='STRING')}, 4)").alias("path"), "text")
    first, second = (re.sub(r"^file:/*", "/", folder(spark)) for _ in range(2))
    walk.write_tree(rows, first)
    indexer.sync(store, first, "p", provider, caps)
    later = rows.filter("doc_id % 9 <> 0").withColumn("text", F.expr("CASE WHEN doc_id % 4 = 0 THEN concat('changed ', text) ELSE text END"))
    walk.write_tree(later, second)
    indexer.sync(store, second, "p", provider, caps)
    held = _save(store.read("code_p").select(F.col("file_path").alias("path")).distinct())
    return walk.texts(spark, second, "p", held).select("file_path", F.md5("text").alias("text_md5"))


@query(with_views("v_vec") + "\nSELECT collection, 64 AS dimension, count(*) AS n, false AS refused FROM v_vec WHERE collection = 'code_proj' GROUP BY 1 UNION ALL SELECT 'code_short', 8, count(*), true FROM v_vec WHERE collection <> 'code_proj'")
def collections_validate(spark, sf_dir):
    """Collections of two lengths, and which a model of 64 entries may not use."""
    from ..operators.search import DimensionMismatch

    store = Store(spark, folder(spark))
    rows = view(spark, sf_dir, "v_vec").select(F.col("id").cast("string").alias("id"), "collection", "embedding", F.lit(1).alias("ord"))
    store.upsert("code_proj", rows.filter("collection = 'code_proj'"), "ord")
    short = rows.filter("collection <> 'code_proj'").withColumn("embedding", F.slice("embedding", 1, 8))
    store.upsert("code_short", short, "ord")
    out = []
    try:
        store.validate(64)
        refused = None
    except DimensionMismatch as e:
        refused = e.collection
    for r in store.collections().orderBy("collection").collect():
        out.append((r["collection"], r["dimension"], store.count(r["collection"]), r["collection"] == refused))
    return spark.createDataFrame(out, "collection string, dimension int, n long, refused boolean")


@query(with_views("v_vec") + "\nSELECT collection, count(*) AS n FROM v_vec WHERE collection = 'code_proj' GROUP BY 1")
def branch_cleanup(spark, sf_dir):
    """What collections are left after a branch's overlay was dropped by the workspace's tool."""
    from ..workspace import Workspace

    work = Workspace(spark, folder(spark), embedding.HashProvider())
    rows = view(spark, sf_dir, "v_vec").select(F.col("id").cast("string").alias("id"), "collection", "embedding", F.lit(1).alias("ord"))
    for name in ("code_proj", "code_proj__feat--x"):
        work.store.upsert(name, rows.filter(F.col("collection") == name), "ord")
    assert work.cleanup_branch("proj", "feat/x")["dropped"]
    return spark.createDataFrame([(r["collection"], work.store.count(r["collection"])) for r in work.store.collections().collect()], "collection string, n long")
