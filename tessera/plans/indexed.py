"""The driver's queries that build an index over a given table and then search it."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import postings, search, tree, vectorindex
from ..operators.matching import glob_join
from .catalog import SYMBOL, TERMS, _save, query
from .views import view, with_views


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    _save(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/index-{uuid4().hex}"


PHRASES = ["of the", "And the", "the", "thble reing", "et la", "ünd dér", "no such phrase"]
_WORDS = "concat(' ', array_to_string(regexp_extract_all(strip_accents(lower({t})), '[\\p{{L}}\\p{{N}}]+'), ' '), ' ')"


@query(with_views("v_memory") + ", q AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in PHRASES) + "]) AS phrase), l AS (SELECT id, " + _WORDS.format(t="content") + " AS t FROM v_memory WHERE NOT archived)\nSELECT phrase, id FROM q JOIN l ON contains(t, " + _WORDS.format(t="phrase") + ")")
def phrase_index(spark, sf_dir):
    """All live memories that hold each of some phrases, by positions of words."""
    live = view(spark, sf_dir, "v_memory").filter("not archived")
    return postings.PhraseIndex.build(live.select("id", "content"), folder(spark)).search(PHRASES)


@query(with_views("v_memory") + ", l AS (SELECT id, node_type, " + _WORDS.format(t="content") + " AS t FROM v_memory WHERE NOT archived AND id % 7 <> 0), r AS (SELECT id + 1000000 AS id, node_type, " + _WORDS.format(t="concat('again ', content)") + " AS t FROM v_memory WHERE id % 5 = 0)\nSELECT id, node_type, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS rank FROM (SELECT * FROM l UNION ALL SELECT * FROM r) WHERE contains(t, ' of the ') QUALIFY rank <= 500")
def phrase_index_updated(spark, sf_dir):
    """The first 500 by id after memories were removed from the index and others added."""
    rows = view(spark, sf_dir, "v_memory")
    again = rows.filter("id % 5 = 0").select((F.col("id") + 1000000).alias("id"), "node_type", F.concat(F.lit("again "), "content").alias("content"))
    index = postings.PhraseIndex.build(rows.filter("not archived").select("id", "content"), folder(spark))
    index.add(again.select("id", "content"))
    index.remove(rows.filter("id % 7 = 0").select("id"))
    return postings.first_with_phrase(index, rows.select("id", "node_type").union(again.select("id", "node_type")), "of the", 500).select("id", "node_type", "rank")


def _chunks(spark, sf_dir):
    return view(spark, sf_dir, "v_chunks").select("id", "collection", "file_path", "name", "content")


_TERMS = ["thble reing.py", "thble reing", "ththth", "é", "Th", "The ", "in"]


@query(with_views("v_chunks") + f""", t AS (SELECT unnest(range({len(_TERMS)})) AS pos, unnest({_TERMS}) AS term),
h AS (SELECT id, file_path, term, row_number() OVER (PARTITION BY id ORDER BY collection, pos) AS rn FROM v_chunks, t WHERE contains(content, term) AND starts_with(collection, 'code_'))
SELECT id, file_path, term AS matched_term FROM h WHERE rn = 1""")
def change_impact_index(spark, sf_dir):
    """Chunks that hold a file's name or stem or one of some symbols, looked up by their rarest grams."""
    chunks = _chunks(spark, sf_dir)
    index = postings.GramIndex.build(chunks.select("id", "content"), folder(spark))
    return postings.change_impact(index, chunks, search.impact_terms(TERMS[:1], _TERMS[2:])).select("id", "file_path", "matched_term")


_NAMES = ", n AS (SELECT DISTINCT name AS symbol FROM v_chunks WHERE name <> ''), r AS (SELECT symbol, id FROM n JOIN v_chunks ON contains(content, symbol))"


@query(with_views("v_chunks") + _NAMES + "\nSELECT symbol, id FROM r")
def symbol_references(spark, sf_dir):
    """Every symbol that is a chunk's name with every chunk that holds it."""
    chunks, at = _chunks(spark, sf_dir), folder(spark)
    return spark.read.parquet(postings.references(None, chunks, at)).select("symbol", "id")


@query(with_views("v_chunks", recursive=True) + _NAMES + f""",
b AS (SELECT id, 1 AS depth FROM v_chunks WHERE contains(content, '{SYMBOL}')
      UNION SELECT r.id, b.depth + 1 FROM b JOIN v_chunks c ON c.id = b.id JOIN r ON r.symbol = c.name WHERE b.depth < 5 AND c.name <> '{SYMBOL}')
SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY id""")
def dependents_index(spark, sf_dir):
    """Five steps from a symbol over the stored references; names stay in tables."""
    chunks, at = _chunks(spark, sf_dir), folder(spark)
    refs = spark.read.parquet(postings.references(None, chunks, at))
    return postings.dependents(refs, None, chunks, SYMBOL, None, 5, _save)


_ENDS = """g AS (SELECT DISTINCT concat('*', right(file_path, 5)) AS pattern FROM v_chunks WHERE name = 'The'
  UNION SELECT DISTINCT concat('*/f', substr(file_path, length(file_path) - 3, 1), '*.', language) FROM v_chunks WHERE name = 'The'
  UNION SELECT unnest(['*.fr', '*/f1?.*', '*[0-4].en', '?rc/*', '*src3*', 's*9.de', '*?', '*zz*', '[s]rc/*7.e[mn]']))"""


@query(with_views("v_chunks") + f", {_ENDS}\nSELECT id, pattern FROM v_chunks JOIN g ON file_path GLOB pattern")
def glob_anywhere(spark, sf_dir):
    """Paths against patterns that begin with a wildcard: by their ends or by what they hold."""
    rows = view(spark, sf_dir, "v_chunks").select("id", "file_path", "language", "name")
    own = rows.filter("name = 'The'")
    fixed = ["*.fr", "*/f1?.*", "*[0-4].en", "?rc/*", "*src3*", "s*9.de", "*?", "*zz*", "[s]rc/*7.e[mn]"]
    made = F.concat(F.lit("*/f"), F.substring("file_path", F.length("file_path") - 3, F.lit(1)), F.lit("*."), F.col("language"))
    patterns = own.select(F.concat(F.lit("*"), F.right("file_path", F.lit(5))).alias("pattern")).union(own.select(made)).union(spark.createDataFrame([(p,) for p in fixed], "pattern string"))
    return glob_join(rows.select("id", "file_path"), patterns.distinct(), "file_path", "pattern").select("id", "pattern")


_DIFFERENCE = """SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS status
FROM v_tree_old o FULL JOIN v_tree_new n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash"""


@query(with_views("v_tree_old", "v_tree_new") + "\n" + _DIFFERENCE)
def tree_compare(spark, sf_dir):
    """What differs between two snapshots, by descent through folders of other hashes."""
    at = folder(spark)
    old, new = (tree.Snapshot.write(view(spark, sf_dir, v), at) for v in ("v_tree_old", "v_tree_new"))
    return tree.compare(old, new, _save)


_LEVEL = "SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path, md5(string_agg(concat('{kind}:', regexp_extract(path, '[^/]*$'), ':', hash), '' ORDER BY regexp_extract(path, '[^/]*$'))) AS hash FROM {source} GROUP BY 1"


@query(with_views("v_tree_old", "v_tree_new") + ", a AS (" + _LEVEL.format(kind="f", source="v_tree_new") + "), b AS (" + _LEVEL.format(kind="d", source="a") + "), c AS (" + _LEVEL.format(kind="d", source="b") + """),
r AS (SELECT '' AS path, md5(string_agg(concat('d:', path, ':', hash), '' ORDER BY path)) AS hash FROM c)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM r""")
def tree_update(spark, sf_dir):
    """All folders' hashes after the changed files' folders, up to the root, have been hashed again."""
    old, new = view(spark, sf_dir, "v_tree_old"), view(spark, sf_dir, "v_tree_new")
    snapshot = tree.Snapshot.write(old, folder(spark))
    both = old.select("path", F.col("hash").alias("was")).join(new, "path", "full_outer")
    tree.update(snapshot, both.filter(~F.col("was").eqNullSafe(F.col("hash"))).select("path", "hash"), save=_save)
    return snapshot.folder_hashes()


@query()
def ann_topk_pq(spark, sf_dir):
    """About the nearest ten of every twentieth row against all, by quantised codes and exact scores."""
    rows = view(spark, sf_dir, "v_vec")
    index = vectorindex.VectorIndex.build(rows.select("id", "embedding"), folder(spark))
    return index.search(rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), 10)


_NEAR = ", p AS (SELECT a.id AS query_id, b.id, round(1.0 / (1.0 + list_sum(list_transform(list_zip(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9) AS score FROM v_vec a, v_vec b WHERE a.id % 20 = 0), e AS (SELECT query_id, id FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)"


@query(with_views("v_vec") + _NEAR + "\nSELECT count(*) AS wanted, count(DISTINCT query_id) AS queries, true AS enough FROM e")
def ann_recall(spark, sf_dir):
    """Whether the quantised index finds nine tenths of what the exact search finds, for every twentieth row."""
    rows = view(spark, sf_dir, "v_vec")
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    exact = _save(search.top_k_each(rows, asked, 10))
    share = vectorindex.recall(ann_topk_pq(spark, sf_dir), exact)
    return exact.agg(F.count("*").alias("wanted"), F.count_distinct("query_id").alias("queries")).withColumn("enough", F.lit(share >= 0.9))
