"""The queries of this subpackage for the driver, and their SQL where SQL can express them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, hard_negatives, html, line_crf, ngram_join, packing, quality_gam, sharding, substring_dedup, suffix_dedup, whitening
from .common import small_batches, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op2_sql(max_rows: int = chat.MAX_ROWS, max_bytes: int = chat.MAX_BYTES) -> str:
    return f"""
WITH t AS (SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE role END AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, coalesce(CAST(floor(turn / {chat.PART_TURNS}) AS BIGINT), -1) AS part FROM t),
q AS (SELECT *, CAST(coalesce(sum(greatest(strlen(text), {-(-max_bytes // max_rows)})) OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {max_bytes} AS INTEGER) AS sub,
        replace(text, '<|', '< |') AS plain, translate(replace(role, '<|', '< |'), chr(10) || chr(13), '  ') AS name FROM p),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
r AS (SELECT q.*, speaker, role = speaker AS learnt,
        CASE WHEN role = speaker THEN '<|im_start|>assistant' WHEN role = 'system' THEN '<|im_start|>system' ELSE '<|im_start|>user name=' || name END || chr(10) AS head
      FROM q JOIN s ON q.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, head || plain || '<|im_end|>' || chr(10) AS seg FROM r),
e AS (SELECT *, CAST(sum(length(seg)) OVER (PARTITION BY conv_id, speaker, part, sub ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM o)
SELECT conv_id, speaker, part, sub, count(*) AS n_turns, string_agg(seg, '' ORDER BY turn NULLS FIRST, role, text) AS text,
       coalesce(list(upto - length(seg) + length(head) ORDER BY upto) FILTER (WHERE learnt), []) AS mask_starts,
       coalesce(list(upto - 1 ORDER BY upto) FILTER (WHERE learnt), []) AS mask_ends
FROM e GROUP BY conv_id, speaker, part, sub
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), joined=True)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w WHERE len(ws) >= 20),
h AS (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS span FROM s),
f AS (SELECT span, min(struct_pack(d := doc_id, a := p)) AS first FROM h GROUP BY span HAVING count(*) > 1),
r AS (SELECT h.doc_id, p FROM h JOIN f USING (span) WHERE struct_pack(d := doc_id, a := p) > first),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS k FROM r),
l AS (SELECT doc_id, list(k) AS gone FROM g GROUP BY doc_id),
k AS (SELECT doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN l USING (doc_id)),
z AS (SELECT doc_id, len(ws) AS n_words, len(gone) AS n_removed, ws, gone FROM k)
SELECT doc_id, n_words, n_removed,
       sha256(array_to_string([ws[i] FOR i IN range(1, len(ws) + 1) IF NOT list_contains(gone, i)], ' ')) AS kept_sha256
FROM z
"""


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.line_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), size=4, percent=85)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM n WINDOW same AS (PARTITION BY norm)
"""


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), added=True)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), decoded=True)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"))


def _op10_sql() -> str:
    owners = ",".join(map(str, sharding.fill_table(sharding.SHARDS, sharding.TABLE_SIZE)))
    return f"""
WITH t AS (SELECT [{owners}] AS owners),
d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS UBIGINT) % {sharding.TABLE_SIZE} AS INTEGER) AS slot FROM documents),
p AS (SELECT doc_id, slot, CAST(owners[slot + 1] AS INTEGER) AS shard FROM d, t)
SELECT doc_id, slot, shard, 'shard-' || lpad(CAST(shard AS VARCHAR), 4, '0') AS shard_name FROM p
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % hard_negatives.EVERY == 0, relabel=moved)


OP11_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda c: floor(256 * c)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
a AS (SELECT DISTINCT * FROM v WHERE vec_id % {hard_negatives.EVERY} = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS alike, v.vec_id AS id, CAST(list_sum(list_transform(list_zip(a.x, v.x), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM a JOIN v ON a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {hard_negatives.POSITIVES}),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT alike AND {hard_negatives.LEAST} * positive_score <= 100 * score AND 100 * score <= {hard_negatives.MOST} * positive_score)
SELECT * FROM n WHERE rank <= {hard_negatives.NEGATIVES}
"""


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), F.sha2("left", 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS p FROM d WHERE octet_length(b) >= 200),
h AS (SELECT r, p, md5_number(b[p:p + 199]) AS k FROM w),
t AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
s AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS gap FROM h SEMI JOIN t USING (k)),
g AS (SELECT r, p, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS span FROM s),
x AS (SELECT r, span, min(p) AS a, max(p) + 199 AS e FROM g GROUP BY ALL),
l AS (SELECT r, count(*) AS n_spans, sum(e - a + 1) AS n_removed, list(struct_pack(a := a, e := e) ORDER BY a) AS spans FROM x GROUP BY r),
c AS (SELECT doc_id, b, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed, coalesce(spans, []) AS spans FROM d LEFT JOIN l USING (r))
SELECT doc_id, octet_length(b) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans,
       sha256(CASE WHEN n_spans = 0 THEN b ELSE unhex(array_to_string(list_transform(range(1, n_spans + 2), lambda i: hex(b[(CASE WHEN i = 1 THEN 1 ELSE spans[i - 1].e + 1 END):(CASE WHEN i = n_spans + 1 THEN octet_length(b) ELSE spans[i].a - 1 END)])), '')) END) AS kept_sha256
FROM c
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def _with_small_batches(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {f.__name__: _with_small_batches(f) for f in (op1_html_density, op2_chat_rotation, op3_substring_dedup, op4_quality_gam, op5_ngram_join, op6_exact_dedup, op7_line_crf, op8_best_fit_packing, op9_byte_bpe, op10_sharding, op11_hard_negatives, op12_suffix_dedup, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_rotation": op2_sql(), "op3_substring_dedup": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op10_sharding": _op10_sql(), "op11_hard_negatives": OP11_SQL, "op12_suffix_dedup": OP12_SQL}
