"""A corpus pipeline of five stages over ``documents``: quality, exact copies, near copies, repeated passages, packing.

Each stage works on all that its predecessor kept, read back from Parquet. All but the last return the columns of
documents.

In every stage a null text counts as an empty one where it is read and stays null where it is returned, rows of a null
doc_id take part as each stage says, other columns may have any names and are handed on unread, and a table without
rows gives none. Long texts are worked on whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, ngram_join, packing, quality_gam, substring_dedup
from tessera.llm.common import delete, shared_folder, small_batches, table
from tessera.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality model, trained here on labelled documents, scores 0.7 or more.

    Null and empty texts are scored, as texts without words; repeated rows get one score; a score of just 0.7 stays.
    Rows without a doc_id are scored too. Without labels of both kinds all scores are the labels' share (0.5 without any),
    so nothing below 0.7 stays.
    """
    small_batches(spark)
    return quality_gam.keep_good(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the one of the smallest doc_id.

    Null and empty texts are equal to each other; of rows that repeat doc_id and text one stays; a row without a
    doc_id stays only where no row of the same text has one.
    """
    small_batches(spark)
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group linked by five-word shingles with a similarity of 0.8 or more the smallest doc_id.

    Texts without words and rows without a doc_id are linked with nothing and stay; of a similarity of just 0.8 one
    goes; rows that repeat a doc_id stay or go together.
    """
    small_batches(spark)
    found = ngram_join.ngram_join(docs.select("doc_id", "text"), size=5, percent=80)
    gone = found.filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 20 words or more that also stand earlier in the corpus; every document stays, with what is left.

    Null texts stay null, empty ones empty, as may be what is left; rows without a doc_id lose nothing; rows that
    repeat doc_id and text are one place and lose the same.
    """
    small_batches(spark)
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = substring_dedup.substring_dedup(docs, keep=keep)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents that are left into sequences of at most 1024 tokens.

    A null or empty text is its end mark alone; repeated rows are packed each; a null doc_id stays null.
    """
    small_batches(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), added=True)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("substrings", substrings), ("pack", pack)]

#: No stage but the second could be put in SQL; see the brute-force tests of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each stage returns is written to the shared folder, read back, and deleted after its successor."""
    docs, folder, last = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            delete(spark, f"{folder}/{last}")
        last = name
    # The last stage has its pieces in a checkpoint of its own when it returns.
    packed = STAGES[-1][1](spark, docs, sf_dir)
    delete(spark, folder)
    return packed
