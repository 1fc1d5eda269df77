"""Versioned Parquet collections: upserts, deletions and drops as new versions of hash buckets behind a pointer."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import check_dimension


def last_wins(rows: DataFrame, order: str, key: str = "id") -> DataFrame:
    """Of rows with one key, the last by ``order``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Hash buckets of a collection by id; a change rewrites those that hold its ids.
BUCKETS = 16
_BUCKET = "store_bucket"


def bucket(key: str = "id") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class Store:
    """Collections under one folder. Rows lie in hash buckets by id; the newest pointer names each bucket's current folder.

    A write makes new folders for the buckets that it touches and then the collection's pointer, so readers see
    either the old or the new, and other buckets' files stay as they are. Writers of one collection must take turns.
    """

    POINTER = "collection string, version string, dimension int, seq long, buckets map<string,string>"

    CACHE = "content_hash string, provider string, embedding array<float>"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.snapshots = spark, folder, f"{folder}/snapshots"

    def _pointers(self) -> DataFrame:
        try:
            log = self.spark.read.schema(self.POINTER).json(f"{self.folder}/pointers")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.POINTER)
        return log.groupBy("collection").agg(F.max_by(F.struct("version", "dimension", "seq", "buckets"), "seq").alias("r")).select("collection", "r.*").filter(F.col("version").isNotNull())

    def _point(self, collection: str, version: str | None, dimension: int | None, buckets: dict[int, str] | None = None) -> None:
        past = self._pointers_all().filter(F.col("collection") == collection).agg(F.max("seq")).first()[0]
        named = {str(b): v for b, v in (buckets or {}).items()}
        self.spark.createDataFrame([(collection, version, dimension, (past or 0) + 1, named)], self.POINTER).coalesce(1).write.mode("append").json(f"{self.folder}/pointers")

    def _pointers_all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.POINTER).json(f"{self.folder}/pointers")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.POINTER)

    def collections(self) -> DataFrame:
        return self._pointers().select("collection", "dimension")

    def has(self, collection: str) -> bool:
        return not self._pointers().filter(F.col("collection") == collection).isEmpty()

    def create(self, collection: str, dimension: int | None) -> None:
        if not self.has(collection):
            self._point(collection, "", dimension)

    def _current(self, collection: str) -> tuple[dict[int, str], int | None] | None:
        """The folder of each of a collection's buckets, and its dimension."""
        row = self._pointers().filter(F.col("collection") == collection).first()
        return None if row is None else ({int(b): v for b, v in (row["buckets"] or {}).items()}, row["dimension"])

    def _read(self, buckets: dict[int, str]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.folder}/data/{v}/{_BUCKET}={b}" for b, v in sorted(buckets.items())]) if buckets else None

    def read(self, collection: str) -> DataFrame | None:
        now = self._current(collection)
        return self._read(now[0]) if now else None

    def _rewrite(self, collection: str, touched: set[int], rows: DataFrame, now: dict[int, str], dimension: int | None) -> None:
        """``rows`` as the new contents of the ``touched`` buckets. A collection that loses all rows keeps its columns."""
        version = uuid.uuid4().hex
        path = f"{self.folder}/data/{version}"
        rows.withColumn(_BUCKET, bucket()).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(path)
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        made = [f.getPath().getName() for f in place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)]
        left = {b: v for b, v in now.items() if b not in touched} | {int(n.split("=")[1]): version for n in made if n.startswith(f"{_BUCKET}=")}
        if not left:
            rows.limit(0).write.parquet(f"{path}/{_BUCKET}=0")
            left = {0: version}
        self._point(collection, version, dimension, left)

    def upsert(self, collection: str, rows: DataFrame, order: str, model: str = "the model", without: DataFrame | None = None) -> None:
        """Adds rows, the last of each id by ``order``, in place of those of the same ids and of the ids in ``without``.

        ``rows`` are computed once, into a table of their own that is checked before the new version is made: every
        row needs a vector of the collection's length. So what fails leaves the collection as it was.
        """
        made = f"{self.folder}/data/{uuid.uuid4().hex}"
        last_wins(rows, order).drop(order).write.parquet(made)
        new = self.spark.read.parquet(made)
        try:
            blank = [r[0] for r in new.filter(F.col("embedding").isNull()).select("id").limit(5).collect()]
            if blank:
                raise ValueError(f"rows without a vector: {blank}")
            buckets, known = self._current(collection) or ({}, None)
            sizes = new.agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
            for got in {sizes["lo"], sizes["hi"]} - {None}:
                check_dimension(known, got, model, collection)
            gone = new.select("id") if without is None else new.select("id").union(without.select("id"))
            touched = {r[0] for r in gone.select(bucket()).distinct().collect()}
            old = self._read({b: v for b, v in buckets.items() if b in touched})
            both = new if old is None else old.join(gone.distinct(), "id", "left_anti").unionByName(new)
            self._rewrite(collection, touched, both, buckets, known if known is not None else sizes["lo"])
        finally:
            remove(self.spark, made)

    def delete(self, collection: str, ids: DataFrame) -> None:
        self._replace(collection, lambda old: old.join(ids.select("id").distinct(), "id", "left_semi"))

    def delete_where(self, collection: str, condition: Column) -> None:
        self._replace(collection, lambda old: old.filter(F.coalesce(condition, F.lit(False))))

    def _replace(self, collection: str, gone) -> None:
        """Leaves out what ``gone`` picks, by writing only the buckets that it is in."""
        buckets, dimension = self._current(collection) or ({}, None)
        if not buckets:
            return
        touched = {r[0] for r in gone(self._read(buckets)).select(bucket()).distinct().collect()}
        old = self._read({b: v for b, v in buckets.items() if b in touched})
        if old is not None:
            self._rewrite(collection, touched, old.join(gone(old).select("id").distinct(), "id", "left_anti"), buckets, dimension)

    def drop(self, collection: str) -> None:
        if self.has(collection):
            self._point(collection, None, None)

    def count(self, collection: str) -> int:
        rows = self.read(collection)
        return 0 if rows is None else rows.count()

    def cached(self) -> DataFrame:
        """The embedding cache: a row for each content_hash and provider."""
        try:
            rows = self.spark.read.schema(self.CACHE).parquet(f"{self.folder}/embedding_cache")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.CACHE)
        return rows.filter(F.col("embedding").isNotNull()).dropDuplicates(["content_hash", "provider"])

    def cache(self, rows: DataFrame) -> None:
        """Appends rows; cached() leaves out those without a vector, as a filter here would embed them twice."""
        rows.write.mode("append").parquet(f"{self.folder}/embedding_cache")

    def clear_cache(self) -> None:
        self.spark.createDataFrame([], self.CACHE).write.mode("overwrite").parquet(f"{self.folder}/embedding_cache")

    def validate(self, dimension: int) -> None:
        """Raises for the first collection of another dimension."""
        for r in self._pointers().filter(F.col("dimension").isNotNull() & (F.col("dimension") != dimension)).orderBy("collection").limit(1).collect():
            check_dimension(r["dimension"], dimension, "the model", r["collection"])
