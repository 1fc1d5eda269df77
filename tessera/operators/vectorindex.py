"""An approximate vector index: inverted lists of product-quantised codes, exact scores for what they leave.

Vectors go to the cell of the nearest centre; what is left of them there is coded by parts, one byte a part. Codes
are a few hundredths of the vectors, and lie apart from them: a search reads the codes of the cells it probes, takes
the ``refine`` times k likeliest by distances to codes, and reads just those vectors, whose exact scores decide.
Centres and code books are fitted on a bounded sample; every vector is in the index.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..shared import checkpointed
from .search import DIGITS, clamp, top_k_each

#: Vectors of least hash that centres and code books are fitted on; entries of a part; codes of a part.
SAMPLE_ROWS, PART, CODES, ROUNDS = 20_000, 4, 256, 8
#: Vectors of a cell on average and cells at most; cells that a query probes; candidates for each row asked for.
CELL_ROWS, MOST_CELLS, PROBES, REFINE = 1_000, 4_096, 32, 4
#: Codes of a cell and queries that one task takes; distances that it holds at once.
LOT_ROWS, BLOCK_QUERIES, HELD = 200_000, 20_000, 1 << 22
#: Rows asked for when an index is built, how many nearest of each, the share of them that is to be found, and what is tried for it.
ASKED_ROWS, ASKED_K, FOUND, REFINES = 128, 10, 0.95, (4, 8, 16, 32, 64, 128)
#: Rows of a page of the vectors' files, the least that is read for one of them.
PAGE_ROWS = 64


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2.0 * x @ centres.T).argmin(1)


def centres_of(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Centres of at most ``k`` groups of a sample's rows, by Lloyd's rounds; fewer, if the rows are."""
    if not len(x):
        return np.zeros((0, x.shape[1]))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        size = np.bincount(own, minlength=len(centres))
        total = np.stack([np.bincount(own, x[:, d], len(centres)) for d in range(x.shape[1])], axis=1)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten()
    if column.null_count or flat.null_count or len(flat) != len(column) * dim:
        raise ValueError(f"vectors must have {dim} entries")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


@dataclass(frozen=True)
class Books:
    """Centres of cells, and of each part of a residual its codes' values."""

    centres: np.ndarray
    parts: tuple[np.ndarray, ...]

    @staticmethod
    def fit(x: np.ndarray, cells: int) -> Books:
        centres = centres_of(x, cells)
        if not len(x):
            return Books(centres, ())
        rest = x - centres[nearest(x, centres)]
        return Books(centres, tuple(centres_of(rest[:, a : a + PART], CODES, a) for a in range(0, x.shape[1], PART)))

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell and codes."""
        cell = nearest(x, self.centres)
        rest = x - self.centres[cell]
        return cell, np.stack([nearest(rest[:, PART * i : PART * i + book.shape[1]], book) for i, book in enumerate(self.parts)], axis=1).astype(np.uint8)

    def distances(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """About how far each query is from each of a cell's coded vectors, squared."""
        rest = queries - self.centres[cell]
        out = np.zeros((len(queries), len(codes)), np.float32)
        for i, book in enumerate(self.parts):
            part = rest[:, PART * i : PART * i + book.shape[1]]
            table = ((part**2).sum(1)[:, None] - 2.0 * part @ book.T + (book**2).sum(1)[None, :]).astype(np.float32)
            out += table[:, codes[:, i]]
        return out


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    folder: str
    books: Books
    dim: int
    page_rows: int = PAGE_ROWS
    probes: int = PROBES
    refine: int = REFINE

    @staticmethod
    def build(vectors: DataFrame, folder: str, keep: tuple[str, ...] = (), cells: int | None = None, sample_rows: int = SAMPLE_ROWS, page_rows: int = PAGE_ROWS) -> VectorIndex:
        """An index of ``vectors`` (id a long, embedding, and columns to ``keep`` for filters) in a new folder.

        Rows without an embedding are left out; the others must have one length. An index of no rows finds none and takes none.
        """
        spark, rows = vectors.sparkSession, vectors.filter("embedding is not null and id is not null")
        n = rows.count()
        sample = rows.select(F.col("embedding").cast("array<double>").alias("embedding"), F.xxhash64("id").alias("h")).orderBy("h").limit(sample_rows).select("embedding").toArrow()["embedding"].to_pylist()
        dim = len(sample[0]) if sample else 0
        if any(len(x) != dim for x in sample):
            raise ValueError("vectors of several lengths")
        cells = cells or min(MOST_CELLS, max(1, n // CELL_ROWS))
        index = VectorIndex(spark, f"{folder}/{uuid.uuid4().hex}", Books.fit(np.array(sample, float).reshape(len(sample), dim), cells), dim, page_rows)
        index.add(rows, keep)
        return index.calibrated(rows) if n else index

    def calibrated(self, rows: DataFrame) -> VectorIndex:
        """This index with as many probes and candidates as ASKED_ROWS of ``rows`` need for a share of FOUND of their nearest.

        One exact scan says what is nearest. Never fewer than PROBES and REFINE.
        """
        asked = checkpointed(rows.select(F.col("id").cast("long").alias("query_id"), "embedding").orderBy(F.xxhash64("id")).limit(ASKED_ROWS))
        exact = checkpointed(top_k_each(rows.select("id", "embedding"), asked, ASKED_K).select("query_id", "id"))
        probes, refine, best = PROBES, REFINE, 0.0
        for more in REFINES:
            found = recall(self.candidates(asked, ASKED_K, max(1, len(self.books.centres)), more), exact)
            refine = max(REFINE, more)
            if found >= FOUND or more > REFINE and found <= best:
                break
            best = found
        while probes < len(self.books.centres) and recall(self.candidates(asked, ASKED_K, probes, refine), exact) < FOUND:
            probes *= 2
        return replace(self, probes=probes, refine=refine)

    def add(self, vectors: DataFrame, keep: tuple[str, ...] = ()) -> None:
        """Adds vectors of new ids, coded with the index's books."""
        books, dim = self.books, self.dim

        def encode(batches):
            for batch in batches:
                if batch.num_rows:
                    cell, codes = books.encoded(_matrix(batch.column("embedding"), dim))
                    body = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes).tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), body], [*batch.schema.names, "cell", "code"])

        rows = vectors.filter("embedding is not null and id is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), *keep)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        coded = checkpointed(rows.mapInArrow(encode, f"{ddl}, cell int, code binary"))
        # A crowded cell is several tasks and files.
        dealt = coded.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("cell", "id")
        dealt.select("id", "code", *keep, "cell").write.mode("append").partitionBy("cell").parquet(f"{self.folder}/codes")
        pages = {"parquet.page.row.count.limit": str(self.page_rows), "parquet.page.size.row.check.min": str(self.page_rows), "parquet.enable.dictionary": "false"}
        dealt.select("id", "embedding", "cell").write.options(**pages).mode("append").partitionBy("cell").parquet(f"{self.folder}/vectors")

    def _codes(self, where: Column | None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/codes")
        return rows if where is None else rows.filter(where)

    def candidates(self, queries: DataFrame, k: int, probes: int | None = None, refine: int | None = None, where: Column | None = None) -> DataFrame:
        """(query_id, id, cell) of the ``refine`` times ``k`` likeliest vectors in each query's ``probes`` nearest cells."""
        probes = probes or self.probes
        books, dim, wanted = self.books, self.dim, (refine or self.refine) * k

        def probed(batches):
            for batch in batches:
                if batch.num_rows:
                    q = _matrix(batch.column("embedding"), dim)
                    far = (books.centres**2).sum(1)[None, :] - 2.0 * q @ books.centres.T
                    cells = np.argsort(far, axis=1, kind="stable")[:, :probes]
                    own = pa.array(np.repeat(np.arange(len(q)), cells.shape[1]))
                    yield pa.RecordBatch.from_arrays([batch.column("query_id").take(own), batch.column("embedding").take(own), pa.array(cells.ravel().astype(np.int32))], ["query_id", "embedding", "cell"])

        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(probed, "query_id long, embedding array<float>, cell int")
        asked = checkpointed(asked)
        # What follows is bounded by the number of cells.
        per = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        rows = self._codes(where).filter(F.col("cell").isin(sorted(per))).select("id", "code", "cell")
        sizes = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        lots, blocks = max((-(-n // LOT_ROWS) for n in sizes.values()), default=1), max((-(-n // BLOCK_QUERIES) for n in per.values()), default=1)

        def met(codes: pa.Table, asking: pa.Table) -> pa.Table:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if codes.num_rows and asking.num_rows:
                cell, ids = asking.column("cell")[0].as_py(), codes.column("id").to_numpy()
                body = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                names, q = asking.column("query_id").to_numpy(), _matrix(asking.column("embedding").combine_chunks(), dim)
                step = max(1, HELD // len(ids))
                for a in range(0, len(q), step):
                    far = books.distances(q[a : a + step], cell, body)
                    best = np.argpartition(far, wanted - 1, axis=1)[:, :wanted] if len(ids) > wanted else np.tile(np.arange(len(ids)), (len(far), 1))
                    out.append((np.repeat(names[a : a + step], best.shape[1]), ids[best].ravel(), np.take_along_axis(far, best, 1).ravel()))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
            cells = pa.array(np.full(len(columns[0]), asking.column("cell")[0].as_py() if len(columns[0]) else 0, np.int32))
            return pa.Table.from_arrays([*map(pa.array, columns), cells], ["query_id", "id", "far", "cell"])

        lot = lambda column, n, name: F.pmod(F.xxhash64(column), F.lit(n)).alias(name)
        data = rows.select("*", lot("id", lots, "lot"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        sent = asked.select("*", lot("query_id", blocks, "block"), F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"))
        keys = ["cell", "lot", "block"]
        found = data.groupBy(*keys).cogroup(sent.select(*asked.columns, F.col("lot").cast("long").alias("lot"), F.col("block").cast("int").alias("block")).groupBy(*keys)).applyInArrow(met, "query_id long, id long, far float, cell int")
        first = Window.partitionBy("query_id").orderBy("far", "id")
        return found.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= wanted).select("query_id", "id", "cell")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, refine: int | None = None, where: Column | None = None) -> DataFrame:
        """(query_id, id, score, rank) of about the nearest ``k`` rows of each of ``queries`` (query_id, embedding), with exact scores."""
        k = clamp(k)
        if not self.dim:
            return self.spark.createDataFrame([], "query_id long, id long, score double, rank int")
        chosen = checkpointed(self.candidates(queries, k, probes, refine, where))
        cells = [r[0] for r in chosen.select("cell").distinct().collect()]
        vectors = self.spark.read.parquet(f"{self.folder}/vectors").filter(F.col("cell").isin(cells))
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("asked"))
        return self._ranked(vectors.join(chosen, ["cell", "id"]).join(asked, "query_id"), F.col("asked"), k)

    def search_one(self, query: list[float], k: int = 10, probes: int | None = None, refine: int | None = None, where: Column | None = None) -> DataFrame:
        """(id, score, rank) of about the nearest ``k`` rows of one vector; of the vectors' files only the candidates' pages are read."""
        k = clamp(k)
        if not self.dim:
            return self.spark.createDataFrame([], "id long, score double, rank int")
        asked = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, embedding array<float>")
        chosen = self.candidates(asked, k, probes, refine, where).collect()  # refine times k
        rows = self.spark.read.parquet(f"{self.folder}/vectors").filter(F.col("cell").isin(sorted({r["cell"] for r in chosen})))
        one = F.lit(False)
        for i in sorted(r["id"] for r in chosen):
            one = one | (F.col("id") == i)
        scores = self._ranked(rows.filter(one).withColumn("query_id", F.lit(0)), F.array(*[F.lit(float(x)) for x in query]), k)
        return scores.drop("query_id")

    @staticmethod
    def _ranked(rows: DataFrame, query: Column, k: int) -> DataFrame:
        scored = rows.select("query_id", "id", F.round(X.similarity(X.squared_distance(F.col("embedding"), query)), DIGITS).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of ``exact`` (query_id, id) that is among ``found``."""
    whole = exact.select("query_id", "id").distinct()
    return whole.join(found.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").count() / max(1, whole.count())
