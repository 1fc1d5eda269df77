"""Vector, overlay and symbol search over chunk tables."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .matching import containing

DIGITS = 9
#: Query vectors that one scan of the data answers.
QUERIES_AT_ONCE = 2_000
ROWS_AT_ONCE = 1_024
#: How far a product's distance may be off, relatively.
NEAR_ENOUGH = 1e-6


def clamp(n: int, low: int = 1, high: int = 100) -> int:
    return max(low, min(n, high))


class DimensionMismatch(ValueError):
    """Vectors of another length than the collection has."""

    def __init__(self, model: str, model_dim: int, collection: str, collection_dim: int):
        super().__init__(f"{model} gives {model_dim} dimensions, {collection} has {collection_dim}: re-index it or change the model")
        self.model, self.model_dim, self.collection, self.collection_dim = model, model_dim, collection, collection_dim


def check_dimension(known: int | None, got: int, model: str, collection: str) -> None:
    """Raises unless the lengths agree; a collection that doesn't know its own passes."""
    if known is not None and known != got:
        raise DimensionMismatch(model, got, collection, known)


def scored(vectors: DataFrame, query: list[float], where: Column | None = None) -> DataFrame:
    """``vectors`` that pass ``where``, with ``score``; the filter comes first, so it reaches the scan."""
    rows = vectors if where is None else vectors.filter(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("score", F.round(X.similarity(X.squared_distance(F.col("embedding"), q)), DIGITS))


def top_k(vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
    """The nearest ``k`` rows, ties by id: each partition keeps its own best before they meet."""
    return scored(vectors, query, where).orderBy(F.desc("score"), "id").limit(clamp(k))


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int = 10, probed=None) -> DataFrame:
    """(query_id, id, score, rank) of the nearest ``k`` rows for each of ``queries`` (query_id, embedding).

    Queries go out in blocks of QUERIES_AT_ONCE; against each, a batch of rows is one matrix product that picks
    candidates, whose exact scores are then computed as ``scored`` does. Each task hands on at most ``k`` rows a query.
    With ``probed``, a query looks only at rows whose ``cell`` is in probed(its embedding).
    """
    k = clamp(k)
    left, out = queries.orderBy("query_id").toLocalIterator(), None
    while block := list(islice(left, QUERIES_AT_ONCE)):
        names, q = [r["query_id"] for r in block], np.array([r["embedding"] for r in block], np.float64)

        cells = None if probed is None else [probed(x) for x in q]

        def run(batches, names=names, q=q, cells=cells):
            mine, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            reach, square = np.full(len(q), np.inf), (q**2).sum(1)
            for batch in batches:
                own = batch.column("id").to_numpy(zero_copy_only=False)
                at = None if cells is None else batch.column("cell").to_numpy(zero_copy_only=False)
                flat = batch.column("embedding")
                v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1) if flat.null_count == 0 and len(flat.flatten()) == len(own) * q.shape[1] else np.array(flat.to_pylist(), np.float64)
                for start in range(0, len(v), ROWS_AT_ONCE):
                    part = v[start : start + ROWS_AT_ONCE]
                    # One product gives all distances but for rounding; what may be among the best is measured exactly.
                    near = square[:, None] - 2 * (q @ part.T) + (part**2).sum(1)[None, :]
                    if cells is not None:
                        near[~np.array([np.isin(at[start : start + ROWS_AT_ONCE], c) for c in cells])] = np.inf
                    own_reach = np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] > k else np.full(len(q), np.inf)
                    limit = np.minimum(reach, own_reach)
                    query, row = np.nonzero((near <= (limit + NEAR_ENOUGH * (1 + np.abs(limit)))[:, None]) & np.isfinite(near))
                    total = np.zeros(len(query))
                    for d in range(q.shape[1]):  # in the order of elements, so that sums are the JVM's
                        total += (part[row, d] - q[query, d]) ** 2
                    mine, ids = np.concatenate([mine, query]), np.concatenate([ids, own[start + row]])
                    scores = np.concatenate([scores, np.round(1.0 / (1.0 + total), DIGITS)])
                    order = np.lexsort((ids, -scores, mine))
                    mine, ids, scores = mine[order], ids[order], scores[order]
                    place = np.arange(len(mine)) - np.searchsorted(mine, mine)
                    kept = place < k
                    mine, ids, scores, last = mine[kept], ids[kept], scores[kept], place[kept] == k - 1
                    # Scores are rounded, so ties reach a little further than the k-th distance.
                    reach[mine[last]] = 1.0 / np.maximum(scores[last] - 10.0**-DIGITS, 1e-12) - 1.0
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in mine.tolist()], pa.int64()), pa.array(ids), pa.array(scores)], ["query_id", "id", "score"])

        part = vectors.select(F.col("id").cast("long").alias("id"), "embedding", *["cell"] * (cells is not None)).mapInArrow(run, "query_id long, id long, score double")
        out = part if out is None else out.union(part)
    if out is None:
        return queries.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def overlay_search(vectors: DataFrame, query: list[float], base: str, overlay: str, k: int = 10, where: Column | None = None, strict: bool = False) -> DataFrame:
    """Top ``k`` of a base collection under a branch's overlay.

    The overlay's and the base's own top ``k`` are taken first; base hits whose file is among the overlay's hits
    go (with ``strict``: whose file is in the overlay at all); hits of no file stay; then both are merged. Fewer
    than ``k`` rows may remain.
    """
    over = top_k(vectors.filter(F.col("collection") == overlay), query, k, where).withColumn("source", F.lit(0))
    under = top_k(vectors.filter(F.col("collection") == base), query, k, where).withColumn("source", F.lit(1))
    shadow = (vectors.filter(F.col("collection") == overlay) if strict else over).select("file_path").distinct()
    return over.unionByName(under.join(shadow, "file_path", "left_anti")).orderBy(F.desc("score"), "source", "id").limit(clamp(k))


def hyperplane_index(vectors: DataFrame, bits: int = 4, seed: int = 7) -> DataFrame:
    """``vectors`` with ``cell``: the signs of ``bits`` random projections; every row is indexed, none is fitted."""
    dim = len(vectors.select("embedding").first()[0])
    planes = np.random.default_rng(seed).standard_normal((bits, dim))
    signs = [F.when(F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), F.array(*map(F.lit, map(float, p))), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x) >= 0, 1 << i).otherwise(0) for i, p in enumerate(planes)]
    return vectors.withColumn("cell", sum(signs[1:], signs[0]))


def probed_cells(query, bits: int = 4, seed: int = 7, probes: int = 13) -> list[int]:
    """The ``probes`` cells of the least total distance to the query's own side."""
    at = np.random.default_rng(seed).standard_normal((bits, len(query))) @ np.array(query, float)
    own = sum(1 << i for i, x in enumerate(at) if x >= 0)
    cost = sorted((sum(abs(at[i]) for i in range(bits) if c >> i & 1), c) for c in range(1 << bits))
    return [own ^ c for _, c in cost[:probes]]


def approximate_top_k(indexed: DataFrame, query: list[float], k: int = 10, bits: int = 4, seed: int = 7, probes: int = 13) -> DataFrame:
    """Nearest rows among the probed cells; ``cell`` is a plain filter, so a partition column prunes."""
    return top_k(indexed, query, k, F.col("cell").isin(probed_cells(query, bits, seed, probes)))


def approximate_top_k_each(indexed: DataFrame, queries: DataFrame, k: int = 10, bits: int = 4, seed: int = 7, probes: int = 13) -> DataFrame:
    """The same for each of ``queries`` (query_id, embedding), in the form of top_k_each()."""
    return top_k_each(indexed, queries, k, lambda q: probed_cells(q, bits, seed, probes))


def find_symbol(chunks: DataFrame, name: str, file_path: str | None = None, kind: str | None = None) -> DataFrame:
    found = chunks.filter((F.col("name") == name) & F.col("collection").startswith("code_"))
    found = found if kind is None else found.filter(F.col("chunk_type") == kind)
    return found if file_path is None else found.filter(F.col("file_path") == file_path)


def impact_terms(files: list[str], symbols: list[str]) -> list[str]:
    """Names to look for: of each file its name, then its stem; then the symbols."""
    out = []
    for path in files:
        name = path.rsplit("/", 1)[-1]
        out += [name, name[: name.rindex(".")] if "." in name.strip(".") and not name.startswith(".") or name.count(".") > 1 else name]
    return out + symbols


def change_impact(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """Chunks that hold a term, one row an id, with the first term by (collection, order of terms)."""
    hits = containing(chunks.filter(F.col("collection").startswith("code_")), "content", list(enumerate(terms)))
    first = hits.groupBy("id").agg(F.min_by(F.struct(*hits.columns), F.struct("collection", "found")).alias("r")).select("r.*")
    return first.withColumn("matched_term", F.get(F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>"), F.col("found"))).drop("found")


def dependents(spark: SparkSession, chunks: DataFrame, symbol: str, file_path: str | None = None, depth: int = 1, save=lambda df: df.cache()) -> DataFrame:
    """Chunks reached from a symbol in up to ``depth`` (at most 5) steps, each with its least ``depth``.

    A step goes from names to the chunks that hold one, then to those chunks' names. Chunks of ``file_path`` are
    neither returned nor followed. ``save`` materialises a level, so plans stay short.
    """
    known = chunks.filter(F.col("collection").startswith("code_"))
    frontier, searched, seen, levels = [symbol], {symbol}, None, []
    for level in range(1, clamp(depth, 1, 5) + 1):
        left = known if seen is None else known.join(seen, "id", "left_anti")
        hits = save(containing(left, "content", list(enumerate(frontier))).drop("found").dropDuplicates(["id"]))
        seen = hits.select("id") if seen is None else seen.union(hits.select("id"))
        shown = hits if file_path is None else hits.filter(~F.col("file_path").eqNullSafe(file_path))
        levels.append(shown.withColumn("depth", F.lit(level)))
        # The next names; they are as many as there are symbols, and are looked for in blocks, each once: what holds one
        # that was looked for before is among the chunks seen.
        frontier = sorted({r[0] for r in shown.filter((F.col("name") != "") & F.col("name").isNotNull()).select("name").distinct().toLocalIterator()} - searched)
        searched.update(frontier)
        if not frontier:
            break
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out
