"""Embedding whitening from an exact scatter matrix, added up in residues.

Entries become integers, so sums of products are exact if nothing is rounded. Each partition multiplies blocks of
vectors modulo several primes under 2**20, where products of 4096 rows fit a double exactly; residues of partitions
are added in a tree, and the Chinese remainder theorem gives the integers back: the number n of vectors, their sums
S and the sums of products Q. Then n Q - S S' is, as integers, n times the scatter of the centred vectors n x - S,
over n; divided once, it is the covariance, correctly rounded, whose eigenvectors are taken in double precision.

The vectors that are fitted are distinct: equal ones meet by their packed bytes, combined before the shuffle. What
reaches the driver grows with the dimension alone: some primes times its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
PRIME_BITS, BLOCK_ROWS, BLOCK_CELLS = 20, 4096, 1 << 22
#: Partitions whose sums are added in one task of a round.
FAN_IN = 16
_LARGEST = 2.0**62
_WIDTHS = {1: "<i1", 2: "<i2", 4: "<i4", 8: "<i8"}


def primes_over(bound: int) -> list[int]:
    """The largest primes under 2**PRIME_BITS, as many as have a product over ``bound``."""
    out, product, n = [], 1, (1 << PRIME_BITS) - 1
    while product <= bound:
        if all(n % k for k in range(3, math.isqrt(n) + 1, 2)):
            out.append(n)
            product *= n
        n -= 2
    return out


def usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, entries as doubles) of a column's vectors without nulls and non-finite entries, by length; empty ones go."""
    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.greater(pc.list_value_length(column), 0), False)))
    column = column.take(pa.array(rows, pa.int64()))
    sizes, flat = np.asarray(pc.list_value_length(column)).astype(np.int64), pc.list_flatten(column)
    if not len(rows):
        return
    values = np.asarray(pc.fill_null(flat.cast(pa.float64()), math.nan))
    begin = np.cumsum(sizes) - sizes
    good = np.logical_and.reduceat(np.isfinite(values), begin)
    for size in np.unique(sizes[good]):
        k = np.flatnonzero(good & (sizes == size))
        yield rows[k], values[begin[k][:, None] + np.arange(size)]


def integers(entries: np.ndarray, scale: int, shift: int) -> np.ndarray:
    x = np.floor(entries * scale)
    if x.size and np.abs(x).max() >= _LARGEST:
        raise ValueError("an entry doesn't fit a long once scaled")
    return x.astype(np.int64) + shift


def packed(x: np.ndarray, shift: int) -> tuple[np.ndarray, pa.Array]:
    """Rows' numbers, and each row as bytes: the least width that holds it less ``shift``, and its entries; equal rows have equal bytes."""
    y = x - shift
    reach = np.maximum(y.max(1), -1 - y.min(1))
    width = np.select([reach < 1 << 7, reach < 1 << 15, reach < 1 << 31], [1, 2, 4], 8)
    order, out = [], []
    for w in np.unique(width).tolist():
        k = np.flatnonzero(width == w)
        body = np.ascontiguousarray(y[k].astype(_WIDTHS[w])).view(np.uint8).reshape(len(k), -1)
        whole = np.concatenate([np.full((len(k), 1), w, np.uint8), body], axis=1)
        out.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(whole.shape[1]), len(k), [None, pa.py_buffer(whole.tobytes())]).cast(pa.binary()))
        order.append(k)
    return np.concatenate(order), pa.concat_arrays(out)


def unpacked(column: pa.Array, shift: int) -> Iterator[np.ndarray]:
    """The vectors of a column of packed rows, in blocks of one width and length."""
    data = column.cast(pa.binary()).to_pylist()
    kinds = np.array([[len(b), b[0]] for b in data]).reshape(-1, 2)
    for size, width in np.unique(kinds, axis=0).tolist():
        k = np.flatnonzero((kinds == [size, width]).all(1))
        rows = max(64, min(BLOCK_ROWS, BLOCK_CELLS // size))
        for a in range(0, len(k), rows):
            some = np.frombuffer(b"".join([data[i] for i in k[a : a + rows]]), np.uint8).reshape(-1, size)
            yield np.ascontiguousarray(some[:, 1:]).view(_WIDTHS[width]).astype(np.int64) + shift


def added(parts: DataFrame, number: int, combine, fan: int = FAN_IN) -> bytes | None:
    """The sum of all ``data`` of (part, data), ``number`` parts, in rounds of ``fan``; ``combine`` adds a list of them."""

    def some(table: pa.Table) -> pa.Table:
        own = combine([x.as_py() for x in table.column("data")])
        return pa.Table.from_arrays([pa.array([table.column("part")[0].as_py() // fan], pa.int32()), pa.array([own], pa.binary())], ["part", "data"])

    left = True
    while left:
        parts = parts.groupBy(F.floor(F.col("part") / fan)).applyInArrow(some, "part int, data binary")
        left, number = number > fan, -(-number // fan)
    found = parts.first()
    return None if found is None else bytes(found["data"])


def exact_sums(fit: DataFrame, shift: int) -> tuple[int, list[int], list[list[int]]] | None:
    """n, S and Q of the packed vectors ``fit`` (x), exactly; None without any. All must have one length."""

    def facts(batches):
        n, low, high, top = 0, 1 << 31, 0, 0
        for batch in batches:
            for x in unpacked(batch.column("x"), shift):
                n, low, high, top = n + len(x), min(low, x.shape[1]), max(high, x.shape[1]), max(top, int(np.abs(x).max()))
        if n:
            yield pa.RecordBatch.from_pylist([{"n": n, "low": low, "high": high, "top": top}])

    n, low, high, top = fit.mapInArrow(facts, "n long, low long, high long, top long").agg(F.sum("n"), F.min("low"), F.max("high"), F.max("top")).first()
    if not n:
        return None
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} entries")
    primes = primes_over(2 * n * max(top, 1) ** 2)
    shape = (len(primes), high + 1, high + 1)

    def residues(batches):
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for x in unpacked(batch.column("x"), shift):
                for k, p in enumerate(primes):
                    own = np.concatenate([np.ones((len(x), 1)), x % p], axis=1)
                    total[k] = (total[k] + (own.T @ own).astype(np.int64)) % p
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.astype("<i4").tobytes()], pa.binary())], ["part", "data"])

    def combine(some: list[bytes]) -> bytes:
        total = np.zeros(shape, np.int64)
        for data in some:
            total += np.frombuffer(data, "<i4").reshape(shape)
        return (total % np.array(primes)[:, None, None]).astype("<i4").tobytes()

    found = np.frombuffer(added(fit.mapInArrow(residues, "part int, data binary"), fit.rdd.getNumPartitions(), combine), "<i4").reshape(shape)
    product = math.prod(primes)
    whole = sum(found[k].astype(object) * (product // p * pow(product // p, -1, p)) for k, p in enumerate(primes)) % product
    whole = np.where(whole > product // 2, whole - product, whole).tolist()
    return whole[0][0], whole[0][1:], [row[1:] for row in whole[1:]]


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``n`` distinct vectors with ``sums``; components (columns), their variances and shares of all variance.

    ``vectors`` has the components with variance alone; further ones up to ``number`` have none to divide by.
    """

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    explained: list[float | None]
    number: int
    scale: int
    shift: int

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, bool]:
        """n x - S, exactly, and whether its squares' sums fit a long; else as Python's integers."""
        mean = [divmod(s, self.n) for s in self.sums]
        y = x - np.array([q for q, _ in mean], np.int64)
        reach = self.n * (int(np.abs(y).max(initial=0)) + 1)
        short = reach * reach * max(1, x.shape[1]) < 1 << 63
        return (y if short else y.astype(object)) * self.n - np.array([r for _, r in mean], np.int64 if short else object), short

    def applied(self, z: np.ndarray) -> np.ndarray:
        return (z.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.variances)


def fitted(sums: tuple[int, list[int], list[list[int]]], components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening:
    n, s, q = sums
    d = len(s)
    # Exact integers until the one division, which rounds correctly.
    v = np.array([[(n * q[i][j] - s[i] * s[j]) / (n * n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    u = u * np.sign(u[np.abs(u).argmax(0), np.arange(d)])
    number, trace = min(components, d), math.fsum(v.diagonal())
    with_variance = int((e[:number] > max(trace, 0.0) * d * 2.0**-50).sum())
    explained = [float(max(x, 0.0) / trace) if trace > 0 else None for x in e[:number]]
    return Whitening(n, s, np.ascontiguousarray(u[:, :with_variance]), e[:with_variance].copy(), explained, number, scale, shift)


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of the whitened fitted vectors minus the identity; None without components."""
    k = len(model.variances)
    if not k:
        return None

    def sums(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for x in unpacked(batch.column("x"), model.shift):
                w = np.concatenate([np.ones((len(x), 1)), model.applied(model.centred(x)[0])], axis=1)
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "data"])

    total = added(fit.mapInArrow(sums, "part int, data binary"), fit.rdd.getNumPartitions(), lambda some: np.sum([np.frombuffer(x) for x in some], axis=0).tobytes())
    total = np.frombuffer(total).reshape(k + 1, k + 1) / model.n
    return float(np.abs(total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:]) - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable vector and component.

    ``embeddings`` has vec_id and embedding (an array of floats). Rows whose vector is null, empty, or holds null or
    non-finite entries take no part; an entry c counts as the integer floor(scale * c) + shift. Fitted is each
    distinct vector of integers once; every row that remains is whitened, repeated ones and those of a null vec_id
    too. ``deviation`` is a decimal(38, 0), null beyond its range. A component without variance (constant entries, or
    fewer vectors than components) has a null ``whitened``; where all vectors are equal, ``explained`` and
    ``identity_error`` are null as well. There are as many components as entries, if fewer than ``components``.
    An empty table gives no rows. Vectors of several lengths, or entries beyond a long, are a ValueError. Equal
    eigenvalues have any basis of theirs. Other columns are not read.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def pack(batches):
        for batch in batches:
            for _, entries in usable(batch.column("embedding")):
                yield pa.RecordBatch.from_arrays([packed(integers(entries, scale, shift), shift)[1]], ["x"])

    fit = checkpointed(rows.select("embedding").mapInArrow(pack, "x binary").distinct())
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    sums = exact_sums(fit, shift)
    if sums is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    model = fitted(sums, components, scale, shift)
    error = identity_error(fit, model)

    def apply(batches):
        for batch in batches:
            for k, entries in usable(batch.column("embedding")):
                for a in range(0, len(k), BLOCK_ROWS):
                    z, short = model.centred(integers(entries[a : a + BLOCK_ROWS], scale, shift))
                    total = (z * z).sum(1)
                    long = pa.array(total if short else [None] * len(z), pa.int64())
                    wide = pa.array([None] * len(z) if short else [str(t) for t in total], pa.string())
                    w = model.applied(z)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(k[a : a + BLOCK_ROWS], pa.int64())), long, wide, lists], ["vec_id", "long", "wide", "w"])

    out = rows.mapInArrow(apply, "vec_id long, long long, wide string, w array<double>")
    shares = F.array(*[F.lit(x).cast("double") for x in model.explained])
    deviation = F.coalesce(F.col("long").cast("decimal(38,0)"), F.expr("try_cast(wide as decimal(38,0))"))
    each = out.withColumn("component", F.explode(F.sequence(F.lit(1), F.lit(model.number))))
    return each.select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), deviation.alias("deviation"), F.get("w", F.col("component") - 1).alias("whitened"),
        F.get(shares, F.col("component") - 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
