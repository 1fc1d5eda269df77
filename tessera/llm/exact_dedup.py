"""Exact deduplication by a tree merge of sorted digest runs.

Every partition sorts the digests of its texts into a run; runs then meet in binomial rounds, where run i
merges with the others of i // FAN_IN, and every level keeps of equal digests the smallest identifier and the
sum of the counts. A run is cut into digest ranges, one row a range, so a merge holds one range of FAN_IN runs
and never a whole corpus. A key has the SHA-256 of the normalised text and, as a check on it, another 64-bit
hash and the length: only texts that agree in all three count as equal.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, maybe_listed

FAN_IN = 8
#: Distinct digests that one range may hold on average at the last level.
RANGE_ROWS = 500_000
#: Rows of a partition that one run takes.
RUN_ROWS = 2_000_000
KEY_BYTES = 48
#: Copies from which a text's key is a hot one, unless that made more hot keys than HOT_KEYS, which are broadcast.
HOT_ROWS, HOT_KEYS = 10_000, 10_000
NO_ID = np.iinfo(np.int64).max
RUN_SCHEMA = "span int, run int, keys binary, ids binary, uids binary, counts binary"


def normalised(text):
    """Text with each run of space and 0x09-0x0D as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, text_sha256, key) of every row; uid tells rows apart that repeat a doc_id."""
    text = docs.select("doc_id", normalised(F.col("text")).alias("norm"), F.monotonically_increasing_id().alias("uid"))
    named = text.select("doc_id", "uid", F.sha2("norm", 256).alias("sha"), F.xxhash64("norm").alias("check"), F.length("norm").cast("long").alias("size"))
    padded = [F.lpad(F.hex(c), 16, "0") for c in ("check", "size")]
    return named.select("doc_id", "uid", F.unhex(F.concat("sha", *padded)).alias("key"))


Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def collapsed(run: Run) -> Run:
    """A sorted run with one entry for each key: the smallest (id, uid) and the summed count."""
    keys, ids, uids, counts = run
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    if len(first) == len(keys):
        return run
    least = np.minimum.reduceat(ids, first)
    at_least = ids == np.repeat(least, np.diff(np.r_[first, len(ids)]))
    return keys[first], least, np.minimum.reduceat(np.where(at_least, uids, NO_ID), first), np.add.reduceat(counts, first)


def two_merged(a: Run, b: Run) -> Run:
    """Two sorted runs as one: every entry's place is its own plus the number of the other run's keys before it."""
    at_a = np.arange(len(a[0])) + np.searchsorted(b[0], a[0], "left")
    at_b = np.arange(len(b[0])) + np.searchsorted(a[0], b[0], "right")
    out = []
    for x, y in zip(a, b, strict=True):
        both = np.empty(len(x) + len(y), x.dtype)
        both[at_a], both[at_b] = x, y
        out.append(both)
    return collapsed(tuple(out))


def merged(runs: list[Run]) -> Run:
    """Any number of sorted runs as one, the shortest first, so that no entry is moved more than log(runs) times."""
    heap = [(len(r[0]), n, r) for n, r in enumerate(runs)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, n, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = two_merged(a, b)
        heapq.heappush(heap, (len(both[0]), n, both))
    return heap[0][2] if heap else (np.zeros(0, f"S{KEY_BYTES}"), *(np.zeros(0, np.int64) for _ in range(3)))


def span_of(keys: np.ndarray, spans: int) -> np.ndarray:
    head = keys.view(np.uint8).reshape(-1, KEY_BYTES)[:, :4].astype(np.uint64)
    return (((head @ np.array([1 << 24, 1 << 16, 1 << 8, 1], np.uint64)) * np.uint64(spans)) >> np.uint64(32)).astype(np.int32)


def pack(run: int, parts: Run, spans: int) -> pa.RecordBatch:
    keys, ids, uids, counts = parts
    span = span_of(keys, spans)
    edges = np.flatnonzero(np.r_[True, span[1:] != span[:-1], True]) if len(span) else np.zeros(1, int)
    rows = [(int(span[a]), run, keys[a:b].tobytes(), ids[a:b].tobytes(), uids[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["span", "run", "keys", "ids", "uids", "counts"])


def unpack(table: pa.Table) -> list[Run]:
    kinds = {"keys": f"S{KEY_BYTES}", "ids": np.int64, "uids": np.int64, "counts": np.int64}
    columns = [[np.frombuffer(x.as_py(), kind) for x in table.column(name)] for name, kind in kinds.items()]
    return list(zip(*columns, strict=True))


def first_runs(spans: int):
    """One sorted run for each partition; a partition of more than RUN_ROWS rows hands its run on in parts."""

    def run(batches):
        from pyspark import TaskContext

        part, held, rows = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), f"S{KEY_BYTES}")
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            uids = batch.column("uid").to_numpy(zero_copy_only=False)
            order = np.argsort(keys, kind="stable")
            held.append(collapsed((keys[order], ids[order], uids[order], np.ones(len(keys), np.int64))))
            rows += len(keys)
            if rows >= RUN_ROWS:
                yield pack(part, merged(held), spans)
                held, rows = [], 0
        if held:
            yield pack(part, merged(held), spans)

    return run


def merge_runs(spans: int, fan_in: int):
    def merge(table: pa.Table) -> pa.Table:
        run = table.column("run")[0].as_py() // fan_in
        return pa.Table.from_batches([pack(run, merged(unpack(table)), spans)])

    return merge


def survivors(digested: DataFrame, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(key, keep_id, keep_uid, group_size) of every distinct text, by binomial rounds over the partitions' runs."""
    rows, last = digested.agg(F.count("*"), F.max(F.shiftright("uid", 33))).first()  # the high bits of uid are the partition
    spans = max(1, math.ceil(rows / range_rows))
    runs, left = digested.mapInArrow(first_runs(spans), RUN_SCHEMA), (last or 0) + 1
    while left > fan_in:
        grouped = runs.groupBy("span", F.floor(F.col("run") / fan_in).alias("to"))
        runs, left = grouped.applyInArrow(merge_runs(spans, fan_in), RUN_SCHEMA), math.ceil(left / fan_in)

    def last(table: pa.Table) -> pa.Table:
        keys, ids, uids, counts = merged(unpack(table))
        blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY_BYTES), len(keys), [None, pa.py_buffer(keys.tobytes())])
        return pa.Table.from_arrays([blob.cast(pa.binary()), pa.array(ids), pa.array(uids), pa.array(counts)], ["key", "keep_id", "keep_uid", "group_size"])

    return runs.groupBy("span").applyInArrow(last, "key binary, keep_id long, keep_uid long, group_size long")


def exact_dedup(docs: DataFrame, fan_in: int = FAN_IN, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised texts the one with the smallest doc_id stays; of rows that repeat that doc_id
    too, one stays. Null texts count as empty. A null doc_id comes after all others: such a row stays only where
    no row of the same text has an id, and keep_id is then null. Other columns of ``docs`` are not read.
    """
    digested = checkpointed(digests(docs))
    found = survivors(digested, fan_in).withColumn("keep_id", F.nullif("keep_id", F.lit(int(NO_ID))))
    found = checkpointed(found)
    # Keys of very many copies meet their rows without a shuffle: there are at most HOT_KEYS, as each has that share of all rows.
    total = found.agg(F.sum("group_size")).first()[0] or 0
    hot = found.filter(F.col("group_size") >= max(hot_rows, -(-total // HOT_KEYS)))
    crowded = digested.join(F.broadcast(hot), "key")
    rest = digested.join(F.broadcast(hot.select("key")), "key", "left_anti").join(found.hint("merge"), "key")
    joined = crowded.unionByName(rest)
    sha = F.lower(F.hex(F.substring("key", 1, 32)))
    return joined.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), sha.alias("text_sha256"))


def keep_one(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``docs``, with all their columns of whatever names, that ``exact_dedup`` keeps. Only rows that may go are shuffled."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    decided = checkpointed(exact_dedup(docs, fan_in).filter("group_size > 1").select("doc_id", "text_sha256", "kept"))
    gone = decided.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("one"), F.count("*").alias("rows")).filter("not one or rows > 1")
    gone = checkpointed(gone.select(F.col("doc_id").alias("of_id"), F.col("text_sha256").alias("of_sha"), "one"))
    marked = maybe_listed(rows, "id", gone.select("of_id"))
    doubtful = marked.filter("__maybe").withColumn("sha", F.sha2(normalised(F.col("text")), 256))
    doubtful = doubtful.join(gone, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("sha") == F.col("of_sha")), "left")
    # Of rows that repeat both id and text, one of those that stay.
    once = doubtful.filter("one").dropDuplicates(["of_id", "of_sha"]).select("row")
    return marked.filter("not __maybe").select("row").union(doubtful.filter("one is null").select("row")).union(once).select("row.*")
