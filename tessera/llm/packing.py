"""Best-fit packing planned over a histogram of lengths.

The plan needs counts, not documents: with at most ``capacity`` lengths, best-fit decreasing places all pieces
of one length at once into the open bins of the least room that takes them. A piece then takes its planned slot
by its rank within its length. The plan grows with the capacity alone and is broadcast; ranks come in two
steps, by length and salt, so that one frequent length never meets in a single task. Full pieces, which most of
a corpus of long texts are, need no rank: each is a sequence of its own.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import ByteBpe, loaded, ship, texts_in
from .common import checkpointed

CAPACITY = 1024
END = 2
#: Pieces of one length that one task ranks on average; more, where there would be over MOST_SALTS such lots.
SALT_ROWS, MOST_SALTS = 1_000_000, 1 << 16


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for ``counts`` pieces of each length: rows (length, first, last, bin, offset, each).

    The pieces of ranks first to last (exclusive) go to bins ``bin`` + (rank - first) // each, where they start at
    ``offset`` + (rank - first) % each * length. Lengths are taken from the longest; of the open bins, those
    with the least sufficient room come first.
    """
    room: dict[int, list[list[int]]] = defaultdict(list)  # room left -> ranges of bins [first, number]
    out, bins = [], 0
    for length in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} does not fit {capacity}")
        rank, left = 0, counts[length]
        for free in sorted(r for r in room if r >= length):
            each = free // length
            while left and room[free]:
                first, number = room[free].pop()
                used = min(number, -(-left // each))
                if used < number:
                    room[free].append([first + used, number - used])
                full, rest = divmod(min(left, used * each), each)
                if full:
                    out.append((length, rank, rank + full * each, first, capacity - free, each))
                    room[free - each * length].append([first, full])
                if rest:
                    out.append((length, rank + full * each, rank + full * each + rest, first + full, capacity - free, rest))
                    room[free - rest * length].append([first + full, 1])
                rank, left = rank + full * each + rest, left - full * each - rest
            if not left:
                break
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            if full:
                out.append((length, rank, rank + full * each, bins, 0, each))
                room[capacity - each * length].append([bins, full])
            if rest:
                out.append((length, rank + full * each, rank + left, bins + full, 0, rest))
                room[capacity - rest * length].append([bins + full, 1])
            bins += full + bool(rest)
    return out


@functools.cache
def _library(name: str):
    """The vocabulary, also one of a tokenizers file, in the fastest library for it; ids are the same."""
    import tiktoken
    from public_tokenizers import PATTERN

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=loaded(name).ranks, special_tokens={})


def ids_of(name: str, text: str, added: bool = False) -> np.ndarray:
    """Ids of a text; with ``added``, the file's added tokens have ids of their own, as with the tokenizers library's defaults."""
    if added and (pattern := loaded(name).added_pattern) and len(parts := pattern.split(text)) > 1:
        own = loaded(name).added
        return np.concatenate([np.array([own[x]], "<u4") if k % 2 else ids_of(name, x) for k, x in enumerate(parts)])
    try:
        return _library(name).encode_to_numpy(text, disallowed_special=()).astype("<u4")
    except BaseException as e:
        # The library's regular expressions give up on endless runs of white space, by a panic that only has a name.
        if not isinstance(e, ValueError) and type(e).__name__ != "PanicException":
            raise
        own: ByteBpe = loaded(name)
        return own.encode_batch([text])[0].astype("<u4")


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False, added: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and ``end``, cut where longer than ``capacity``.

    Pieces have ``capacity`` ids but the first, which takes the rest. A null text is empty: its one piece is ``end``.
    With ``added``, added tokens in a text get their ids; otherwise they are ordinary text.
    """
    name = ship(docs.sparkSession, vocabulary)

    def run(batches):
        for batch in batches:
            index, piece, start, length, crc, lists = [], [], [], [], [], []
            for i, text in enumerate(texts_in(batch.column("text"))):
                own = np.append(ids_of(name, text or "", added), np.uint32(end)).astype("<u4")
                cuts = [0, *range(len(own) % capacity or min(capacity, len(own)), len(own), capacity), len(own)]
                for k in range(len(cuts) - 1):
                    part = own[cuts[k] : cuts[k + 1]]
                    index.append(i)
                    piece.append(k)
                    start.append(cuts[k])
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        lists.append(part.astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(index, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def salts_of(totals: dict[int, int], salt_rows: int = SALT_ROWS) -> dict[int, int]:
    """Into how many lots the pieces of each length are dealt: as many as they need, and over all lengths at most MOST_SALTS and one each."""
    each = max(salt_rows, -(-sum(totals.values()) // MOST_SALTS))
    return {length: -(-n // each) for length, n in totals.items() if n}


def place(items: DataFrame, capacity: int = CAPACITY, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``items``, materialised rows with ``length`` from 1 to ``capacity``, and their sequence_id and offset.

    A full piece is a sequence by itself, numbered below zero by its uid, any column of longs from 0 on that tells
    rows apart. Of the others, small frames reach the driver: counts by length, at most ``capacity``, and by length
    and salt, at most MOST_SALTS more, and from them the plan. Ranks follow (uid) within length and salt.
    """
    spark = items.sparkSession
    full = items.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    rest = items.filter(F.col("length") != capacity)
    totals = {length: n for length, n in rest.groupBy("length").count().collect()}
    lots = salts_of(totals, salt_rows)
    number = F.get(F.array(*[F.lit(lots.get(length, 1)) for length in range(capacity)]), F.col("length").cast("int"))
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("uid"), number).cast("int"))
    counted = sorted(tuple(r) for r in salted.groupBy("length", "salt").count().collect())
    done: dict[int, int] = defaultdict(int)
    before = []
    for length, salt, n in counted:
        before.append((length, salt, done[length]))
        done[length] += n
    slots = spark.createDataFrame(plan(totals, capacity), "length long, lo long, hi long, bin long, at long, each long")
    starts = spark.createDataFrame(before, "length long, salt int, before long")
    ranked = salted.withColumn("n", F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")) - 1)
    # Both sides are bounded by the capacity and the salts, whatever the number of rows.
    ranked = ranked.join(F.broadcast(starts), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("n"))
    by_length = F.broadcast(slots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "bin", "at", "each"))).alias("slots")))
    slot = F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0]
    placed = ranked.join(by_length, "length").withColumn("slot", slot)
    nth = F.col("rank") - F.col("slot.lo")
    placed = placed.withColumn("sequence_id", F.col("slot.bin") + F.floor(nth / F.col("slot.each"))).withColumn("offset", F.col("slot.at") + nth % F.col("slot.each") * F.col("length"))
    return placed.select(*items.columns, "sequence_id", "offset").union(full)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, salt_rows: int = SALT_ROWS, added: bool = False) -> DataFrame:
    """One row per piece of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty and repeated rows are packed each; a null doc_id stays null; an empty table gives no
    rows; columns other than doc_id and text are not read. ``added`` is as in pieces().
    """
    cut = checkpointed(pieces(docs, vocabulary, capacity, end, added=added).withColumn("uid", F.monotonically_increasing_id()))
    return place(cut, capacity, salt_rows).drop("uid")
