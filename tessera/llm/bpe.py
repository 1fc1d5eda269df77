"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

A batch of texts becomes one array of code points, then one of code-point classes. Where a token begins depends
on the classes of a character and its neighbours, and on whether an apostrophe stands where a token may begin.
The latter is a state, carried by transition functions: each character is a function from state to state, four
states of two bits packed in a byte, and functions compose associatively, so prefix compositions come from a
scan in a logarithmic number of array operations. No regular expression runs over a text.
"""

from __future__ import annotations

import base64
import functools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import release

#: Code points that are encoded together, so that arrays stay in cache-sized pieces.
BATCH_CHARS = 1 << 18
#: Pre-tokens in each of two caches: a full one becomes the older one, which those in use come back from.
CACHE_ENTRIES = 250_000
SCAN_BLOCK = 256

LETTER, NUMBER, BLANK, SPACE, OTHER, QUOTE = range(6)
#: States: FREE, an apostrophe here may open a contraction; HELD, it belongs to a run of other characters;
#: ONE and TWO, so many letters of a contraction are still to come.
FREE, HELD, ONE, TWO = range(4)


def _function(*to: int) -> int:
    return sum(s << (2 * i) for i, s in enumerate(to))


# What a character does to the state, by its kind; RESET begins a text.
RESET = _function(FREE, FREE, FREE, FREE)
ENDS_FREE = _function(FREE, FREE, FREE, ONE)
ENDS_HELD = _function(HELD, HELD, HELD, HELD)
OPENS_ONE = _function(ONE, HELD, HELD, HELD)
OPENS_TWO = _function(TWO, HELD, HELD, HELD)
BY_CLASS = np.array([ENDS_FREE, RESET, RESET, ENDS_HELD, ENDS_HELD, ENDS_HELD], np.uint8)


@functools.cache
def composition() -> np.ndarray:
    """Of functions f then g, both packed, the packed g(f): 65536 entries at f * 256 + g."""
    code = np.arange(256)
    out = np.zeros((256, 256), np.int64)
    for s in range(4):
        middle = (code >> (2 * s)) & 3
        out |= ((code[None, :] >> (2 * middle[:, None])) & 3) << (2 * s)
    return out.astype(np.uint8).ravel()


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, by Unicode category and white space."""
    import regex

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, everything):
            a, b = (x + 0x800 * (x >= 0xD800) for x in m.span())
            out[a : b if b > a else b + 0x800] = kind
    out[0x20], out[0x27] = SPACE, QUOTE
    return out


def scan(functions: np.ndarray) -> np.ndarray:
    """Prefix compositions of packed transition functions: within blocks, over the blocks' totals, then both."""
    table, n = composition(), len(functions)
    identity = _function(0, 1, 2, 3)
    blocks = np.full(-(-n // SCAN_BLOCK) * SCAN_BLOCK, identity, np.uint8)
    blocks[:n] = functions
    blocks = blocks.reshape(-1, SCAN_BLOCK)

    def inclusive(x: np.ndarray) -> np.ndarray:
        step = 1
        while step < x.shape[1]:
            later = table[(x[:, :-step].astype(np.uint16) << 8) | x[:, step:]]
            x = np.concatenate([x[:, :step], later], axis=1)
            step *= 2
        return x

    blocks = inclusive(blocks)
    if len(blocks) > 1:
        before = np.concatenate([[np.uint8(identity)], inclusive(blocks[None, :, -1])[0, :-1]])
        blocks = table[(before.astype(np.uint16)[:, None] << 8) | blocks]
    return blocks.ravel()[:n]


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where tokens begin in the code points of several texts; ``starts`` is where texts begin, in order."""
    n = len(points)
    kind = classes()[points]
    head = np.zeros(n + 2, bool)
    head[starts[starts < n]] = True
    head[n] = True
    after, second = np.full(n, 0, points.dtype), np.full(n, 0, points.dtype)
    after[:-1] = np.where(head[1:n], 0, points[1:])
    second[:-2] = np.where(head[1 : n - 1] | head[2:n], 0, points[2:])
    char = lambda x: np.uint32(ord(x))
    quote = kind == QUOTE
    one = quote & np.isin(after, [char(x) for x in "stmd"])
    two = quote & (((after == char("r")) | (after == char("v"))) & (second == char("e")) | (after == char("l")) & (second == char("l")))
    functions = BY_CLASS[kind]
    functions[one], functions[two] = OPENS_ONE, OPENS_TWO
    # A text's first character starts from FREE, whatever came before.
    first = np.flatnonzero(head[:n])
    to = functions[first] & 3
    functions[first] = to * 0b01010101
    state = scan(functions) & 3
    before = np.empty(n, np.uint8)
    before[:1], before[1:] = FREE, state[:-1]
    before[first] = FREE
    white = (kind == BLANK) | (kind == SPACE)
    same = np.where(kind == QUOTE, OTHER, kind)
    previous, was_white = np.empty(n, np.uint8), np.zeros(n, bool)
    previous[:1], previous[1:] = 255, same[:-1]
    was_white[1:] = white[:-1]
    ends_white = np.ones(n, bool)
    ends_white[:-1] = head[1:n] | ~white[1:]
    inside = (before == ONE) | (before == TWO)
    opens = (before == FREE) & (one | two)
    after_contraction = np.zeros(n, bool)
    after_contraction[1:] = inside[:-1] & (state[:-1] == FREE)
    # A last white character before others stands alone, or leads them if it is a space; before the text's end it doesn't.
    at_end = head[1 : n + 1]
    begins = np.where(white, ~was_white | (ends_white & ~at_end), (same != previous) & (previous != SPACE))
    begins |= opens | after_contraction | head[:n]
    return begins & ~inside


NO_MERGE = 1 << 40
#: A pair of ids as one key.
SHIFT = 20


def merged_pairs(ranks: dict[bytes, int]) -> dict[int, int]:
    """The id that each pair of ids merges to: every token at every cut into two tokens."""
    get, out = ranks.get, {}
    for token, i in ranks.items():
        for k in range(1, len(token)):
            if (a := get(token[:k])) is not None and (b := get(token[k:])) is not None:
                out[a << SHIFT | b] = i
    return out


def merge(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Ids of one pre-token from those of its bytes: the pair of the least merged id merges first, leftmost first."""
    if len(ids) > 500:
        return _long_merge(ids, pairs)
    get = pairs.get
    scores = [get(a << SHIFT | b, NO_MERGE) for a, b in zip(ids, ids[1:], strict=False)]
    while scores:
        best = min(scores)
        if best == NO_MERGE:
            break
        i = scores.index(best)
        ids[i] = best
        del ids[i + 1], scores[i]
        if i < len(scores):
            scores[i] = get(best << SHIFT | ids[i + 1], NO_MERGE)
        if i:
            scores[i - 1] = get(ids[i - 1] << SHIFT | best, NO_MERGE)
    return ids


def _long_merge(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """The same with a heap over linked parts: a very long pre-token takes n log n steps."""
    import heapq

    n = len(ids)
    after, before, live = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << SHIFT | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        to, i, left, right = heapq.heappop(heap)
        j = after[i]
        if not live[i] or j < 0 or ids[i] != left or ids[j] != right:
            continue
        ids[i], live[j], after[i] = to, False, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] >= 0 and (r := pairs.get(ids[a] << SHIFT | ids[after[a]])) is not None:
                heapq.heappush(heap, (r, a, ids[a], ids[after[a]]))
    return [ids[i] for i in range(n) if live[i]]


class ByteBpe:
    """Encoder and decoder over a rank table (token bytes to id, lower ids merge first)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        #: Added tokens of a tokenizers file by their ids; encode_batch() takes them for ordinary text.
        self.added: dict[str, int] = {}
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.cache: dict[bytes, list[int]] = {}
        self.older: dict[bytes, list[int]] = {}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    @classmethod
    def from_bytes(cls, data: bytes, kind: str) -> ByteBpe:
        """``kind``: tiktoken (base64 token and rank a line) or json (a tokenizers file with a byte-level model)."""
        if kind == "tiktoken":
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)})
        saved = json.loads(data)
        special = {x["content"] for x in saved["added_tokens"]}
        own = {chr(x) for x in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
        shown = {c: ord(c) for c in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in own)}
        out = cls({bytes(shown[c] for c in token): i for token, i in saved["model"]["vocab"].items() if token not in special})
        if any(x.get(k) for x in saved["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take white space or stand as single words only are not supported")
        out.added = {x["content"]: x["id"] for x in saved["added_tokens"]}
        return out

    @functools.cached_property
    def added_pattern(self) -> re.Pattern | None:
        """Finds added tokens as the tokenizers library does: the leftmost, and of those the longest."""
        return re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        return merged_pairs(self.ranks)

    def ids_of(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that the cache doesn't have: from the cache before it, else merged; remembered."""
        ids = self.older.get(piece)
        if ids is None:
            whole = self.ranks.get(piece)
            ids = [whole] if whole is not None else merge([self.bytes[b] for b in piece], self.pairs)
        if len(piece) <= 64:
            if len(self.cache) >= CACHE_ENTRIES:
                self.older = dict(self.cache)
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets at which texts begin, with the end as the last."""
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        data = joined.encode("utf-8", "replace")
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        at = np.flatnonzero(boundaries(points, starts[:-1]))
        if len(data) > len(points):
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            byte_at = np.concatenate([[0], np.cumsum(width)])
            cuts = byte_at[np.append(at, len(points))].tolist()
        else:
            cuts = [*at.tolist(), len(points)]
        ids: list[int] = []
        sizes = []
        get, extend, miss = self.cache.get, ids.extend, self.ids_of
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = data[a:b]
            found = get(piece) or miss(piece)
            extend(found)
            sizes.append(len(found))
        ends = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
        return np.array(ids, np.int32), ends[np.searchsorted(at, starts, "left")]

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of every text; the ids of a text lie between neighbouring offsets."""
        pieces, cuts = list(map(self.tokens.__getitem__, ids.tolist())), offsets.tolist()
        return [b"".join(pieces[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def batched(texts: Iterable[str | None], chars: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Texts in lists of about so many code points; nulls as empty. A longer text is a list of its own."""
    some: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if some and size + len(text) > chars:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


@functools.cache
def _loaded(name: str) -> ByteBpe:
    with open(SparkFiles.get(name), "rb") as f:
        return ByteBpe.from_bytes(f.read(), "json" if name.endswith(".json") else "tiktoken")


def ship(spark: SparkSession, path: str) -> str:
    """Sends a vocabulary file, of fixed size, to all executors, and returns the name that loaded() takes."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def loaded(name: str) -> ByteBpe:
    """The vocabulary on a worker, read once a process."""
    return _loaded(name)


def encode(docs: DataFrame, vocabulary: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of every row, by the rank or tokenizers file at ``vocabulary``; a map, without any shuffle.

    With ``decoded``, the bytes that the ids decode to as well, made from the ids while they are at hand.
    Null and empty texts have no ids; special-token strings are ordinary text; repeated rows and null ids of
    documents come out as they went in; other columns are not read.
    """
    name = ship(docs.sparkSession, vocabulary)
    names = ["doc_id", "ids", "decoded"] if decoded else ["doc_id", "ids"]

    def run(batches):
        for batch in batches:
            done = 0
            for texts in batched(texts_in(batch.column("text"))):
                ids, offsets = loaded(name).encode_batch(texts)
                columns = [batch.column("doc_id").slice(done, len(texts)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded:
                    columns.append(pa.array(loaded(name).decode_batch(ids, offsets), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)
                done += len(texts)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def texts_in(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The strings of a column, a few at a time."""
    for a in range(0, len(column), rows):
        yield from column.slice(a, rows).to_pylist()
    release()


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` (any columns, with ``ids``) and ``decoded``, the bytes of its ids; null ids as none."""
    name = ship(encoded.sparkSession, vocabulary)
    kept = [c for c in encoded.columns if c != "decoded"]

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            lists = lists.fill_null([]) if lists.null_count else lists
            offsets = lists.offsets.to_numpy()
            decoded = loaded(name).decode_batch(lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(decoded, pa.binary())], [*kept, "decoded"])

    return encoded.select(*[f"`{c}`" for c in kept]).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in kept) + ", decoded binary")
