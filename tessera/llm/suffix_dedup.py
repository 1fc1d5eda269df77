"""Suffix-array deduplication of byte strings, by linear grouping in buckets of anchored passages.

A window is ``WINDOW`` bytes of one text; it is repeated if the same bytes start anywhere else. Equal windows have
the same anchor, the 16 bytes of least hash in them, at the same place; so windows that share an anchor's place are
one passage, and only passages of equal anchors can hold equal windows. Texts meet in groups of some megabytes.

First pass: of each passage, blocks of 152 bytes at fixed places from the anchor, one in every window, are counted
by hash, exactly, in ranges of hashes, and each group is told which of its blocks there are twice. A window whose
block is there once is not repeated. Second pass: the other windows travel as passages, to a range of anchors. There
each anchor's passages are one string of 8-byte symbols, counted from the anchor, whose suffix order comes from
``suffix_groups``; neighbours in that order that agree in all symbols of a window are one class, which the bytes
before the first symbol and after the last divide further. Equal passages are one string that counts for all.
Third pass: all bytes of repeated windows go.

Hashes only tell where to meet or what to leave out; what is removed has been compared byte for byte. Groups that
share an anchor meet in several levels, each of which hands on distinct passages, so what very many texts share is
never all in one task. Nothing is collected or broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import power_of_two, release, total_bytes
from .substring_dedup import sliding_min
from .suffix_groups import ranges, suffix_orders
from .words import mix

WINDOW = 200
#: Bytes of an anchor and of a symbol; distance of the blocks that are counted.
ANCHOR, SYMBOL, STEP = 16, 8, 48
#: Bytes of text for each group of documents (more in large corpora, so that rows between passes stay long) and range.
GROUP_BYTES, MOST_GROUP_BYTES, RANGE_BYTES = 4 << 20, 32 << 20, 4 << 20
#: Groups whose passages meet at once; with more, they meet in several levels.
FAN_IN = 4096
#: Texts that are looked at together, and the pieces of longer ones.
BATCH_BYTES, PIECE_BYTES = 1 << 18, 1 << 20
#: Symbols whose suffixes are ordered together.
BATCH_SYMBOLS = 1 << 20
_PLACE = np.uint64((1 << 31) - 1)
_FACTOR, _A, _B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
COUNTED = "span int, group int, data binary"
FOUND = "span int, to int, data binary"


def _lanes(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


class Sums:
    """Hashes of slices of a buffer, for meeting only: differences of sums of bytes times powers."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE)]))
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _FACTOR)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: n - 1])])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def anchored(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The passages of some texts: the joined bytes, and of each passage the first window, their number, the anchor's place and hash."""
    data = np.frombuffer(b"".join(texts) + b"\0" * 24, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    at = ranges(np.cumsum(sizes) - sizes, np.maximum(0, sizes - window + 1))
    if not len(at):
        none = np.zeros(0, np.int64)
        return data, none, none, none, np.zeros(0, np.uint64)
    lanes = _lanes(data)
    grams = mix(mix(lanes[: len(data) - 24 - ANCHOR + 1] * _A) * _B + lanes[8 : len(data) - 16 - ANCHOR + 1])
    least = sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), window - ANCHOR + 1)
    place = (least[at] & _PLACE).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
    return data, at[head], np.diff(np.append(head, len(at))), place[head], grams[place[head]]


def in_order(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """A group's texts as bytes, in an order that is the same in every pass, and each row's place in it."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return [texts[i] for i in order], place


def batches(texts: list[bytes], window: int):
    """(pieces, text of each, first byte of each) of about BATCH_BYTES; longer texts in pieces that share no window."""
    some, of, first, size = [], [], [], 0
    for k, text in enumerate(texts):
        step = PIECE_BYTES if len(text) > PIECE_BYTES else len(text)
        for a in range(0, max(1, len(text) - window + 1), step):
            piece = text[a : a + step + window - 1]
            if some and size + len(piece) > BATCH_BYTES:
                yield some, np.array(of), np.array(first)
                some, of, first, size = [], [], [], 0
            some.append(piece)
            of.append(k)
            first.append(a)
            size += len(piece)
    if some:
        yield some, np.array(of), np.array(first)


class Passages:
    """The passages of a batch and their blocks: one of each passage for each STEP of the distance to the anchor."""

    def __init__(self, texts: list[bytes], window: int):
        self.data, self.start, self.number, self.anchor, self.hash = anchored(texts, window)
        self.window = window
        far = self.anchor - self.start
        low, high = (far - self.number + 1) // STEP, far // STEP
        many = high - low + 1
        self.passage = np.repeat(np.arange(len(far)), many)
        self.step = ranges(low, many)
        begin = self.anchor[self.passage] - STEP * self.step
        self.block = mix(Sums(self.data).of(begin, begin + window - STEP) ^ (self.hash[self.passage] * _A + self.step.astype(np.uint64)))

    def cut(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, farthest, nearest) of neighbouring windows of a passage whose blocks are ``repeated``, by distance to the anchor."""
        k = np.flatnonzero(repeated)
        new = np.ones(len(k), bool)
        new[1:] = (np.diff(k) != 1) | (np.diff(self.passage[k]) != 0)
        a = np.flatnonzero(new)
        b = k[np.append(a[1:], len(k)) - 1] if len(k) else k
        a = k[a]
        of = self.passage[a]
        far = self.anchor[of] - self.start[of]
        nearest = np.maximum(far - self.number[of] + 1, STEP * self.step[a])
        farthest = np.minimum(far, STEP * self.step[b] + STEP - 1)
        return of, farthest, nearest


class Strings:
    """Distinct passages as strings of bytes, each with its anchor's hash and place in it, and where they occur.

    ``more`` tells that a string occurs elsewhere too; occurrences are (string, group, text, first window).
    """

    def __init__(self, data: bytes, size, hash_, far, more, of, group, at, start):
        self.data, self.size, self.hash, self.far, self.more = data, size, hash_, far, more
        self.of, self.group, self.at, self.start = of, group, at, start

    def packed(self, which: np.ndarray, begin: np.ndarray) -> bytes:
        """The strings ``which``, and their occurrences, which must be in the order of strings."""
        first = np.searchsorted(self.of, which, "left")
        many = np.searchsorted(self.of, which, "right") - first
        occ = ranges(first, many)
        heads = [self.size[which].astype("<i4"), self.hash[which].astype("<u8"), self.far[which].astype("<i4"), self.more[which].astype("<i4"), many.astype("<i4")]
        tails = [self.group[occ].astype("<i4"), self.at[occ].astype("<i4"), self.start[occ].astype("<i4")]
        body = [self.data[a : a + n] for a, n in zip(begin[which].tolist(), self.size[which].tolist(), strict=True)]
        return b"".join([np.array([len(which), len(occ)], "<u4").tobytes(), *[c.tobytes() for c in heads + tails], *body])

    @staticmethod
    def read(rows: list[bytes]) -> Strings:
        parts, bodies, before = [], [], 0
        for row in rows:
            n, m = np.frombuffer(row, "<u4", 2).astype(int).tolist()
            at, out = 8, []
            for kind, k in (("<i4", n), ("<u8", n), ("<i4", n), ("<i4", n), ("<i4", n), ("<i4", m), ("<i4", m), ("<i4", m)):
                out.append(np.frombuffer(row, kind, k, at))
                at += k * int(kind[2])
            out[4] = np.repeat(np.arange(before, before + n), out[4])
            before += n
            parts.append(out)
            bodies.append(row[at:])
        size, hash_, far, more, of, group, start_at, start = (np.concatenate(c) for c in zip(*parts, strict=True))
        return Strings(b"".join(bodies), size.astype(np.int64), hash_, far.astype(np.int64), more.astype(bool), of, group, start_at, start)


def merged(data: bytes, begin: np.ndarray, size: np.ndarray, far: np.ndarray, hash_: np.ndarray, padded: np.ndarray) -> np.ndarray:
    """For each passage in a buffer the first of those of the same bytes, anchor and place of it; only equal ones are merged."""
    key = np.array([xxhash.xxh3_64_intdigest(data[a : a + n]) for a, n in zip(begin.tolist(), size.tolist(), strict=True)], np.uint64)
    order = np.lexsort((hash_, far, size, key))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in (key, size, far, hash_)])
    head = np.flatnonzero(new)
    of = np.empty(len(order), np.int64)
    of[order] = np.repeat(order[head], np.diff(np.append(head, len(order))))
    lanes, todo, at = _lanes(padded), np.flatnonzero(of != np.arange(len(of))), 0
    while len(todo):
        shift = (np.uint64(8) * np.maximum(0, at + 8 - size[todo]).astype(np.uint64)).astype(np.uint64)
        unlike = ((lanes[begin[todo] + at] ^ lanes[begin[of[todo]] + at]) << shift) != 0
        # Slices of one key that differ stay apart: later equal ones may be strings of their own, which their class then joins.
        of[todo[unlike]] = todo[unlike]
        at += 8
        todo = todo[~unlike]
        todo = todo[size[todo] > at]
    return of


def _padded(data: bytes) -> np.ndarray:
    return np.frombuffer(data + b"\0" * 16, np.uint8)


def repeated_windows(strings: Strings, weight: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, distance to the anchor) of the windows of distinct strings that occur twice or more.

    ``weight`` is how often each string occurs. Strings of an anchor are one text of symbols, divided by a symbol
    of its own kind; texts of like length have their suffixes ordered together.
    """
    padded = np.concatenate([np.zeros(SYMBOL, np.uint8), _padded(strings.data)])
    lanes, begin = _lanes(padded), np.cumsum(strings.size) - strings.size
    left = strings.far // SYMBOL
    many = left + (strings.size - strings.far) // SYMBOL
    origin = begin + strings.far - SYMBOL * left + SYMBOL
    by = np.argsort(strings.hash, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], np.diff(strings.hash[by]) != 0]))
    width = np.add.reduceat(many[by] + 1, head)
    per = np.diff(np.append(head, len(by)))
    long = np.argsort(-width, kind="stable")
    out, a = [], 0
    reach = np.cumsum(width[long])
    while a < len(long):
        b = max(a + 1, int(np.searchsorted(reach, (reach[a - 1] if a else 0) + BATCH_SYMBOLS, "right")))
        picked = long[a:b]
        out.append(_classes(by[ranges(head[picked], per[picked])], per[picked], width[picked], strings, weight, window, lanes, origin, many))
        a = b
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _classes(of, per, width, strings: Strings, weight, window, lanes, origin, many) -> tuple[np.ndarray, np.ndarray]:
    """The same of the strings ``of``, ``per`` of them a text of ``width`` symbols, ends included."""
    whole = many[of]
    # The symbols of every string and after it a divider; after an anchor's last one, the text's end.
    string = np.repeat(of, whole + 1)
    place = ranges(np.zeros(len(of), np.int64), whole + 1)
    divides = place == many[string]
    value = lanes[origin[string] + SYMBOL * np.where(divides, 0, place)]
    symbols = np.unique(value, return_inverse=True)[1] + 2
    symbols[divides] = 1
    symbols[np.cumsum(width) - 1] = 0
    order = suffix_orders(symbols, width)
    # Places with all the symbols of a window but those that its edges divide.
    full = window // SYMBOL - 1
    begin, size, far = origin[string] - SYMBOL, strings.size[string], strings.far[string]
    fits = ~divides & (place + full <= many[string])
    order = order[fits[order]]
    text = np.repeat(np.arange(len(per)), width)
    alike = text[order[1:]] == text[order[:-1]]
    todo = np.flatnonzero(alike)
    for k in range(full):
        differ = symbols[order[todo] + k] != symbols[order[todo + 1] + k]
        alike[todo[differ]] = False
        todo = todo[~differ]
    class_ = np.cumsum(np.concatenate([[0], ~alike])) if len(order) else np.zeros(0, np.int64)
    crowd = np.bincount(class_, minlength=1)[class_] > 1 if len(order) else np.zeros(0, bool)
    # A window begins r bytes before the first of its symbols and ends SYMBOL - r after the last.
    start = strings.far[string[order]] % SYMBOL + SYMBOL * place[order]
    distance = far[order] - start
    first_byte = begin[order] + SYMBOL * place[order]
    before, after = lanes[first_byte], lanes[first_byte + SYMBOL * (1 + full)]
    heavy = weight[string[order]] > 1
    found_of, found_at = [], []
    for r in range(SYMBOL):
        inside = (start >= r) & (start - r + window <= size[order])
        left = before >> np.uint64(8 * (SYMBOL - r)) if r else np.zeros(len(order), np.uint64)
        right = after << np.uint64(8 * r)
        twice = heavy & inside
        k = np.flatnonzero(inside & crowd)
        k = k[np.lexsort((right[k], left[k], class_[k]))]
        same = (class_[k[1:]] == class_[k[:-1]]) & (left[k[1:]] == left[k[:-1]]) & (right[k[1:]] == right[k[:-1]])
        twice[k[1:][same]] = True
        twice[k[:-1][same]] = True
        k = np.flatnonzero(twice)
        found_of.append(string[order[k]])
        found_at.append(distance[k] + r)
    return np.concatenate(found_of), np.concatenate(found_at)


def stretches(of: np.ndarray, distance: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, number) of neighbouring windows, counted from the string's first."""
    first = far[of] - distance
    order = np.lexsort((first, of))
    of, first = of[order], first[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(first) != 1)])) if len(of) else np.zeros(0, np.int64)
    return of[new], first[new], np.diff(np.append(new, len(of)))


def _frame(rows: list[tuple[int, int, bytes]], names=("span", "to", "data")) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], list(names))


def resolve(table: pa.Table, window: int, fan: int, last: bool) -> pa.Table:
    """One level of a range of anchors: repeated windows go back to their groups, distinct passages to the next level."""
    span, to = table.column("span")[0].as_py(), table.column("to")[0].as_py()
    if span < 0:
        return table
    s = Strings.read([x.as_py() for x in table.column("data")])
    padded, begin = _padded(s.data), np.cumsum(s.size) - s.size
    of = merged(s.data, begin, s.size, s.far, s.hash, padded)
    weight = np.bincount(of[s.of], minlength=len(of)) + 2 * np.bincount(of, weights=s.more, minlength=len(of)).astype(np.int64)
    kept = np.flatnonzero(of == np.arange(len(of)))
    name = np.zeros(len(of), np.int64)
    name[kept] = np.arange(len(kept))
    joined = b"".join([s.data[a : a + n] for a, n in zip(begin[kept].tolist(), s.size[kept].tolist(), strict=True)])
    by = np.argsort(name[of[s.of]], kind="stable")
    d = Strings(joined, s.size[kept], s.hash[kept], s.far[kept], weight[kept] > 1, name[of[s.of]][by], s.group[by], s.at[by], s.start[by])
    del s, padded
    string, first, number = stretches(*repeated_windows(d, weight[kept], window), d.far)
    lo = np.searchsorted(d.of, string, "left")
    many = np.searchsorted(d.of, string, "right") - lo
    occ = ranges(lo, many)
    told = np.stack([d.at[occ], d.start[occ] + np.repeat(first, many), np.repeat(number, many)]).astype("<i4")
    order = np.argsort(d.group[occ], kind="stable")
    group, told = d.group[occ][order], told[:, order]
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0, [True]])) if len(group) else np.zeros(1, int)
    rows = [(-1 - int(group[a]), 0, told[:, a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    if not last:
        # Where a passage has been told that all its windows are repeated, it only stands for its bytes from here on.
        once = ~d.more[d.of]
        d.of, d.group, d.at, d.start = d.of[once], d.group[once], d.at[once], d.start[once]
        rows.append((span, to // fan, d.packed(np.arange(len(d.size)), np.cumsum(d.size) - d.size)))
    release()
    return _frame(rows)


def kept_bytes(text: bytes, gone: np.ndarray | None, window: int) -> tuple[bytes, list[int], list[int]]:
    """The text without the windows of each (first, number), and the firsts and ends of what is removed."""
    if gone is None:
        return text, [], []
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, gone[0], 1)
    np.add.at(edge, gone[0] + gone[1] + window - 1, -1)
    out = np.cumsum(edge) > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[False], out]).astype(np.int8)))
    return np.frombuffer(text, np.uint8)[~out[:-1]].tobytes(), turn[0::2].tolist(), turn[1::2].tolist()


def suffix_dedup(docs: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = (), group_bytes: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns in ``keep``, left (binary), n_bytes, n_removed, span_starts, span_ends.

    Removed is each byte of a text's UTF-8 covered by a string of ``window`` bytes (a multiple of 8, 152 or more)
    that also starts anywhere else, in the same text or another, overlaps included; the first is removed too.
    Strings never cross texts. ``left`` is what remains, joined, and may be cut within a character; the spans are the
    maximal runs of removed bytes, ends exclusive.

    A null or empty text has no bytes and an empty ``left``. Each row is a text of its own, also one without a
    doc_id, and rows that repeat both doc_id and text remove each other. An empty table gives no rows. Columns of any
    names may be kept, but not as one of those returned. Others are not read.
    """
    if window % SYMBOL or window < ANCHOR + SYMBOL + 2 * STEP:
        raise ValueError(f"a window of {window} bytes")
    size = total_bytes(docs, "text")
    each = group_bytes or int(min(MOST_GROUP_BYTES, max(GROUP_BYTES, 4 * size**0.5)))
    groups, spans = max(1, -(-size // each)), power_of_two(size / max(each, RANGE_BYTES), 1, 1 << 30)
    span_of = lambda h: (h >> np.uint64(64 - spans.bit_length() + 1)).astype(np.int32) if spans > 1 else np.zeros(len(h), np.int32)
    own_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("string")
    rows = docs.select(F.pmod(F.xxhash64(own_id, text), F.lit(groups)).cast("int").alias("group"), own_id.alias("doc_id"), text.alias("text"), kept.alias("kept"))
    by_group = rows.filter(F.octet_length("text") >= window).groupBy("group")

    def distinct(some: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct blocks, in order, and whether each is there twice."""
        found = np.sort(np.concatenate([np.zeros(0, np.uint64), *some]))
        new = np.flatnonzero(np.concatenate([[True], np.diff(found) != 0])) if len(found) else np.zeros(0, np.int64)
        return found[new], np.diff(np.append(new, len(found))) > 1

    def counted(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        found, twice = distinct([Passages(some, window).block for some, _, _ in batches(in_order(table)[0], window)])
        span = span_of(found)
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(span) != 0, [True]])) if len(found) else np.zeros(1, int)
        out = _frame([(int(span[a]), group, found[a:b].tobytes() + np.packbits(twice[a:b]).tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], ("span", "group", "data"))
        release()
        return out

    def answered(table: pa.Table) -> pa.Table:
        sent, own = [], []
        for data in table.column("data").to_pylist():
            n = len(data) * 8 // 65
            sent.append(np.frombuffer(data, "<u8", n))
            own.append(np.unpackbits(np.frombuffer(data, np.uint8, -1, 8 * n), count=n).astype(bool))
        every = np.concatenate(sent)
        order = np.argsort(every, kind="stable")
        same = np.diff(every[order]) == 0
        twice = np.concatenate(own)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        # Blocks that several groups have are known by all; what one group has twice, it alone has.
        cuts = np.cumsum([0, *map(len, sent)])
        data = [np.packbits(twice[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.Table.from_arrays([table.column("span"), table.column("group"), pa.array(data, pa.binary())], ["span", "group", "data"])

    def found(owned: pa.Table, told: pa.Table) -> pa.Table:
        if not owned.num_rows:
            return _frame([])
        group, texts = owned.column("group")[0].as_py(), in_order(owned)[0]
        del owned
        looked = [(Passages(some, window), some, of, first) for some, of, first in batches(texts, window)]
        del texts
        known = distinct([p.block for p, *_ in looked])[0]
        span = span_of(known)
        answers = dict(zip(told.column("span").to_pylist(), told.column("data").to_pylist(), strict=True))
        heads, sizes = np.unique(span, return_counts=True)
        twice = np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(answers[s], np.uint8), count=n).astype(bool) for s, n in zip(heads.tolist(), sizes.tolist(), strict=True)]])
        known = known[twice]
        parts, bodies, base = [], [], 0
        for p, some, of, first in looked:
            near = np.minimum(np.searchsorted(known, p.block), max(0, len(known) - 1))
            passage, far, nearest = p.cut(known[near] == p.block if len(known) else np.zeros(len(p.block), bool))
            begin, size = p.anchor[passage] - far, far - nearest + window
            joined = b"".join(some)
            same = merged(joined, begin, size, far, p.hash[passage], p.data)
            own = same == np.arange(len(same))
            piece = np.searchsorted(np.cumsum([len(x) for x in some]), begin, "right")
            inside = np.concatenate([[0], np.cumsum([len(x) for x in some])])[piece]
            bodies += [joined[a : a + n] for a, n in zip(begin[own].tolist(), size[own].tolist(), strict=True)]
            name = np.cumsum(own) - 1 + base
            parts.append((size[own], p.hash[passage[own]], far[own], name[same], of[piece], first[piece] + begin - inside))
            base += int(own.sum())
        if not parts or not base:
            return _frame([])
        size, hash_, far, of, at, start = (np.concatenate(c) for c in zip(*parts, strict=True))
        by = np.argsort(of, kind="stable")
        s = Strings(b"".join(bodies), size, hash_, far, np.zeros(len(size), bool), of[by], np.full(len(of), group, np.int32), at[by], start[by])
        del bodies, parts, looked
        span, begin = span_of(mix(hash_ ^ _B)), np.cumsum(size) - size
        order = np.argsort(span, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(span[order]) != 0, [True]]))
        to = 0 if groups <= fan_in else group // fan_in
        out = _frame([(int(span[order[a]]), to, s.packed(order[a:b], begin)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
        release()
        return out

    def cut(owned: pa.Table, gone: pa.Table) -> pa.Table:
        place = in_order(owned)[1]
        removed: dict[int, np.ndarray] = {}
        if gone.num_rows:
            told = np.concatenate([np.frombuffer(x.as_py(), "<i4").reshape(3, -1) for x in gone.column("data")], axis=1).astype(np.int64)
            told = told[:, np.argsort(told[0], kind="stable")]
            heads, begin = np.unique(told[0], return_index=True)
            removed = dict(zip(heads.tolist(), np.split(told[1:], begin[1:], axis=1), strict=True))
        return written(owned, [removed.get(p) for p in place.tolist()])

    def written(owned, removed: list[np.ndarray | None]) -> pa.Table:
        texts = owned.column("text").cast(pa.binary()).to_pylist()
        left, starts, ends = [], [], []
        for t, r in zip(texts, removed, strict=True):
            some, a, b = kept_bytes(t, r, window)
            left.append(some)
            starts.append(a)
            ends.append(b)
        counts = [pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(x) for t, x in zip(texts, left, strict=True)], pa.int64())]
        places = [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)]
        out = pa.Table.from_arrays([owned.column("doc_id"), owned.column("kept"), pa.array(left, pa.binary()), *counts, *places], schema.names)
        release()
        return out

    def untouched(parts):
        for batch in parts:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield from written(part, [None] * part.num_rows).to_batches()

    def level(last: bool):
        return lambda table: resolve(table, window, fan_in, last)

    places = rows.selectExpr("cast(null as array<bigint>) span_starts", "cast(null as array<bigint>) span_ends").schema
    schema = StructType([rows.schema["doc_id"], rows.schema["kept"], StructField("left", BinaryType()), StructField("n_bytes", LongType()), StructField("n_removed", LongType()), *places])
    answers = by_group.applyInArrow(counted, COUNTED).groupBy("span").applyInArrow(answered, COUNTED)
    windows = by_group.cogroup(answers.groupBy("group")).applyInArrow(found, FOUND)
    left = groups
    while left:
        left = -(-left // fan_in) if left > fan_in else 0
        windows = windows.groupBy("span", "to").applyInArrow(level(not left), FOUND)
    removed = windows.filter("span < 0").select((-1 - F.col("span")).alias("group"), "data")
    result = by_group.cogroup(removed.groupBy("group")).applyInArrow(cut, schema)
    # Texts too short for a window may be very many alike, and meet nowhere.
    alone = rows.filter(F.octet_length("text") < window).select("doc_id", "kept", "text")
    result = result.union(alone.mapInArrow(untouched, schema))
    return result.select("doc_id", *[F.col("kept").getField(k).alias(k) for k in keep], "left", "n_bytes", "n_removed", "span_starts", "span_ends")
