"""Substring deduplication behind a count-min prefilter.

Documents meet in groups of some megabytes. First pass: every group counts into a count-min sketch, the groups'
sketches are merged by block, and each group is told the estimates of its own cells. A window is counted by its
anchor, the 10-word run of least hash within it. Equal windows have equal anchors at different places, so an
anchor's count is never below its windows' counts, and the sketch's estimate is never below that: no repeated
window is missed, and a window costs the sketch a sixth of a count. Second pass: only windows estimated repeated
are sent on, neighbours that share a range of anchors as one passage with its words, and every occurrence but the
first in order of (doc_id, start) is removed. Windows meet by hash and are grouped by their words, byte for byte.

Each level keeps of equal windows the first, so a passage that very many documents share is never all in one task.
All passes read one shuffle of the texts; nothing is collected or broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import power_of_two, release, total_bytes
from .sketch import PARTS, Sketch
from .words import Words, batches_of, mix, runs

WINDOW = 20
ANCHOR = 10
ROWS = 2
#: Cells of a sketch row for each byte of text: some eight for each anchor.
CELLS = 8 / 36
#: Bytes of text for each group of documents, and for each range of anchors.
GROUP_BYTES, RANGE_BYTES = 4 << 20, 4 << 20
#: Groups whose windows meet at once; with more, they meet in several levels.
FAN_IN = 4096
#: A longer text is looked at in pieces of so many words.
PIECE_BYTES, PIECE_WORDS = 1 << 20, 1 << 17
#: Low bits of an anchor's order that say its place, so that of equal runs the first counts.
_PLACE = np.uint64((1 << 31) - 1)


def sliding_min(keys: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours."""
    out, reach = keys, 1
    while reach * 2 <= size:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(keys) - size + 1], out[size - reach :]) if reach < size else out


class Windows:
    """The windows of a batch of texts: first words, and the place and hash of each one's anchor."""

    def __init__(self, texts: list[bytes], window: int):
        self.words = w = Words(texts)
        self.size = window
        run = min(ANCHOR, window)
        n = len(w.starts)
        ends = np.repeat(w.first[1:], np.diff(w.first))
        self.at = np.flatnonzero(np.arange(n) + window <= ends)
        if not len(self.at):
            self.anchor_at, self.anchor, self.hash = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            return
        hashes = w.hashes()
        found = runs(hashes, run)
        place = np.arange(len(found), dtype=np.uint64)
        least = sliding_min((found & ~_PLACE) | place, window - run + 1)
        self.anchor_at = (least[self.at] & _PLACE).astype(np.int64)
        self.anchor = found[self.anchor_at]
        self.hash = runs(hashes, window)[self.at]

    def distinct_anchors(self) -> np.ndarray:
        """The hash of each place that is an anchor, once a place."""
        new = np.ones(len(self.anchor_at), bool)
        new[1:] = self.anchor_at[1:] != self.anchor_at[:-1]
        return self.anchor[new]


def distinct_texts(table: pa.Table) -> tuple[list[tuple[int, bytes]], np.ndarray]:
    """The distinct (doc_id, text) of a group in order, and which of them each row is; -1 without either."""
    keys = [(i, t) if i is not None and t is not None else None for i, t in zip(table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist(), strict=True)]
    order = sorted({k for k in keys if k is not None})
    place = {k: n for n, k in enumerate(order)}
    return order, np.array([-1 if k is None else place[k] for k in keys], np.int64)


def pieces(texts: list[bytes], window: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words joined by one space, long texts in pieces that share no window; each one's text and first word."""
    out, of, first = [], [], []
    for k, text in enumerate(texts):
        words = text.split()
        step = PIECE_WORDS if len(text) > PIECE_BYTES else max(1, len(words))
        for a in range(0, max(1, len(words) - window + 1), step):
            out.append(b" ".join(words[a : a + step + window - 1]))
            of.append(k)
            first.append(a)
    return out, np.array(of, np.int64), np.array(first, np.int64)


def equals(buffer: bytes, lo: np.ndarray, hi: np.ndarray, text: np.ndarray, keys: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each window the first, by (doc, start), of those with the same words.

    Windows are buffer[lo:hi], their words joined by one space. They meet by ``keys``; the words of neighbours that
    have neighbours as their firsts are compared at once. Should windows of one key differ, these are grouped
    by their words alone.
    """
    order = np.lexsort((start, doc, keys))
    k = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = k[1:] != k[:-1]
    head = np.flatnonzero(new)
    of = np.empty(len(order), np.int64)
    of[order] = np.repeat(order[head], np.diff(np.append(head, len(order))))
    copies = np.flatnonzero(of != np.arange(len(of)))
    if not len(copies):
        return of
    firsts = of[copies]
    cut = np.ones(len(copies), bool)
    cut[1:] = (np.diff(copies) != 1) | (np.diff(firsts) != 1) | (np.diff(text[copies]) != 0) | (np.diff(text[firsts]) != 0)
    a = np.flatnonzero(cut)
    b = np.append(a[1:], len(copies)) - 1
    ends = (lo[copies[a]], hi[copies[b]], lo[firsts[a]], hi[firsts[b]])
    unlike = [n for n, (p, q, r, s) in enumerate(zip(*(x.tolist() for x in ends), strict=True)) if buffer[p:q] != buffer[r:s]]
    if unlike:
        bad = np.unique(np.concatenate([keys[copies[a[n] : b[n] + 1]] for n in unlike]))
        seen: dict[bytes, int] = {}
        for i in order[np.isin(k, bad)].tolist():
            of[i] = seen.setdefault(buffer[lo[i] : hi[i]], i)
    return of


#: ``span``: a range of anchors, or -1 - group for what is removed. ``to``: which groups meet.
FOUND = "span int, to int, data binary"
_HEAD = (("doc", "<i8"), ("start", "<i4"), ("at", "<i4"), ("group", "<i4"))


def _row_of(columns: list[np.ndarray], tail: bytes = b"") -> bytes:
    return b"".join([np.uint32(len(columns[0])).tobytes(), *[c.tobytes() for c in columns], tail])


def _columns_of(data: bytes, kinds: tuple[str, ...]) -> tuple[list[np.ndarray], bytes]:
    n, at, out = int(np.frombuffer(data, "<u4", 1)[0]), 4, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out, data[at:]


def _frame(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["span", "to", "data"])


def hand_on(buffer: bytes, w: dict[str, np.ndarray], to: int | None) -> list[tuple[int, int, bytes]]:
    """Rows of windows that come after the first of their words, by group, and of the others as passages (none if ``to`` is).

    ``w`` has lo, hi, text, key, doc, start, at, group and span of each window; neighbours follow each other.
    """
    if not len(w["key"]):
        return []
    of = equals(buffer, w["lo"], w["hi"], w["text"], w["key"], w["doc"], w["start"])
    later = (w["doc"] != w["doc"][of]) | (w["start"] != w["start"][of])

    def stretches(which: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last of neighbouring windows among ``which``, sorted by ``by``, and where that changes."""
        if not len(which):
            return which, which, np.zeros(1, np.int64)
        cut = np.ones(len(which), bool)
        cut[1:] = (np.diff(which) != 1) | (np.diff(w["text"][which]) != 0) | (np.diff(w["start"][which]) != 1) | (np.diff(w["span"][which]) != 0)
        a = np.flatnonzero(cut)
        first, last = which[a], which[np.append(a[1:], len(which)) - 1]
        order = np.argsort(by[first], kind="stable")
        first, last = first[order], last[order]
        return first, last, np.flatnonzero(np.concatenate([[True], np.diff(by[first]) != 0, [True]]))

    rows = []
    first, last, cuts = stretches(np.flatnonzero(later), w["group"])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        f = first[a:b]
        rows.append((-1 - int(w["group"][f[0]]), 0, _row_of([w["at"][f], w["start"][f], (last[a:b] - f + 1).astype("<i4")])))
    if to is None:
        return rows
    first, last, cuts = stretches(np.flatnonzero(~later), w["span"])
    lo, hi = w["lo"][first].tolist(), w["hi"][last].tolist()
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        f = first[a:b]
        rows.append((int(w["span"][f[0]]), to, _row_of([w[c][f] for c, _ in _HEAD], b"\n".join([buffer[lo[i] : hi[i]] for i in range(a, b)]))))
    return rows


def resolve(table: pa.Table, window: int, fan: int, last: bool) -> pa.Table:
    """One level of a range: what isn't the first of its words goes back to its group, the others meet at the next level."""
    span, to = table.column("span")[0].as_py(), table.column("to")[0].as_py()
    if span < 0:
        return table
    heads, texts = [], []
    for data in table.column("data"):
        columns, text = _columns_of(data.as_py(), tuple(k for _, k in _HEAD))
        heads.append(columns)
        texts.append(text)
    doc, start, at, group = (np.concatenate(c) for c in zip(*heads, strict=True))
    buffer = b"\n".join(texts)
    words = Words(buffer.split(b"\n"))
    place = np.flatnonzero(np.arange(len(words.starts)) + window <= np.repeat(words.first[1:], np.diff(words.first)))
    text = np.searchsorted(words.first, place, "right") - 1
    found = {"lo": words.starts[place], "hi": words.ends[place + window - 1], "text": text, "key": runs(words.hashes(), window)[place], "doc": doc[text]}
    found |= {"start": (start[text] + place - words.first[text]).astype("<i4"), "at": at[text], "group": group[text], "span": np.full(len(place), span, np.int32)}
    return _frame(hand_on(buffer, found, None if last else to // fan))


def kept_words(text: bytes, removed: np.ndarray | None, window: int, joined: bool) -> tuple[bytes, int, int]:
    """The text without the words of the removed windows, (first, number) each, the number of its words and of those gone."""
    words = text.split()
    if removed is None:
        return (b" ".join(words) if joined else text), len(words), 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, removed[:, 0], 1)
    np.add.at(edge, removed[:, 0] + removed[:, 1] + window - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    n = int(gone.sum())
    if joined:
        return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]), len(words), n
    w = Words([text])
    keep = np.ones(len(text), bool)
    after = np.append(w.starts[1:], len(text))
    for i in np.flatnonzero(gone).tolist():
        keep[w.starts[i] : after[i]] = False
    return np.frombuffer(text, np.uint8)[keep].tobytes(), len(words), n


def grouped_rows(docs: DataFrame, size: int, keep: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Rows (group, doc_id, text, kept) and the number of groups, each of some GROUP_BYTES; ``kept`` is a struct of columns.

    Names of the caller's columns stand in the struct alone, so they can't clash.
    """
    groups = max(1, -(-size // GROUP_BYTES))
    own_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    group = F.pmod(F.xxhash64(own_id, text), F.lit(groups)).cast("int")
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("string")
    return docs.select(group.alias("group"), own_id.alias("doc_id"), text.alias("text"), kept.alias("kept")), groups


def substring_dedup(docs: DataFrame, window: int = WINDOW, joined: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns in ``keep``, text, n_words, n_removed.

    Removed is each word covered by a ``window`` of words whose sequence also starts earlier: in a smaller doc_id,
    or earlier in the same document. ``text`` is what is left: with ``joined`` the kept words joined by one space,
    else the text without each removed word and the white space after it.

    A null text has no words (and stays null unless ``joined``). Rows without doc_id take no part: nothing is
    removed from or for them. Rows that repeat a doc_id and its text are one place, so neither removes from the
    other, and get the same result; of one doc_id's different texts each loses what also starts earlier, in
    another document or in any of these texts. Columns of any names may be kept, but not as doc_id, text, n_words
    or n_removed: a kept column of one of the last two names replaces the count. Others are not read.
    """
    size = total_bytes(docs, "text")
    sketch = Sketch.of(CELLS * size, ROWS, 1)
    spans, per_level = power_of_two(size / RANGE_BYTES, 1, 1 << 30), FAN_IN
    rows, groups = grouped_rows(docs, size, keep)
    by_group = rows.filter("doc_id is not null and text is not null").groupBy("group")

    def counted(table: pa.Table) -> pa.Table:
        texts = pieces([t for _, t in distinct_texts(table)[0]], window)[0]
        anchors = [Windows(some, window).distinct_anchors() for some in batches_of(texts)]
        return sketch.parts(np.concatenate([np.zeros(0, np.uint64), *anchors]), table.column("group")[0].as_py())

    def found(owned: pa.Table, told: pa.Table) -> pa.Table:
        if not owned.num_rows:
            return _frame([])
        group, known = owned.column("group")[0].as_py(), distinct_texts(owned)[0]
        del owned
        texts, of, first = pieces([t for _, t in known], window)
        ids = np.array([i for i, _ in known], np.int64)
        del known
        parts, anchors, done, base = [], [], 0, 0
        for some in batches_of(texts):
            w = Windows(some, window)
            text = np.searchsorted(w.words.first, w.at, "right") - 1
            lo, hi = w.words.starts[w.at] + base, w.words.ends[w.at + window - 1] + base
            start = (first[done + text] + w.at - w.words.first[text]).astype("<i4")
            parts.append((w.anchor, w.hash, lo, hi, text + done, start))
            anchors.append(w.distinct_anchors())
            done += len(some)
            base += sum(map(len, some)) + len(some)
        anchors = np.concatenate([np.zeros(0, np.uint64), *anchors])
        repeated = np.unique(anchors[sketch.estimates(told, anchors) > 0])
        picked = []
        for part in parts:
            near = np.minimum(np.searchsorted(repeated, part[0]), max(0, len(repeated) - 1))
            mask = repeated[near] == part[0] if len(repeated) else np.zeros(len(part[0]), bool)
            picked.append([c[mask] for c in part])
        del parts, anchors
        if not picked:
            return _frame([])
        anchor, key, lo, hi, text, start = (np.concatenate(c) for c in zip(*picked, strict=True))
        del picked
        span = (mix(anchor) >> np.uint64(64 - spans.bit_length() + 1)).astype(np.int32) if spans > 1 else np.zeros(len(anchor), np.int32)
        w = {"lo": lo, "hi": hi, "text": text, "key": key, "doc": ids[of[text]], "start": start, "at": of[text].astype("<i4"), "group": np.full(len(text), group, np.int32), "span": span}
        out = _frame(hand_on(b"\n".join(texts), w, 0 if groups <= per_level else group // per_level))
        release()
        return out

    def cut(owned: pa.Table, gone: pa.Table) -> pa.Table:
        known, place = distinct_texts(owned)
        removed: dict[int, np.ndarray] = {}
        if gone.num_rows:
            lists = [_columns_of(x.as_py(), ("<i4", "<i4", "<i4"))[0] for x in gone.column("data")]
            at, start, many = (np.concatenate(c).astype(np.int64) for c in zip(*lists, strict=True))
            order = np.argsort(at, kind="stable")
            heads, begin = np.unique(at[order], return_index=True)
            both = np.stack([start, many], axis=1)[order]
            removed = dict(zip(heads.tolist(), np.split(both, begin[1:]), strict=True))
        return written(owned, [removed.get(p) for p in place.tolist()])

    def written(owned, removed: list[np.ndarray | None]) -> pa.Table:
        given = owned.column("text").cast(pa.binary()).to_pylist()
        results = [kept_words(t or b"", r, window, joined) for t, r in zip(given, removed, strict=True)]
        texts = pa.array([None if t is None and not joined else r[0] for t, r in zip(given, results, strict=True)], pa.binary()).cast(pa.string())
        counts = [pa.array([r[k] for r in results], pa.int64()) for k in (1, 2)]
        out = pa.Table.from_arrays([owned.column("doc_id"), owned.column("kept"), texts, *counts], ["doc_id", "kept", "text", "n_words", "n_removed"])
        release()
        return out

    def untouched(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield from written(part, [None] * part.num_rows).to_batches()

    def level(last: bool):
        return lambda table: resolve(table, window, per_level, last)

    parts = by_group.applyInArrow(counted, PARTS)
    windows = by_group.cogroup(sketch.answers(parts).groupBy("group")).applyInArrow(found, FOUND)
    left = groups
    while left:
        left = -(-left // per_level) if left > per_level else 0
        windows = windows.groupBy("span", "to").applyInArrow(level(not left), FOUND)
    removed = windows.filter("span < 0").select((-1 - F.col("span")).alias("group"), "data")
    schema = StructType([rows.schema["doc_id"], rows.schema["kept"], rows.schema["text"], StructField("n_words", LongType()), StructField("n_removed", LongType())])
    result = by_group.cogroup(removed.groupBy("group")).applyInArrow(cut, schema)
    # Rows that take no part may be very many alike, and meet nowhere.
    alone = rows.filter("doc_id is null or text is null").select("doc_id", "kept", "text")
    result = result.union(alone.mapInArrow(untouched, schema))
    counts = [c for c in ("n_words", "n_removed") if c not in {k.lower() for k in keep}]
    return result.select("doc_id", *[F.col("kept").getField(k).alias(k) for k in keep], "text", *counts)
