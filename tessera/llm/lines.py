"""Counts per line and per text that the quality operators build on, for a batch of texts at once."""

from __future__ import annotations

import numpy as np

from .words import Words, mix, runs, slice_hashes, sums_between

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.zeros(256, bool)
LOWER[97:123] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOPS = np.zeros(256, bool)
STOPS[list(b".!?")] = True
LOUD = np.zeros(256, bool)
LOUD[list(b"!|")] = True
MARKS = np.zeros(256, bool)
MARKS[list(b",.;:'\"()-")] = True
LINE_COUNTS = ("words", "chars", "bytes", "symbols", "upper", "lower", "digits", "loud", "marks", "high", "repeats", "stops", "short", "runs")


def marked(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of (owner, hash) pairs, for each the count of its equals."""
    _, inverse, counts = np.unique(mix(h ^ mix(owner.astype(np.uint64) + np.uint64(0x51ED270B))), return_inverse=True, return_counts=True)
    return counts[inverse]


class Counts:
    """Of a batch of texts: ``line`` has a column of LINE_COUNTS for each line, ``text`` the sums over a text's lines."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts)
        b, n_texts = w.bytes, len(texts)
        newline = np.flatnonzero(b == 10)
        cuts = np.concatenate([[0], newline + 1])
        owner = np.repeat(np.arange(n_texts), np.diff(w.first))
        h = w.hashes()
        # Words within 3-word windows that the same text has twice or more.
        repeated = np.zeros(len(h), bool)
        if len(h) >= 3:
            inside = owner[2:] == owner[:-2]
            at = np.flatnonzero(inside)
            again = at[marked(owner[at], runs(h, 3)[at]) > 1] if len(at) else at
            for k in range(3):
                repeated[again + k] = True
        by_line = np.searchsorted(w.starts, cuts)
        sums = lambda flags: sums_between(flags, cuts)
        length = w.ends - w.starts
        last = b[w.ends - 1] if len(h) else np.zeros(0, np.uint8)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        chars = (b & 0xC0) != 0x80
        columns = [
            np.diff(by_line), sums(chars & ~w.space), np.diff(cuts) - 1, sums(SYMBOLS[b]), sums(UPPER[b]), sums(LOWER[b]), sums(DIGIT[b]), sums(LOUD[b]), sums(MARKS[b]), sums(chars & (b >= 0x80)),
            sums_between(repeated, by_line), sums_between(STOPS[last], by_line), sums_between(length <= 3, by_line), sums_between(same, by_line),
        ]
        self.line = np.stack(columns, axis=1).astype(np.int64) if len(newline) else np.zeros((0, len(LINE_COUNTS)), np.int64)
        self.first = np.searchsorted(cuts[:-1], w.text_starts)
        line_owner = np.repeat(np.arange(n_texts), np.diff(self.first))
        full = np.flatnonzero(self.line[:, 0] > 0)
        line_hash = slice_hashes(w.padded, cuts[full], cuts[full + 1] - 1)
        # Of equal lines of a text, all but the first are copies.
        key = mix(line_hash ^ mix(line_owner[full].astype(np.uint64) + np.uint64(0x2545F491)))
        first_of = np.unique(key, return_index=True)[1]
        self.copy = np.zeros(len(self.line), bool)
        self.copy[full] = True
        self.copy[full[first_of]] = False
        total = np.concatenate([np.zeros((1, self.line.shape[1]), np.int64), np.cumsum(self.line, axis=0)])
        self.text = total[self.first[1:]] - total[self.first[:-1]]
        self.copies = sums_between(self.copy, self.first)
        distinct = np.unique(mix(h ^ mix(owner.astype(np.uint64) + np.uint64(0x1234567))), return_index=True)[1]
        fresh = np.zeros(len(h), bool)
        fresh[distinct] = True
        self.fresh = sums_between(fresh, w.first)
        self.n_lines = sums_between(self.line[:, 0] > 0, self.first)
