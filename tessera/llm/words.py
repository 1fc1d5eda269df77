"""Vectorised words of a batch of texts: where they lie in the bytes, and 64-bit hashes of words and runs of words.

A word is mixed in eight bytes at a time (long ones by a library hash), so no family of words collides, as it would
with polynomials modulo a power of two; a run's hash is built from those of its halves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .common import IS_SPACE, release

#: Bytes of text that are worked on together.
BATCH_BYTES = 1 << 18
#: Bytes from which a slice is hashed by the library.
LONG = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SEED, _LENGTH, _LEFT, _RIGHT = (np.uint64(x) for x in (0x51ED270B9F3A7C15, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each slice; ``data`` has eight bytes more than any slice reaches."""
    lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    left = ends - starts
    out = mix(left.astype(np.uint64) * _LENGTH ^ _SEED)
    long = np.flatnonzero(left > LONG)
    for i in long.tolist():
        out[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]]))
    todo, at = np.flatnonzero((left > 0) & (left <= LONG)), 0
    while len(todo):
        lane = lanes[starts[todo] + at] & _MASKS[np.minimum(left[todo] - at, 8)]
        out[todo] = mix(out[todo] ^ (lane * _RIGHT))
        at += 8
        todo = todo[left[todo] > at]
    out[long] = mix(out[long])
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) * _LEFT + b * _RIGHT)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` neighbouring hashes, by the first of them."""
    out, length, power, reach = None, 0, hashes, 1
    pieces = []
    while reach <= size:
        if size & reach:
            pieces.append((power, reach))
        power = _joined(power[:-reach], power[reach:]) if len(power) > reach else power[:0]
        reach *= 2
    n = max(0, len(hashes) - size + 1)
    for power, reach in reversed(pieces):
        part = power[length : length + n]
        out = part if out is None else _joined(out, part)
        length += reach
    return out[:n]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts; a text's words are first[i] to first[i + 1]."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join([*texts, b""])
        padded = np.frombuffer(joined + b"\n" * 8, np.uint8)
        if lower:
            padded = np.where((padded >= 65) & (padded <= 90), padded + np.uint8(32), padded)
        self.padded, self.bytes = padded, padded[: len(joined)]
        self.text_starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        space = IS_SPACE[self.bytes]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1 if len(space) else np.zeros(0, int)
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.text_starts)
        self.space = space

    def hashes(self) -> np.ndarray:
        """One hash per word."""
        return slice_hashes(self.padded, self.starts, self.ends)

    def owner(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def batches_of(texts: Iterable[bytes | None], limit: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    """Texts in lists of about so many bytes, nulls as empty; a longer text is a list of its own."""
    some: list[bytes] = []
    size = 0
    for text in texts:
        text = text or b""
        if some and size + len(text) > limit:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def binaries(column: pa.Array, rows: int = 128) -> Iterator[bytes | None]:
    """The bytes of a column's texts, a few at a time."""
    for a in range(0, len(column), rows):
        yield from column.slice(a, rows).cast(pa.binary()).to_pylist()
    release()


def sums_between(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring cuts."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[cuts[1:]] - total[cuts[:-1]]
