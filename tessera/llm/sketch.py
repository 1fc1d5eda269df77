"""Count-min sketches of groups of documents, merged by block of cells, whose estimates go back to the groups.

A group counts its hashes in cells; a block of cells meets in one task, which sums what all groups counted there and
returns to each group the totals of just the cells that it sent. So neither the driver nor any task ever holds a
whole sketch, nothing is broadcast, and the sketch grows with the data. Of several sketch rows the least total
counts: never below a hash's true count, as far as totals are told apart; a group counts a hash 255 times at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import power_of_two
from .words import mix

PARTS = "row int, block int, group int, data binary"
ANSWERS = "group int, row int, block int, data binary"
_SALTS = (np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1))
LEAST_CELLS = 1 << 16
#: Cells of a block, at most 64 MB of counts in the task that merges it, and blocks of a row before blocks grow.
MOST_BLOCK_BITS, BLOCKS_BITS = 24, 6


@dataclass(frozen=True)
class Sketch:
    """``width`` cells in each of ``rows`` rows; totals up to 2**``steps`` are told apart by their power of two."""

    width: int
    rows: int
    steps: int

    @staticmethod
    def of(cells: float, rows: int, steps: int) -> Sketch:
        return Sketch(power_of_two(cells, LEAST_CELLS, 1 << 54), rows, steps)

    @property
    def block_bits(self) -> int:
        return min(MOST_BLOCK_BITS, max(16, self.width.bit_length() - 1 - BLOCKS_BITS))

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        return (mix(hashes ^ _SALTS[row]) >> np.uint64(64 - self.width.bit_length() + 1)).astype(np.int64)

    def parts(self, hashes: np.ndarray, group: int) -> pa.Table:
        """What a group has to add to each block: its distinct cells, as gaps in byte planes, and their counts."""
        rows, blocks, data = [], [], []
        for row in range(self.rows):
            found, counts = np.unique(self.cells(hashes, row), return_counts=True)
            counts = np.minimum(counts, 255).astype(np.uint8)
            block, local = found >> self.block_bits, found & ((1 << self.block_bits) - 1)
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(found) else np.zeros(1, int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                gaps = np.diff(local[a:b], prepend=0).astype("<u4")
                rows.append(row)
                blocks.append(int(block[a]))
                data.append(gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + counts[a:b].tobytes())
        columns = [pa.array(rows, pa.int32()), pa.array(blocks, pa.int32()), pa.array([group] * len(rows), pa.int32()), pa.array(data, pa.binary())]
        return pa.Table.from_arrays(columns, ["row", "block", "group", "data"])

    @staticmethod
    def _cells_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        body = np.frombuffer(data, np.uint8)
        n = len(body) // 5
        return np.cumsum(np.ascontiguousarray(body[: 4 * n].reshape(4, n).T).view("<u4").ravel(), dtype=np.int64), body[4 * n :]

    def merge(self, table: pa.Table) -> pa.Table:
        """One block: totals over all groups; each group gets those of its cells, as powers of two (0: once)."""
        total = np.zeros(1 << self.block_bits, np.uint32)
        sent = [self._cells_of(x.as_py()) for x in table.column("data")]
        top = np.uint32(1 << self.steps)
        for places, counts in sent:
            # A group's places are distinct; a total stops at the largest that is told apart, so it never wraps.
            total[places] = np.minimum(total[places] + counts, top)
        data = [np.log2(np.minimum(total[places], top)).astype(np.uint8).tobytes() for places, _ in sent]
        return pa.Table.from_arrays([table.column("group"), table.column("row"), table.column("block"), pa.array(data, pa.binary())], ["group", "row", "block", "data"])

    def estimates(self, answers: pa.Table, hashes: np.ndarray) -> np.ndarray:
        """The powers of two for the hashes that a group has sent."""
        out = np.full(len(hashes), 255, np.uint8)
        order = answers.select(["row", "block", "data"]).sort_by([("row", "ascending"), ("block", "ascending")])
        row_of, data = order.column("row").to_numpy(), order.column("data").to_pylist()
        for row in range(self.rows if len(hashes) else 0):
            inverse = np.unique(self.cells(hashes, row), return_inverse=True)[1]
            told = np.frombuffer(b"".join(data[i] for i in np.flatnonzero(row_of == row)), np.uint8)
            np.minimum(out, told[inverse], out=out)
        return out

    def answers(self, parts: DataFrame) -> DataFrame:
        """What every group is told, from ``parts`` of all groups (PARTS)."""
        return parts.groupBy("row", "block").applyInArrow(lambda table: self.merge(table), ANSWERS)
