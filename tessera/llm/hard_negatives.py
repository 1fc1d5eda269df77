"""Hard negatives by vantage-point trees over norm-augmented vectors.

A vector x gets one more entry, the square root of M**2 - |x|**2, where M is the largest norm, and an anchor is
scaled to norm M; then all lie on one sphere, and distance falls as the inner product grows: a window of scores is an
annulus of distances. Rows go to cells of a top tree, fitted on a bounded sample, so that a cell's rows are near each
other; a cell's rows are cut into shards, and each shard is one vantage-point tree with its rows in tree order.

Anchors are a stated query set against all rows, in blocks: a block of anchors meets all shards of a lot in one task.
Trees are traversed nearest first: subtrees wait in a heap by the least distance that the triangle inequality leaves
them, leaves yield their rows, and the traversal ends where the k-th row found is nearer than all that waits. For an
anchor's positives this starts at the anchor; for the negatives of a positive it starts at the annulus's inner
edge and never leaves its outer one. Distances only decide what is looked at, with some slack; what is compared and
returned are the integer scores.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .whitening import usable

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
#: A negative's score is between these shares of the positive's, in hundredths.
LEAST, MOST = 30, 90
#: Rows that the top tree is fitted on, its leaves at most, rows of a shard and of a leaf, anchors of a block.
SAMPLE_ROWS, CELLS, SHARD_ROWS, LEAF_ROWS, BLOCK_ANCHORS = 8192, 256, 4096, 512, 4096
#: Shards of a lot at most, and lots that there are at least, given as many shards.
LOT_SHARDS, LEAST_LOTS = 64, 64
#: How far off, relatively, a distance may be.
SLACK = 1e-7
ROWS = "vec_id long, label int, x binary"


@dataclass
class Tree:
    """A vantage-point tree in arrays: node i has children 2i + 1 (near) and 2i + 2 (far), each with the range of its distances to i's vantage point."""

    depth: int
    vantage: np.ndarray  # augmented vectors, one a node
    low: np.ndarray
    high: np.ndarray
    bounds: np.ndarray  # rows of the node, from bounds[i, 0] to bounds[i, 1]


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - to) ** 2).sum(-1), 0.0))


def build(points: np.ndarray, leaf: int) -> tuple[Tree, np.ndarray]:
    """A tree over augmented points, and the points' order in it: halves by distance to a point of the middle of each node."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(points)) / leaf))))
    nodes = (1 << depth + 1) - 1
    order = np.arange(len(points))
    tree = Tree(depth, np.zeros((nodes, points.shape[1])), np.zeros(nodes), np.full(nodes, np.inf), np.zeros((nodes, 2), np.int64))
    tree.bounds[0] = 0, len(points)
    for i in range(nodes):
        a, b = tree.bounds[i]
        if i >= (nodes - 1) // 2 or a == b:
            if i < (nodes - 1) // 2:
                tree.bounds[2 * i + 1] = tree.bounds[2 * i + 2] = a, a
            continue
        own = points[order[a:b]]
        # The point farthest from the first one is at the node's edge, where distances differ most.
        tree.vantage[i] = own[distances(own, own[0]).argmax()]
        far = distances(own, tree.vantage[i])
        by = np.argsort(far, kind="stable")
        order[a:b], far, m = order[a:b][by], far[by], (b - a + 1) // 2
        for child, lo, hi in ((2 * i + 1, 0, m), (2 * i + 2, m, b - a)):
            tree.bounds[child] = a + lo, a + hi
            if hi > lo:
                tree.low[child], tree.high[child] = far[lo], far[hi - 1]
    return tree, order


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    squares = (x * x).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(norm * norm - squares, 0.0))[:, None]], axis=1)


class Shard:
    """Rows in the order of a tree over them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, norm: float, leaf: int = LEAF_ROWS):
        self.tree, order = build(augmented(x.astype(np.float64), norm), leaf)
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        # Products of doubles are exact while all partial sums are, which the norms bound.
        self.exact = x.astype(np.float64)[order] if norm * norm < 2.0**52 else self.x


class Search:
    """One anchor's traversals over several shards."""

    def __init__(self, shards: list[Shard], anchor: np.ndarray, norm: float):
        self.shards, self.norm = shards, norm
        own = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
        self.scale = norm / own if own else 1.0
        self.square = norm * norm + (norm * norm if own else 0.0)
        self.point = np.append(anchor.astype(np.float64) * self.scale, 0.0)
        self.anchor = {np.dtype(np.float64): anchor.astype(np.float64), np.dtype(np.int64): anchor}
        self.slack = SLACK * max(norm, 1.0)
        self.to_vantage = [distances(s.tree.vantage, self.point) for s in shards]
        self.scores: dict[tuple[int, int], np.ndarray] = {}

    def distance(self, score: float) -> float:
        """How far off a row of this score is."""
        return float(np.sqrt(max(self.square - 2.0 * self.scale * score, 0.0)))

    def leaf(self, shard: int, node: int) -> np.ndarray:
        """The integer scores of a leaf's rows, once an anchor."""
        if (shard, node) not in self.scores:
            s = self.shards[shard]
            a, b = s.tree.bounds[node]
            self.scores[shard, node] = (s.exact[a:b] @ self.anchor[s.exact.dtype]).astype(np.int64)
        return self.scores[shard, node]

    def nearest(self, k: int, wanted, low: int | None = None, high: int | None = None) -> list[tuple[int, int]]:
        """The first ``k`` (score, id), higher scores and smaller ids first, among rows that ``wanted`` takes with scores from ``low`` to ``high``."""
        inner = 0.0 if high is None else max(0.0, self.distance(high) - self.slack)
        outer = np.inf if low is None else self.distance(low) + self.slack
        waiting, found = [(inner, s, 0, 0.0, np.inf) for s in range(len(self.shards)) if len(self.shards[s].ids)], []  # a heap, as all are alike
        while waiting:
            near, s, node, least, most = heapq.heappop(waiting)
            # Nothing that waits is nearer than the k-th found.
            if len(found) == k and near > self.distance(found[0][0]) + self.slack:
                break
            tree = self.shards[s].tree
            if node >= (1 << tree.depth) - 1:
                self._taken(found, k, s, node, wanted, low, high)
                continue
            d = self.to_vantage[s][node]
            for child in (2 * node + 1, 2 * node + 2):
                if tree.bounds[child, 0] < tree.bounds[child, 1]:
                    lo = max(least, d - tree.high[child], tree.low[child] - d)
                    hi = min(most, d + tree.high[child])
                    if lo - self.slack <= outer and hi + self.slack >= inner:
                        heapq.heappush(waiting, (max(inner, lo - self.slack), s, child, lo, hi))
        return [(score, -i) for score, i in sorted(found, reverse=True)]

    def _taken(self, found: list[tuple[int, int]], k: int, s: int, node: int, wanted, low, high) -> None:
        a, b = self.shards[s].tree.bounds[node]
        scores, ids = self.leaf(s, node), self.shards[s].ids[a:b]
        good = wanted(ids, self.shards[s].labels[a:b])
        if low is not None:
            good &= (scores >= low) & (scores <= high)
        if len(found) == k:
            good &= scores >= found[0][0]
        which = np.flatnonzero(good)
        if len(which) > k:
            which = which[np.lexsort((ids[which], -scores[which]))[:k]]
        for i in which.tolist():
            entry = (int(scores[i]), -int(ids[i]))
            if len(found) < k:
                heapq.heappush(found, entry)
            elif entry > found[0]:
                heapq.heapreplace(found, entry)


def window_of(positive: int, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """The least and the greatest score s with least * positive <= 100 * s <= most * positive."""
    return -(-least * positive // 100), most * positive // 100


# -- tables


def prepared(embeddings: DataFrame, scale: int = SCALE, relabel: Column | None = None) -> DataFrame:
    """(vec_id, label, x, square) of the rows that take part; x is the integers floor(scale * entry), little-endian longs."""
    label = F.col("label").cast("int") if relabel is None else relabel
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches):
        for batch in batches:
            for k, entries in usable(batch.column("embedding")):
                x = np.floor(entries * scale)
                square = (x * x).sum(1)
                if square.size and square.max() >= 2.0**62:
                    raise ValueError("inner products don't fit a long")
                at, x = pa.array(k, pa.int64()), x.astype("<i8")
                body = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * x.shape[1]), len(k), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), body, pa.array(square)], ["vec_id", "label", "x", "square"])

    return rows.filter("vec_id is not null and label is not null and embedding is not null").mapInArrow(run, ROWS + ", square double")


def _matrix(column, dim: int) -> np.ndarray:
    """Packed vectors as rows; shorter ones end with zeros."""
    data = column.to_pylist()
    if all(len(b) == 8 * dim for b in data):
        return np.frombuffer(b"".join(data), "<i8").reshape(-1, dim)
    return np.frombuffer(b"".join(b.ljust(8 * dim, b"\0") for b in data), "<i8").reshape(-1, dim)


def _cell_of(top: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf of the top tree that each point falls to."""
    node = np.zeros(len(points), np.int64)
    for _ in range(top.depth):
        far = distances(points, top.vantage[node])
        near, other = top.high[2 * node + 1], top.low[2 * node + 2]
        node = 2 * node + 1 + (far > (near + np.where(np.isfinite(other), other, near)) / 2)
    return node - ((1 << top.depth) - 1)


def mine(embeddings: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE, relabel: Column | None = None, shard_rows: int = SHARD_ROWS, block_anchors: int = BLOCK_ANCHORS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor, positive and negative.

    ``embeddings`` has vec_id, label and embedding; ``anchors`` is a condition on vec_id. Rows without vec_id or label,
    or whose vector is null, empty, or holds null or non-finite entries, take no part. A score is the inner product of
    floor(scale * entry); shorter vectors end with zeros. An anchor's positives are its first ``positives`` other rows
    (of another vec_id) of its label, higher scores first, ties by the smaller vec_id. Each has the first ``negatives`` rows of
    other labels whose score is from ``least`` to ``most`` hundredths of its own. Positives without any have no rows.
    Rows that repeat a vec_id each count; repeated anchors are one if label and vector agree too. An empty table
    gives no rows. Inner products beyond a long are a ValueError. Other columns are not read.

    Of all that the driver holds, only the sample for the top tree has rows: ``sample_rows`` of least hash.
    """
    spark = embeddings.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = prepared(embeddings, scale, relabel)
    total, square, width = rows.agg(F.count("*"), F.max("square"), F.max(F.length("x"))).first()
    if not total:
        return spark.createDataFrame([], schema)
    norm, dim = float(np.sqrt(square)) + 1e-9, width // 8
    sample = rows.select("x", F.xxhash64("vec_id", "x").alias("h")).orderBy("h", "x").limit(sample_rows).select("x").toArrow()
    points = augmented(_matrix(sample.column("x"), dim).astype(np.float64), norm)
    top = build(points, max(1, len(points) // CELLS))[0]
    def placed(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            where = _cell_of(top, augmented(x.astype(np.float64), norm)) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.select(["vec_id", "label", "x"]).columns, pa.array(where, pa.int32())], ["vec_id", "label", "x", "cell"])

    here = rows.select("vec_id", "label", "x").mapInArrow(placed, ROWS + ", cell int")
    # A shard has its number of rows, whatever cells are crowded: neighbouring small cells share one, a large cell has several.
    dealt = checkpointed(here)
    counts = dict(tuple(r) for r in dealt.groupBy("cell").count().collect())
    before = np.cumsum([0, *(counts.get(c, 0) for c in range(1 << top.depth))]).tolist()
    at = F.get(F.array(*map(F.lit, before[:-1])), F.col("cell")) + F.rand(7) * F.get(F.array(*[F.lit(counts.get(c, 0)) for c in range(1 << top.depth)]), F.col("cell"))
    shards = -(-total // shard_rows)
    lots = max(-(-shards // LOT_SHARDS), min(shards, LEAST_LOTS))
    shard = F.floor(at / shard_rows).cast("int")
    asked = checkpointed(dealt.filter(anchors).select("vec_id", "label", "x").distinct())
    blocks = max(1, -(-asked.count() // block_anchors))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def loaded(table: pa.Table) -> list[Shard]:
        of, ids, labels = (table.column(c).to_numpy() for c in ("shard", "vec_id", "label"))
        x = _matrix(table.column("x"), dim)
        return [Shard(ids[k], labels[k], x[k], norm) for s in np.unique(of).tolist() for k in [np.flatnonzero(of == s)]]

    def met(left: DataFrame, search, out: str) -> DataFrame:
        """``search`` for each block of anchors and lot of shards."""
        # Shards of a lot are neighbours; a row may be in another shard the next time, which changes no result.
        data = dealt.select("vec_id", "label", "x", shard.alias("shard")).withColumn("lot", F.floor(F.col("shard") * lots / shards).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        sent = left.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
        return data.groupBy("block", "lot").cogroup(sent.groupBy("block", "lot")).applyInArrow(search, out)

    def near(table: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if table.num_rows and asking.num_rows:
            shards_here = loaded(table)
            for i, label, x, v in zip(asking.column("vec_id").to_pylist(), asking.column("label").to_pylist(), _matrix(asking.column("x"), dim), asking.column("x").to_pylist(), strict=True):
                found = Search(shards_here, x, norm).nearest(positives, lambda ids, labels, i=i, label=label: (ids != i) & (labels == label))
                out += [(i, label, v, other, score) for score, other in found]
        return pa.Table.from_pylist([dict(zip(("vec_id", "label", "x", "positive_id", "positive_score"), r, strict=True)) for r in out], pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("x", pa.binary()), ("positive_id", pa.int64()), ("positive_score", pa.int64())]))

    def inside(table: pa.Table, asking: pa.Table) -> pa.Table:
        names = ("vec_id", "label", "x", "positive_score", "negative_id", "negative_score")
        out: list[tuple] = []
        if table.num_rows and asking.num_rows:
            shards_here = loaded(table)
            for i, label, x, v, scores in zip(*(asking.column(c).to_pylist() for c in ("vec_id", "label")), _matrix(asking.column("x"), dim), *(asking.column(c).to_pylist() for c in ("x", "scores")), strict=True):
                one = Search(shards_here, x, norm)
                for score in scores:
                    low, high = window_of(score, least, most)
                    if low <= high:
                        out += [(i, label, v, score, other, s) for s, other in one.nearest(negatives, lambda ids, labels, label=label: labels != label, low, high)]
        return pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in out], pa.schema([(n, pa.int32() if n == "label" else pa.binary() if n == "x" else pa.int64()) for n in names]))

    anchor = ["vec_id", "label", "x"]
    best = lambda keys, score, tie: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))
    candidates = met(asked, near, ROWS + ", positive_id long, positive_score long")
    chosen = checkpointed(candidates.withColumn("n", best(anchor, "positive_score", "positive_id")).filter(F.col("n") <= positives).drop("n"))
    # Positives of one score have one window.
    windows = chosen.groupBy(*anchor).agg(F.collect_set("positive_score").alias("scores")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    found = met(windows, inside, ROWS + ", positive_score long, negative_id long, negative_score long")
    ranked = found.withColumn("rank", best([*anchor, "positive_score"], "negative_score", "negative_id")).filter(F.col("rank") <= negatives)
    both = chosen.join(ranked, [*anchor, "positive_score"])
    return both.select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
