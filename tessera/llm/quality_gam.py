"""Quality scores by a generalised additive model with pairwise interactions.

Features of a text are binned; cyclic boosting visits one feature after another and adds a shallow tree's leaves
to that feature's lookup table, then does the same with trees over the strongest pairs (Lou et al. 2013). A
score is the logistic of a few table entries' sum, looked up for whole batches at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import LINE_COUNTS, Counts
from .words import batches_of, binaries

FEATURES = ("log_words", "word_chars", "symbols", "upper", "digits", "loud", "marks", "repeats", "stops", "short", "runs", "copies", "fresh", "line_words")
#: Labelled rows that the model is fitted on at most: those of least hash, so the choice doesn't depend on partitions.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE, LEAF_ROWS = 120, 60, 0.1, 1.0, 20
THRESHOLD = 0.7


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text; an empty text's are zeros."""
    c = Counts(texts)
    t = dict(zip(LINE_COUNTS, c.text.T.astype(float), strict=True))
    one = lambda x: np.maximum(x, 1)
    words, chars = one(t["words"]), one(t["chars"])
    return np.stack([
        np.log1p(t["words"]), t["chars"] / words, t["symbols"] / chars, t["upper"] / one(t["upper"] + t["lower"] + t["high"]), t["digits"] / chars, t["loud"] / words, t["marks"] / words,
        t["repeats"] / words, t["stops"] / words, t["short"] / words, t["runs"] / words, c.copies / one(c.n_lines), c.fresh / words, t["words"] / one(c.n_lines),
    ], axis=1)


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: np.ndarray
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for f in range(b.shape[1]):
            total += self.tables[f][b[:, f]]
        for table, (i, j) in zip(self.pair_tables, self.pairs, strict=True):
            total += table[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-total))


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best cut of binned gradients, or (0, 0)."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain = np.where((nl >= LEAF_ROWS) & (nr >= LEAF_ROWS), gain, 0)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) and gain.max() > 1e-9 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values of a tree of that depth over one feature's bins."""
    cut = _best_cut(g, h, n)[1] if depth else 0
    if not cut:
        return np.full(len(g), -g.sum() / (h.sum() + RIDGE))
    return np.concatenate([shallow_tree(*(x[part] for x in (g, h, n)), depth - 1) for part in (slice(0, cut), slice(cut, None))])


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree that cuts one feature of a pair, then the other on either side; its gain and leaf values."""
    best = (0.0, np.zeros(g.shape))
    for flip in (False, True):
        gg, hh, nn = (x.T if flip else x for x in (g, h, n))
        _, cut = _best_cut(gg.sum(1), hh.sum(1), nn.sum(1))
        for c in {cut, len(gg) // 2} - {0}:
            halves = [shallow_tree(*(x[part].sum(0) for x in (gg, hh, nn)), 1) for part in (slice(0, c), slice(c, None))]
            values = np.repeat(np.stack(halves), [c, len(gg) - c], axis=0)
            gain = float(-(gg * values).sum() - 0.5 * (hh * values**2).sum())
            if gain > best[0]:
                best = (gain, values.T if flip else values)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of labels ``y``; without labels of both kinds, their share everywhere (0.5 without any)."""
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    model = Model(float(np.log(share / (1 - share))), [], np.zeros((0, BINS)), [], [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    model.tables = np.zeros((x.shape[1], BINS))
    b = model.bins(x)
    score = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        return p - y, p * (1 - p)

    rows = [np.bincount(b[:, f], minlength=BINS) for f in range(x.shape[1])]
    for _ in range(ROUNDS):
        for f in range(x.shape[1]):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(b[:, f], g, BINS), np.bincount(b[:, f], h, BINS), rows[f])
            model.tables[f] += step
            score += step[b[:, f]]
    for f in range(x.shape[1]):  # bins of about equal rows, several fine bins to a coarse one
        below = (np.cumsum(rows[f]) - rows[f]) / max(1, len(y))
        model.coarse.append(np.minimum((below * PAIR_BINS).astype(int), PAIR_BINS - 1))
    c = np.stack([model.coarse[f][b[:, f]] for f in range(x.shape[1])], axis=1)
    cells = lambda i, j, v: np.bincount(c[:, i] * PAIR_BINS + c[:, j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = slopes()
    gains = {(i, j): pair_tree(cells(i, j, g), cells(i, j, h), cells(i, j, None))[0] for i, j in combinations(range(x.shape[1]), 2)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pair_tables = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * pair_tree(cells(i, j, g), cells(i, j, h), cells(i, j, None))[1]
            model.pair_tables[k] += step
            score += step[c[:, i], c[:, j]]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 2 modulo 4; a null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """(doc_id, label, text) of at most ``sample_rows`` labelled ids outside the held-out part.

    The ids come first and are at most ``sample_rows``, whatever the tables' sizes, so they are broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).dropna().filter(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of ``label`` fitted on the driver to a bounded sample's features, which executors compute."""

    def run(batches):
        for batch in batches:
            done = 0
            for texts in batches_of(binaries(batch.column("text"))):
                rows = features(texts)
                part = batch.slice(done, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "label", "features"])
                done += len(texts)

    found = labelled(docs, labels, label, sample_rows).select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label double, features array<double>")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("features", "label")).alias("r")).orderBy("doc_id").select("r.*").collect()
    return fit(np.array([r["features"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; a map without any shuffle. Null texts score as empty ones."""

    def run(batches):
        for batch in batches:
            done = 0
            for texts in batches_of(binaries(batch.column("text"))):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(texts)), pa.array(model.score(features(texts)))], ["doc_id", "score"])
                done += len(texts)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``threshold`` or more; a map without any shuffle."""

    at = [c.lower() for c in docs.columns].index("text")
    # By place, so that columns may have any names.
    placed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches):
        for batch in batches:
            scores = [model.score(features(texts)) for texts in batches_of(binaries(batch.column(at)))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= threshold))

    return placed.mapInArrow(run, placed.schema).toDF(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null labels are left out, of several labels of an id the largest counts, and without labels of both kinds
    the score is their share (0.5 without any). Null ids are scored too and are not held out; repeated rows get
    the same score; columns other than doc_id and text are not read.
    """
    scored = score(docs, train(docs, labels, label, sample_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
