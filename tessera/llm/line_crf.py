"""Quality rules with line labels: Viterbi decoding of a linear-chain conditional random field.

Each line of a text is content or boilerplate; the chain prefers neighbours alike. The verdict on a text is the
share of its words in content lines. The field is trained here, from document labels: lines take their
document's label, a first fit without transitions then relabels the lines of bad documents that look like
content, and the whole chain is fitted to that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .lines import LINE_COUNTS, Counts
from .quality_gam import labelled
from .words import batches_of, binaries

#: Labelled documents that the field is trained on at most, those of least hash: whole ones, until they have so many lines.
SAMPLE_ROWS, SAMPLE_LINES = 2_000, 100_000
#: Lines of a document that are trained on as one chain; longer documents are several, of which every line counts.
CHAIN = 512
LEAST_WORDS = 50
#: Percent of words in repeated 3-word windows beyond which a text fails.
MOST_REPEATED = 50
CONTENT_SHARE = 0.5
BINS, STEPS, RATE, DECAY = 8, 60, 0.15, 1e-3
LINE_BYTES = 8 * 12
#: Content, boilerplate.
STATES = 2
#: Lines of a chain that are decoded step by step.
BLOCK = 128


def line_features(c: Counts) -> np.ndarray:
    t = dict(zip(LINE_COUNTS, c.line.T.astype(float), strict=True))
    one = lambda x: np.maximum(x, 1)
    words, chars = one(t["words"]), one(t["chars"])
    return np.stack([
        t["words"], t["chars"] / words, t["symbols"] / chars, t["upper"] / one(t["upper"] + t["lower"]), t["digits"] / chars, t["loud"] / words,
        t["marks"] / words, t["repeats"] / words, t["stops"] / words, t["short"] / words, t["runs"] / words, c.copy.astype(float),
    ], axis=1)


class Chains:
    """Sequences laid end to end, sorted by length, so that step k of all that are longer is one slice."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(lengths)])[:-1][self.order]
        self.longest = int(lengths.max()) if len(lengths) else 0
        self.alive = np.searchsorted(-lengths[self.order], -np.arange(self.longest), "left")

    def steps(self, reverse: bool = False):
        ks = range(self.longest - 1, -1, -1) if reverse else range(self.longest)
        for k in ks:
            yield k, self.first[: self.alive[k]] + k


@dataclass
class Field:
    edges: list[np.ndarray]
    weights: np.ndarray  # feature, bin, state
    start: np.ndarray
    move: np.ndarray  # from, to

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), int)

    def emissions(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), STATES))
        for f in range(bins.shape[1]):
            out += self.weights[f][bins[:, f]]
        return out

    def viterbi(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The likeliest state of every line.

        Chains are cut into blocks that are all decoded at once, for each state that may come before a block; then
        the best way through each chain's blocks is found. So a text of very many lines takes few steps too.
        """
        scores, states = self.emissions(self.bins(x)), np.zeros(len(x), np.int8)
        lengths = lengths[lengths > 0]
        if not len(lengths):
            return states
        blocks = -(-lengths // BLOCK)
        sizes = np.full(int(blocks.sum()), BLOCK)
        sizes[np.cumsum(blocks) - 1] = lengths - (blocks - 1) * BLOCK
        first = np.cumsum(sizes) - sizes
        of_line = np.repeat(np.arange(len(sizes)), sizes)
        begins = np.zeros(len(sizes), bool)
        begins[np.cumsum(blocks) - blocks] = True
        within, across = Chains(sizes), Chains(blocks)
        # By line: the state before its block, its own state.
        ahead, back = np.zeros((len(x), STATES, STATES)), np.zeros((len(x), STATES, STATES), np.int8)
        ahead[first] = np.where(begins[:, None, None], self.start[None, None, :], self.move[None]) + scores[first][:, None, :]
        for k, at in within.steps():
            if k:
                through = ahead[at - 1][:, :, :, None] + self.move
                back[at] = through.argmax(2)
                ahead[at] = through.max(2) + scores[at][:, None, :]
        total = ahead[first + sizes - 1]
        best, before = total[:, 0, :].copy(), np.zeros((len(sizes), STATES), np.int8)
        for k, at in across.steps():
            if k:
                through = best[at - 1][:, :, None] + total[at]
                before[at] = through.argmax(1)
                best[at] = through.max(1)
        exits, entries = best.argmax(1).astype(np.int8), np.zeros(len(sizes), np.int8)
        for k, at in across.steps(reverse=True):
            entries[at] = before[at, exits[at]]
            if k:
                exits[at - 1] = entries[at]
        states[first + sizes - 1] = exits
        for k, at in within.steps(reverse=True):
            if k:
                states[at - 1] = back[at, entries[of_line[at]], states[at]]
        return states

    def expectations(self, scores: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
        """State probabilities of all lines, and the summed probabilities of moves, by forward and backward sums."""
        lse = np.logaddexp.reduce
        ahead, behind = scores.copy(), np.zeros_like(scores)
        for k, at in chains.steps():
            ahead[at] += self.start if k == 0 else lse(ahead[at - 1][:, :, None] + self.move, axis=1)
        moves = np.zeros((STATES, STATES))
        for k, at in chains.steps(reverse=True):
            if k:
                after = (scores[at] + behind[at])[:, None, :] + self.move
                behind[at - 1] = lse(after, axis=2)
                pair = ahead[at - 1][:, :, None] + after
                moves += np.exp(pair - lse(lse(pair, axis=2), axis=1)[:, None, None]).sum(0)
        total = ahead + behind
        return np.exp(total - lse(total, axis=1)[:, None]), moves


def fit(x: np.ndarray, lengths: np.ndarray, good: np.ndarray) -> Field:
    """The field of lines ``x`` of texts with ``lengths`` lines, of which ``good`` says whether they are content.

    Without texts of both kinds every line is content.
    """
    field = Field([], np.zeros((0, BINS, STATES)), np.zeros(STATES), np.zeros((STATES, STATES)))
    if len(np.unique(good)) < 2 or not len(x):
        field.start[0] = 1.0
        return field
    field.edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    field.weights = np.zeros((x.shape[1], BINS, STATES))
    bins, chains = field.bins(x), Chains(lengths)
    of_good = np.repeat(good, lengths)
    state = np.where(of_good, 0, 1)

    def climb(chained: bool) -> None:
        params = [field.weights, field.start, field.move]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        told = np.eye(STATES)[state]
        heads = chains.first[: chains.alive[0]] if chains.longest else np.zeros(0, int)
        inner = np.ones(len(x), bool)
        inner[heads] = False
        seen = np.zeros((STATES, STATES))
        at = np.flatnonzero(inner)
        np.add.at(seen, (state[at - 1], state[at]), 1)
        for step in range(1, STEPS + 1):
            probable, moves = field.expectations(field.emissions(bins), chains)
            off = told - probable
            slope = np.stack([np.stack([np.bincount(bins[:, f], off[:, s], BINS) for s in range(STATES)], axis=1) for f in range(bins.shape[1])])
            slopes = [slope / len(x), off[heads].sum(0) / len(x), (seen - moves) / len(x)]
            for i, (p, g) in enumerate(zip(params, slopes, strict=True)):
                if i and not chained:
                    continue
                g = g - DECAY * p
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g**2
                p += RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-9)

    climb(False)
    state[~of_good & (np.diff(field.emissions(bins), axis=1)[:, 0] < 0)] = 0
    climb(True)
    return field


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_lines: int = SAMPLE_LINES) -> Field:
    """The field, fitted on the driver to a bounded sample of labelled documents, whose lines executors describe.

    Documents are taken whole, in order of hash, as long as those before have fewer than ``sample_lines`` lines.
    """

    def run(batches):
        for batch in batches:
            done = 0
            for texts in batches_of(binaries(batch.column("text"))):
                c = Counts(texts)
                rows, part = line_features(c), batch.slice(done, len(texts))
                lines = [rows[a:b].astype("<f8").tobytes() for a, b in zip(c.first, c.first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(lines, pa.binary())], ["doc_id", "label", "lines"])
                done += len(texts)

    found = labelled(docs, labels, "quality", sample_rows).select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label double, lines binary")
    once = checkpointed(found.groupBy("doc_id").agg(F.min(F.struct("lines", "label")).alias("r")).select("doc_id", "r.*", F.xxhash64("doc_id").alias("h")))
    # At most sample_rows sizes, and of the documents' lines about sample_lines.
    sizes = once.orderBy("h", "doc_id").select("doc_id", (F.length("lines") / LINE_BYTES).cast("long").alias("n")).collect()
    before = np.cumsum([0, *(r["n"] for r in sizes)])
    chosen = [r["doc_id"] for r, n in zip(sizes, before, strict=False) if n < sample_lines]
    rows = once.filter(F.col("doc_id").isin(chosen)).orderBy("doc_id").select("lines", "label").collect() if chosen else []
    parts = [np.frombuffer(r["lines"], "<f8").reshape(-1, 12) for r in rows]
    lengths = [min(CHAIN, len(p) - a) for p in parts for a in range(0, len(p), CHAIN)]
    good = [r["label"] >= 0.5 for r, p in zip(rows, parts, strict=True) for _ in range(0, len(p), CHAIN)]
    return fit(np.concatenate([np.zeros((0, 12)), *parts]), np.array(lengths, int), np.array(good, bool))


def judge(docs: DataFrame, field: Field, share: float = CONTENT_SHARE) -> DataFrame:
    """The counts, base rules, content share and verdict of every row; a map without any shuffle."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]

    def run(batches):
        for batch in batches:
            done = 0
            for texts in batches_of(binaries(batch.column("text"))):
                c = Counts(texts)
                t = dict(zip(LINE_COUNTS, c.text.T, strict=True))
                content = field.viterbi(line_features(c), np.diff(c.first)) == 0
                words_at = np.concatenate([[0], np.cumsum(c.line[:, 0] * content)])
                held = (words_at[c.first[1:]] - words_at[c.first[:-1]]) / np.maximum(t["words"], 1)
                failed = (t["words"] < LEAST_WORDS) | (100 * t["repeats"] > MOST_REPEATED * t["words"])
                columns = [t["words"], t["chars"], t["symbols"], c.copies, t["repeats"], failed, ~failed & (held >= share), held]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(texts)), *map(pa.array, columns)], names)
                done += len(texts)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def line_rules(docs: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: its counts, base_failed, kept and content_share.

    A null text is empty and fails; null ids are judged too; repeated rows get the same verdict; without labels
    of both kinds every line is content; columns other than doc_id and text are not read.
    """
    return judge(docs, train(docs, labels, sample_rows), share)
