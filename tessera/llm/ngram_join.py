"""N-gram Jaccard join: prefix filtering with documents of identical prefix and size joined as one group.

A document's shingles are put in one global order, rare ones first, and two documents that link share a shingle
within their prefixes. The order comes from a sketch of all documents' shingles, whose estimates go back to the
documents by group: shingles met once fill most prefixes and can't match anything, and how often the others were met
is known by powers of two. Any order gives the same links, a good one few candidates.

Documents with equal shingle sets become one node, nodes with equal prefix and size one group. Each group is
tried with the group, among the first of its posting lists, that it shares most with; members are verified exactly
and linked nodes joined into components. Then what is left are pairs of groups of different components: these are
filtered as groups, in full, then expanded into members and verified too. So a list with very many alike is never
expanded into all pairs, and no link between components is lost.

Of two sets that link, at least one has their first common shingle early, within the shorter prefix that its equals in
size would need; so a shingle that all its documents have late joins none of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, maybe_listed, release, total_bytes
from .components import components
from .sketch import PARTS, Sketch
from .words import Words, batches_of, binaries, mix, runs

SHINGLE, PERCENT = 5, 80
#: Cells of the sketch for each byte of text: some two for each shingle. Counts are told apart up to 2**STEPS.
CELLS, STEPS = 1 / 3, 20
#: Bytes of text for each group of documents that meets for the sketch.
GROUP_BYTES = 4 << 20


class Sets:
    """The distinct shingle hashes, ascending, of each text of a batch."""

    def __init__(self, texts: list[bytes], size: int):
        w = Words(texts, lower=True)
        hashes = w.hashes()
        full = runs(hashes, size)
        self.sets = []
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= size:
                self.sets.append(np.unique(full[a : b - size + 1]))
            elif b > a:
                self.sets.append(mix(runs(hashes[a:b], b - a) + np.uint64(b - a)))
            else:
                self.sets.append(np.zeros(0, np.uint64))


def sets_of_column(column: pa.ChunkedArray, size: int) -> list[np.ndarray]:
    return [s for some in batches_of(column.cast(pa.binary()).to_pylist()) for s in Sets(some, size).sets]


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of n of which any linked set has at least one, in every order."""
    return n - -(-percent * n // 100) + 1


DESCRIBED = "doc_id long, n long, high long, low long, prefix long, tokens array<long>, places array<int>"


def describe(rows: DataFrame, size: int, percent: int, sketch: Sketch) -> DataFrame:
    """Each row's set size, 128 bits of its set, a hash of its prefix, and the prefix's shingles that may match others."""

    def counted(table: pa.Table) -> pa.Table:
        sets = sets_of_column(table.column("text"), size)
        out = sketch.parts(np.concatenate([np.zeros(0, np.uint64), *sets]), table.column("group")[0].as_py())
        release()
        return out

    def described(owned: pa.Table, told: pa.Table) -> pa.Table:
        sets = sets_of_column(owned.column("text"), size)
        levels = sketch.estimates(told, np.concatenate([np.zeros(0, np.uint64), *sets]))
        n, high, low, head, tokens, places, done = [], [], [], [], [], [], 0
        for s in sets:
            level = levels[done : done + len(s)]
            done += len(s)
            order = np.lexsort((s, level))[: prefix_length(len(s), percent)] if len(s) else np.zeros(0, int)
            at = np.flatnonzero(level[order])
            first = s[order]
            n.append(len(s))
            high.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(0x5851F42D)))))
            low.append(int(np.add.reduce(mix(s ^ np.uint64(0x14057B7EF767814F)))))
            head.append(int(np.add.reduce(mix(first + np.uint64(0x2127599B)))))
            tokens.append(first[at].view(np.int64))
            places.append(at.astype(np.int32))
        whole = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
        columns = [owned.column("doc_id"), pa.array(n, pa.int64()), whole(high), whole(low), whole(head), pa.array(tokens, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))]
        release()
        return pa.Table.from_arrays(columns, ["doc_id", "n", "high", "low", "prefix", "tokens", "places"])

    by_group = rows.groupBy("group")
    told = sketch.answers(by_group.applyInArrow(counted, PARTS))
    return by_group.cogroup(told.groupBy("group")).applyInArrow(described, DESCRIBED)


def near_enough(percent: int, a: str = "a", b: str = "b") -> Column:
    """Sizes that may link, and room after the places of a first common shingle for the overlap that a link needs."""
    na, nb, pa_, pb = (F.col(f"{s}.{c}") for c in ("n", "place") for s in (a, b))
    least = F.ceil(percent * (na + nb) / (100 + percent))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(na - pa_, nb - pb) >= least)


def is_early(percent: int) -> Column:
    """Whether a set has room after this place for the overlap with a set of its own size: of two late ones neither has."""
    return (F.col("n") - F.col("place")) * (100 + percent) >= 2 * percent * F.col("n")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity: their intersections are counted in full."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"{s}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_set"), batch.column("b_set"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
            release()

    return both.mapInArrow(run, "a long, b long")


def sets_of(rows: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the nodes that pairs name. A bitmap tells most others apart before their texts are shuffled."""
    wanted = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())

    def run(batches):
        for batch in batches:
            done = 0
            for texts in batches_of(binaries(batch.column("text"))):
                found = [s.astype("<u8").tobytes() for s in Sets(texts, size).sets]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(done, len(texts)), pa.array(found, pa.binary())], ["node", "shingles"])
                done += len(texts)

    likely = maybe_listed(rows, "doc_id", wanted).filter("__maybe and doc_id is not null").select(F.col("doc_id").alias("node"), "text")
    return checkpointed(likely.join(wanted, "node", "left_semi").mapInArrow(run, "node long, shingles binary"))


def counts_alone(batches, size: int):
    for batch in batches:
        done = 0
        for texts in batches_of(binaries(batch.column("text"))):
            found = [len(s) for s in Sets(texts, size).sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(texts)), pa.array(found, pa.int64())], ["doc_id", "n_shingles"])
            done += len(texts)


def ngram_join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents link when their sets of ``size``-word shingles, A-Z lower-cased, have a Jaccard similarity of
    ``percent`` or more; component_id is the smallest doc_id reachable by links, the document's own included. A
    document of fewer words has its whole sequence as its one shingle; one without words or text has none and
    links with nothing. Rows without doc_id link with nothing and have no component. Rows that repeat a doc_id
    are one document, which has the links of all its texts. Columns other than doc_id and text are not read.
    """
    own_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(own_id.alias("doc_id"), text.alias("text"))
    volume = total_bytes(docs, "text")
    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-volume // GROUP_BYTES)))).cast("int")
    named = rows.filter("doc_id is not null and text is not null").select(group.alias("group"), "doc_id", "text")
    described = checkpointed(describe(named, size, percent, Sketch.of(CELLS * volume, 1, STEPS)))
    linkable = "n > 0"
    same = described.filter(linkable).groupBy("n", "high", "low")
    nodes = checkpointed(same.agg(F.min("doc_id").alias("node"), F.min("prefix").alias("prefix"), F.min_by(F.arrays_zip("tokens", "places"), "doc_id").alias("head")))
    # Nodes of one size and prefix are a group, named by its least node.
    groups = nodes.filter(F.size("head") > 0).groupBy("n", "prefix").agg(F.min("node").alias("group"), F.min_by("head", "node").alias("head"))
    postings = groups.select("group", "n", F.explode("head").alias("h")).select("group", "n", F.col("h.tokens").alias("token"), F.col("h.places").alias("place")).withColumn("early", is_early(percent))
    first = F.min(F.when(F.col("early"), F.struct("group", "n", "place")))
    lists = postings.groupBy("token").agg(F.count("*").alias("many"), first.alias("first")).filter("many > 1 and first is not null")
    members = nodes.join(groups.select("n", "prefix", "group"), ["n", "prefix"]).select("node", "group")
    within = members.filter("node <> group").select(F.col("group").alias("a"), F.col("node").alias("b"))
    met = postings.alias("b").join(lists.select("token", "first.*").alias("a"), F.col("a.token") == F.col("b.token"))
    across = met.filter((F.col("a.group") != F.col("b.group")) & near_enough(percent)).groupBy(F.col("a.group").alias("a"), F.col("b.group").alias("b")).count()
    # Of the first groups that a group meets, the one it shares most with; the others get their turn below.
    likeliest = across.groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a"))
    likeliest = likeliest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = checkpointed(within.union(likeliest).distinct())
    edges = checkpointed(verified(tried, sets_of(rows, tried, size), percent))
    linked = components(edges)
    # What is left: groups with members of different components, alone or with groups that share a shingle early in a prefix.
    placed = checkpointed(members.join(linked, "node", "left").select("node", "group", F.coalesce("component", "node").alias("component")))
    of_group = placed.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    entries = postings.join(lists.select("token"), "token", "left_semi").join(of_group, "group")
    spread = entries.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("token")
    entries = checkpointed(entries.join(spread, "token", "left_semi").select("token", "group", "n", "place", "early", "lo", "hi"))
    once = ~F.col("b.early") | (F.col("a.group") < F.col("b.group"))
    apart = F.least("a.lo", "b.lo") != F.greatest("a.hi", "b.hi")
    met = entries.filter("early").alias("a").join(entries.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.group") != F.col("b.group")) & once & apart & near_enough(percent))
    group_pairs = met.select(F.least("a.group", "b.group").alias("x"), F.greatest("a.group", "b.group").alias("y")).distinct()
    group_pairs = group_pairs.union(of_group.filter("lo <> hi").select(F.col("group").alias("x"), F.col("group").alias("y")))
    side = lambda g, s: placed.select(F.col("group").alias(g), F.col("node").alias(s), F.col("component").alias(f"of_{s}"))
    expanded = group_pairs.join(side("x", "p"), "x").join(side("y", "q"), "y").filter("of_p <> of_q and (x <> y or p < q)")
    rest = expanded.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    rest = checkpointed(rest.join(tried, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = checkpointed(verified(rest, sets_of(rows, rest, size), percent))
        if not more.isEmpty():
            linked = components(edges.union(more))
    ids = nodes.join(linked, "node", "left").select("n", "high", "low", F.coalesce("component", "node").alias("component"))
    joined = described.filter(linkable).select("doc_id", "n", "high", "low").join(ids.hint("merge"), ["n", "high", "low"], "left")
    alone = described.filter(f"not ({linkable})").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    # Rows without id or text may be very many alike, and meet nowhere.
    unnamed = rows.filter("doc_id is null or text is null").mapInArrow(lambda batches: counts_alone(batches, size), "doc_id long, n_shingles long")
    alone = alone.union(unnamed.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")).union(alone)
