"""Chat rendering by perspective rotation: every participant in turn is the assistant.

For each participant of a conversation the whole dialogue is rendered with that participant's turns as
assistant turns and everybody else's as named user turns; masks mark the characters that a model should learn.
Conversations are rendered in parts of ``PART_TURNS`` turn numbers, so one endless conversation is many rows in
many tasks, and a part that repeats turn numbers over and over is divided by rank once more, in dialogue order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

PART_TURNS = 64
#: Turns of one part that are rendered as one row at most, and bytes of texts but for the last.
MAX_ROWS, MAX_BYTES = 4096, 64 << 20
#: Characters of a text that ranges of a crowded part are cut by; a sample of such keys reaches the driver.
KEY_CHARS = 1000
#: Roles that speak from outside: rendered under their own role for all, never the assistant.
NARRATORS = ("system",)
NO_NAME = "unknown"


def plain(text: Column) -> Column:
    """A text in which nothing can pass for a mark: ``<|`` becomes ``< |``."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _segment(turn: Column, speaker: Column, narrators: tuple[str, ...]) -> Column:
    learnt = turn["role"] == speaker
    name = F.translate(plain(turn["role"]), "\r\n", "  ")
    head = F.when(learnt, F.lit("<|im_start|>assistant\n")).when(turn["role"].isin(*narrators), F.concat(F.lit("<|im_start|>"), name, F.lit("\n")))
    head = head.otherwise(F.concat(F.lit("<|im_start|>user name="), name, F.lit("\n")))
    body = F.concat(plain(turn["text"]), F.lit("<|im_end|>\n"))
    return F.struct(F.concat(head, body).alias("text"), learnt.alias("learnt"), F.length(head).cast("long").alias("head"), F.length(F.concat(head, body)).cast("long").alias("size"))


def _divided(turns: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """``turns`` with ``sub``: each (conv_id, part) in pieces of ``max_bytes``, in order of turn, role and text, where a turn counts as 1 / max_rows of that at least.

    Rows of crowded parts are cut into ranges of that order and summed within a range, after the sums of the
    ranges before it; so no part meets in a single task, and subs don't depend on where ranges were cut.
    """
    weighed = turns.withColumn("weight", F.greatest(F.octet_length("text").cast("long"), F.lit(-(-max_bytes // max_rows))))
    crowded = checkpointed(weighed.groupBy("conv_id", "part").agg(F.sum("weight").alias("all")).filter(F.col("all") > max_bytes).select(F.col("conv_id").alias("c"), F.col("part").alias("p")))
    if crowded.isEmpty():
        return turns.withColumn("sub", F.lit(0))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    ranged = weighed.join(crowded, same, "left_semi").repartitionByRange("conv_id", "part", "turn", "role", F.substring("text", 1, KEY_CHARS))
    ranged = checkpointed(ranged.withColumn("range", F.spark_partition_id()))
    ahead = Window.partitionBy("conv_id", "part", "range").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id", "part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("conv_id", "part", "range").agg(F.sum("weight").alias("all")).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("range").alias("r"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("before"))
    placed = ranged.withColumn("n", F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
    placed = placed.join(sums, same & (F.col("range") == F.col("r"))).withColumn("sub", F.floor((F.col("before") + F.col("n")) / max_bytes).cast("int"))
    return turns.join(crowded, same, "left_anti").withColumn("sub", F.lit(0)).unionByName(placed.select(*turns.columns, "sub"))


def rotate(conversations: DataFrame, narrators: tuple[str, ...] = NARRATORS, part_turns: int = PART_TURNS, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per (conv_id, speaker, part, sub): n_turns, text, mask_starts, mask_ends.

    A whole dialogue of a speaker is its rows' texts end to end in order of (part, sub). In texts and role names
    ``<|`` becomes ``< |``, and line ends in role names become spaces, so no text can open a turn of its own.
    A mask runs over an assistant turn's text and its end mark, in characters of the row's text. Turns follow by
    turn, then role, then text. Rows that repeat conv_id, turn, role and text count once. A null text is empty, a
    null or empty role is a participant called "unknown", null turns come first, and a null conv_id is a
    conversation of its own. A conversation of narrators alone has no participant and gives no row. Other columns
    are not read.
    """
    role = F.when(F.trim(F.coalesce("role", F.lit(""))) == "", F.lit(NO_NAME)).otherwise(F.col("role"))
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    turns = turns.withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long"))
    speakers = turns.filter(~F.col("role").isin(*narrators)).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    turns = _divided(turns, max_rows, max_bytes)
    parts = turns.groupBy("conv_id", "part", "sub").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    seen = seen.withColumn("seg", F.transform("turns", lambda t: _segment(t, F.col("speaker"), narrators)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"), F.array().cast("array<bigint>").alias("ends"))

    def step(acc: Column, s: Column) -> Column:
        more = lambda name, at: F.when(s["learnt"], F.concat(acc[name], F.array(at))).otherwise(acc[name])
        return F.struct((acc["at"] + s["size"]).alias("at"), more("starts", acc["at"] + s["head"]).alias("starts"), more("ends", acc["at"] + s["size"] - 1).alias("ends"))

    seen = seen.withColumn("masks", F.aggregate("seg", start, step))
    return seen.select(
        "conv_id", "speaker", "part", "sub", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("seg.text"), "").alias("text"), F.col("masks.starts").alias("mask_starts"), F.col("masks.ends").alias("mask_ends")
    )
