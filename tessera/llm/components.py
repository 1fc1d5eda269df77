"""Connected components of an edge table by rounds of contraction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, saved, shared_folder


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b longs): component is its smallest reachable node.

    Each round points every node at its least neighbour, if that is smaller, follows those pointers a few steps,
    and replaces the ends of all edges by what they point at; edges within one node go. At least every node but
    the local minima moves in a round, so rounds grow with the logarithm of the nodes. Minima are combined before
    shuffles, so a node with very many edges is no burden. Null ends are left out; loops and repeats count once.
    """
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    left, left_at = saved(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna().distinct(), folder)
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    places, places_at = saved(nodes.select("node", F.col("node").alias("component")), folder)
    left = left.filter("a <> b")
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).union(left.select("b", "a"))
        point, point_at = saved(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("to")), folder)
        jumped = point
        for _ in range(jumps):
            further = point.select(F.col("node").alias("mid"), F.col("to").alias("next"))
            jumped = jumped.join(further, F.col("to") == F.col("mid"), "left").select("node", F.coalesce("next", "to").alias("to"))
        jumped, jumped_at = saved(jumped, folder)
        ends = lambda side: jumped.select(F.col("node").alias(side), F.col("to").alias(f"{side}_to"))  # noqa: E731, B023
        gone = [left_at, places_at, point_at, jumped_at]
        left, left_at = saved(left.join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).filter("a <> b").distinct(), folder)
        places, places_at = saved(places.join(ends("component"), "component", "left").select("node", F.coalesce("component_to", "component").alias("component")), folder)
        delete(spark, *gone)
    delete(spark, left_at)
    return places
