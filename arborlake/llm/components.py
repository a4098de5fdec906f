"""Connected components of a large set of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborlake.session import materialise


def _order(node: Column, turn: int) -> Column:
    return F.struct(F.xxhash64(node, F.lit(turn)).alias("rank"), node.alias("node"))


def components(links: DataFrame, max_turns: int = 64) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``); a component is its least node.

    In each turn every node joins the neighbour of lowest rank, itself included, and links are
    rewritten to the joined nodes. Ranks are drawn anew in each turn, so the number of links falls
    by a constant factor whatever the order of identifiers. All tables are written, nothing is
    collected, and minima are combined before they are shuffled.
    """
    both = links.filter("a <> b").select("a", "b").distinct()
    left = materialise(both, "links")
    nodes = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
    place = materialise(nodes.withColumn("at", F.col("node")), "places")
    for turn in range(max_turns):
        if left.isEmpty():
            break
        ends = left.select("a", "b").union(left.select(F.col("b"), F.col("a")))
        nearest = ends.groupBy("a").agg(F.min(_order(F.col("b"), turn)).alias("low")).select(
            F.col("a").alias("_v"), F.least(F.col("low"), _order(F.col("a"), turn))["node"].alias("_to"))
        nearest = materialise(nearest, "nearest")
        place = materialise(
            place.join(nearest, place["at"] == nearest["_v"], "left")
            .select("node", F.coalesce("_to", "at").alias("at")), "places")
        first = nearest.select(F.col("_v").alias("a"), F.col("_to").alias("_a"))
        second = nearest.select(F.col("_v").alias("b"), F.col("_to").alias("_b"))
        left = materialise(
            left.join(first, "a").join(second, "b").filter("_a <> _b")
            .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_turns} turns")
    least = place.groupBy("at").agg(F.min("node").alias("component"))
    return materialise(place.join(least, "at").select("node", "component"), "components")
