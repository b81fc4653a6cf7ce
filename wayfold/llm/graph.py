"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, stage, with_facts

#: A graph of 2**60 nodes is done long before; more rounds mean that something is wrong.
MOST_ROUNDS = 200


def _least(edges: DataFrame, key: str, value: str, most: float) -> DataFrame:
    """``edges`` with ``m``, the least ``value`` of their ``key``; hubs' edges stay where they are."""
    facts = stage(edges.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("n")), "star-least")
    return with_facts(edges, facts, key, F.col("n") > most).drop("n")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); a label is the least node of its component.

    Each round joins the edges to the least neighbour of each node, so no task holds a node's whole
    neighbourhood, hubs' included; rounds go on until the edges no longer change, which is one star a
    component. Null ends, loops and repeated edges are ignored.
    """
    now, mark = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star"), None
    for _ in range(MOST_ROUNDS):
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if seen == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
        mark, most = seen, HOT_SHARE * seen[0]
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = stage(_least(both, "u", "v", most).where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct(), "star-large")
        small = _least(large, "a", "b", most).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = stage(small, "star")
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
