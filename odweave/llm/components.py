"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """Per node of the edges (a, b), whole numbers: node, component (the smallest node reachable).

    In each round every node points at its first neighbour (or itself) in an order drawn by hashing, pointers replace the nodes in
    the edges, and the rest goes on; about half of the nodes or more vanish each time. Nothing but the counts of edges comes to
    the driver. Rounds are stored tables, so a lost executor costs a re-read. Edges from a node to itself and repeated edges are
    allowed; an empty table gives no rows.
    """
    rest = materialize(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).filter("a <> b").distinct())
    pointers: list[DataFrame] = []
    while not rest.isEmpty():
        round_no = len(pointers)
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(round_no)).alias("h"), F.col("b").alias("to"))).alias("f"))
        own = F.struct(F.xxhash64("a", F.lit(round_no)).alias("h"), F.col("a").alias("to"))
        pointer = materialize(first.select(F.col("a").alias("node"), F.least("f", own)["to"].alias("to")))
        pointers.append(pointer)
        at_a, at_b = (pointer.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to")) for x in ("a", "b"))
        moved = rest.join(at_a, "a").join(at_b, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        rest = materialize(moved.filter("a <> b").distinct())
    if not pointers:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = pointers[-1].select("node", F.col("to").alias("root"))
    for pointer in reversed(pointers[:-1]):
        onward = roots.select(F.col("node").alias("to"), "root")
        roots = pointer.join(onward, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    roots = materialize(roots)
    smallest = materialize(roots.groupBy("root").agg(F.min("node").alias("component")))  # so that a huge component can be split
    return roots.join(smallest, "root").select("node", "component")
