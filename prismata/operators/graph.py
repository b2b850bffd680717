"""Connected components of an edge table, by repeated contraction.

In each round every node picks the neighbour (or itself) of least hashed rank, edges are carried
over to the picked nodes, and edges inside one node vanish. Ranks are hashed anew in each round, so
that a chain shrinks by a constant factor whatever its ids. Each round is written to the shared
folder; nothing but a row count reaches the driver, and no node's neighbours are gathered:
the pick is an aggregate that combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(edges: DataFrame) -> DataFrame:
    """node, root of each node with an edge (a bigint, b bigint). Nodes of one component share a root,
    which is one of them. Edges may repeat, stand in either direction, or lead from a node to itself."""
    edges = written(edges.select("a", "b").where("a is not null and b is not null and a != b").distinct(), "edges")
    maps, left, turn = [], edges.count(), 0
    while left:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        picked = both.groupBy("a").agg(F.min(ranked("b")).alias("low")).select(F.col("a").alias("node"), F.least("low", ranked("a"))["id"].alias("root"))
        picked = written(picked, "picked")
        maps.append(picked)
        at = edges.join(picked.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(picked.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = written(at.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        left, turn = edges.count(), turn + 1
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps.pop()
    while maps:
        last = maps.pop()
        out = last.join(out.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", "left").select("node", F.coalesce("over", "root").alias("root"))
    return out


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, cluster_id of every row of nodes (node): the smallest node of its component, itself where it has no edge.
    edges: src, dst, whose nodes may be of any type that can be ordered."""
    roots = written(components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))), "roots")
    # Written first: a join with an aggregate of its own stage can't be split where many nodes share a root.
    least = written(roots.groupBy("root").agg(F.min("node").alias("cluster_id")), "least")
    named = written(roots.join(least, "root").select("node", "cluster_id"), "named")
    return nodes.select("node").distinct().join(named, "node", "left").select("node", F.coalesce("cluster_id", "node").alias("cluster_id"))


def representatives(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, representative: greedy clustering of nodes (node, turn: unique, smallest first) by edges (src, dst). In the order of turn,
    a node without an edge to an earlier representative becomes one, and stands for itself; others go to the
    earliest that they have an edge to.

    Nodes are decided in rounds: one whose earlier neighbours are all decided against is a representative, and its later
    neighbours are not. Each round decides at least the earliest open node of each component.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a != b")
    both = both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    turns = nodes.select("node", "turn")
    first, second = (turns.select(F.col("node").alias(n), F.col("turn").alias(f"{n}_turn")) for n in "ab")
    ahead = written(both.join(first, "a").join(second, "b").where("a_turn < b_turn"), "ahead")  # a comes before b
    open_, chosen = ahead, None
    while not open_.isEmpty():
        # Open nodes with an edge but no earlier open neighbour.
        new = written(open_.select(F.col("a").alias("node")).distinct().join(open_.select(F.col("b").alias("node")).distinct(), "node", "left_anti"), "chosen")
        chosen = new if chosen is None else chosen.unionAll(new)
        out = written(open_.join(new.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct(), "decided")
        gone = new.unionAll(out)
        # What hung on nodes that are decided against is free again, so edges go with either end.
        open_ = written(open_.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"), "open")
    if chosen is None:
        return nodes.select("node", F.col("node").alias("representative"))
    # Nodes that lost all their edges without being decided are representatives too: they have no earlier one.
    taken = written(ahead.join(chosen.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct(), "taken")
    stand = nodes.select("node").join(taken, "node", "left_anti")
    late = ahead.join(stand.withColumnRenamed("node", "a"), "a", "left_semi").groupBy("b").agg(F.min(F.struct("a_turn", "a")).alias("w")).select(F.col("b").alias("node"), F.col("w.a").alias("rep"))
    return nodes.select("node").join(late, "node", "left").select("node", F.coalesce("rep", "node").alias("representative"))
