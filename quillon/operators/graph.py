"""Connected components by alternating large-star and small-star rounds.

Every round is a few grouped minima and equi-joins over the edge table, so a hub with
very many neighbours is pre-aggregated before the shuffle and its join can be split by
adaptive execution. Edges are written to the shared folder after each round, which cuts
the lineage and survives lost executors; only one answer reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillon.session import store


def _star_round(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    down = large.where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(least, "a").select("b", "m").where("b <> m").toDF("a", "b")
    return small.union(least.select("a", F.col("m").alias("b"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every edge (a, b) leads from a node with no other edge down to one that leads nowhere."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
    return odd.isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; a component is its least node.

    Self-loops count as nodes of their own; null ends are ignored; an empty edge table
    gives an empty result. Ends may be integers, strings or structs. Rounds end when the edges
    are stars, which needs no further round to be seen.
    """
    edges = edges.toDF("a", "b").where("a is not null and b is not null")
    held = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    loops = held.df.where("a = b").select(F.col("a").alias("node"))
    work, previous = held.df.where("a <> b"), None
    for _ in range(max_rounds):
        if _stars(work):
            break
        nxt = store(_star_round(work))
        if previous is not None:
            previous.drop()
        previous, work = nxt, nxt.df
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    pairs = work.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = work.select(F.col("b").alias("node"), F.col("b").alias("component"))
    alone = loops.select("node", F.col("node").alias("component"))
    return pairs.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))
