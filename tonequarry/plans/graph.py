"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import narrow, written


def _rewired(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u > v): to each node's least neighbour go its larger neighbours, or its smaller ones.

    The least neighbour is a pre-aggregated minimum; a node of very many edges is a hot key of the join
    alone, whose many rows stand on the side that can be split.
    """
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = written(narrow(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), F.least("x", "m").alias("m"))), "least")
    wired = both.join(least, F.col("x") == F.col("k"))
    if large:
        out = wired.where(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        out = wired.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return narrow(out.where(F.col("u") > F.col("v")).distinct())


def _only_stars(edges: DataFrame) -> bool:
    """Whether each larger end has one edge and is no smaller end."""
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by = ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not by.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).limit(1).count()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """(node, component) for the nodes of at least one edge between different nodes; component: the least node reached.

    Large and small stars alternate until the edges are stars, which lie around the least nodes. Rounds grow
    with the logarithm of the longest path. Each is written to the shared work folder, so lineage stays
    short and a lost executor costs no earlier round. Null ends and loops are no edges; repeated edges
    count once.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct()
    now = written(narrow(now), "edges")
    for _ in range(rounds):
        if _only_stars(now):
            break
        now = written(_rewired(written(_rewired(now, True), "large"), False), "small")
    else:
        raise RuntimeError(f"no stars after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
