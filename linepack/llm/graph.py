"""Connected components of a link table by repeated local contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links`` that has a link to another node.

    Each round draws a random order of the nodes, lets every node join the first of its neighbourhood (itself
    included) and contracts the links to those representatives. The number of nodes with links falls by a constant
    factor a round in expectation, whatever the shape or the degree of the graph, so the rounds grow with the
    logarithm of the links. Aggregations have partial sums and joins can be split, so one node with very many links
    needs no single task. ``root`` is some node of the component, the same for all its nodes.

    Null ends and links from a node to itself are ignored; repeated links count once; an empty table gives no row.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    named = None
    for salt in range(200):
        if pairs.isEmpty():
            break
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(salt), c).alias("h"), c.alias("v"))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("m"))
        first = materialise(first.select("node", F.least(F.col("m"), rank(F.col("node")))["v"].alias("root")), "parents")
        if named is None:
            named = first
        else:
            nxt = first.select(F.col("node").alias("root"), F.col("root").alias("next"))
            named = materialise(named.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        of = lambda c: first.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        moved = pairs.join(of("a"), "a").join(of("b"), "b").where("a_root <> b_root")
        moved = moved.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        pairs = materialise(moved.distinct(), "links")
    else:
        raise RuntimeError("the links did not contract in 200 rounds")
    if named is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return named
