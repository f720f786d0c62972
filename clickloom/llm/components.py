"""Connected components of an edge table, by alternating stars.

Each round hooks every vertex's larger neighbours, then its smaller ones, to
the smallest vertex in reach, until only stars around each component's smallest
vertex are left.  Edges stay in Spark; a vertex with
very many edges is split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickloom.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v, distinct -> the same after one star step."""
    sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = sym.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("k"), F.least("u", "low").alias("m"))
    both = sym.join(low, F.col("u") == F.col("k"))
    if large:
        out = both.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``id, component`` (the smallest id reachable) for every id of a link
    but the components' own smallest ids."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")).distinct())
    while True:
        # done when every vertex hangs on one vertex that hangs on none
        n = edges.agg(F.count("*").alias("n"), F.count_distinct("u").alias("u")).first()
        roots = edges.select("v").join(edges.select(F.col("u").alias("k")), F.col("v") == F.col("k"), "left_semi")
        if not n["n"] or (n["n"] == n["u"] and roots.isEmpty()):
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        edges = materialize(_star(_star(edges, large=True), large=False))
