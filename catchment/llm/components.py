"""Connected components by alternating star contraction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is its smallest node.

    Each round points every node's larger neighbours at its smallest one (large star), then all
    its smaller neighbours and itself (small star); the edges end as one star per component after a
    number of rounds that grows with the logarithm of the component's size. Nothing is gathered on the driver but
    two sums per round. Nodes of very many edges are joined by broadcast (see join_groups). Self
    loops give a component of one node; no edges give no rows; repeated edges count once.
    """
    loops = edges.filter("a = b").select(F.col("a").alias("node")).distinct()
    now = staged(_oriented(edges))
    mark = _mark(now)
    while mark[0]:
        now = staged(_star(now, large=True))
        now = staged(_star(now, large=False))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    known = nodes.unionByName(roots)
    alone = loops.join(known, "node", "left_anti").select("node", F.col("node").alias("component"))
    return known.unionByName(alone)


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller node."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = staged(seen.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("size")).withColumn("least", F.least("a", "least")))
    total = least.agg(F.sum("size")).first()[0] or 0
    met = join_groups(seen, least, "a", "size", total)
    if large:
        new = met.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        new = met.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return _oriented(new)
