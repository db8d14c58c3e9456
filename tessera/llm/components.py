"""Connected components of an undirected graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.workspace import Workspace


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, comp): each node of an edge (a, b) with the smallest node it reaches.

    Neighbours are tied to the smallest neighbour, first those above a node, then those
    below, until nothing changes. A node of any degree costs one row per neighbour; its
    smallest neighbour is found by a partial aggregate, and the join that hands it to the
    neighbours can be split, so no task gathers a star. Each half of a round is written, so
    its plan stays as small as the first one's; whether it changed comes with the write.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars, before = _written(edges, ws)
    while before[0]:
        # a node's smaller neighbours are the v of its edges, its larger ones have it as their v
        met = _handed(stars, _lowest(stars), "v", "left")
        large, _ = _written(met.select("u", F.coalesce("m", "v").alias("v")), ws)
        least = _lowest(large)
        rest = _handed(large, least, "u", "inner").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars, after = _written(rest.union(least.select("u", F.col("m").alias("v"))), ws)
        if after == before:
            break
        before = after
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.union(stars.select("v", "v")).distinct()


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest v of every u. Grouped by a struct, so that the minima are dealt anew
    for a join and a hot node can be split there."""
    return edges.groupBy(F.struct("u").alias("_of")).agg(F.min("v").alias("m")).select("_of.u", "m")


def _handed(edges: DataFrame, least: DataFrame, end: str, how: str) -> DataFrame:
    """(u, v, m): every edge with the smallest neighbour of its ``end``."""
    return edges.join(least.withColumnRenamed("u", end).hint("merge"), end, how)


def _written(edges: DataFrame, ws: Workspace) -> tuple[DataFrame, tuple]:
    """Distinct edges between different nodes, and their count and two order-free digests."""
    seen = Observation()
    digests: list[Column] = [
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s"),
    ]
    stored = ws.store("edges", edges.filter("u <> v").distinct().observe(seen, *digests))
    return stored, tuple(seen.get[c] for c in "nxs")
