"""Checks inside the plans: a row that must not be there ends the job before anything is
written. A check is an expression over a column that the result needs, on rows that meet in
a join the plan has anyway, so sound input costs no scan and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.candidates import PAIR


def refused(value: Column, fault: Column) -> Column:
    """``value``; a row with a fault (a text) raises it."""
    return F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(value)


def pair_name() -> Column:
    return F.concat_ws("/", *PAIR)


def occurrences() -> Column:
    """Rows of a pair, as a window: it shares its partitioning with the join on the pair."""
    return F.count(F.lit(1)).over(Window.partitionBy(*PAIR))


def matched(features: DataFrame, predictions: DataFrame) -> DataFrame:
    """Features with their predictions where there are some. A prediction without a feature row
    and a pair that occurs twice on either side are errors."""
    both = features.withColumn("_rows", occurrences()).join(
        predictions.withColumn("_predictions", occurrences()), PAIR, "full_outer"
    )
    fault = (
        F.when(F.col("_rows").isNull(), F.concat(F.lit("no feature row for the prediction of "), pair_name()))
        .when(F.col("_rows") > 1, F.concat(F.lit("duplicate candidate "), pair_name()))
        .when(F.col("_predictions") > 1, F.concat(F.lit("duplicate prediction of "), pair_name()))
    )
    return both.withColumn("disease_id", refused(F.col("disease_id"), fault)).drop("_rows", "_predictions")


def joined_to_candidates(ranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Left join of published pairs with what generated them; a pair without it is an error."""
    both = ranked.join(candidates.withColumn("_candidate", F.lit(True)), PAIR, "left")
    fault = F.when(F.col("_candidate").isNull(), F.concat(F.lit("no candidate for ranked pair "), pair_name()))
    return both.withColumn("disease_id", refused(F.col("disease_id"), fault)).drop("_candidate")


def attached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges``; one whose end is no node of its graph is an error. Published graphs hold the
    top pairs of each disease only, so these joins are small."""
    known = nodes.select("graph_id", F.col("id").alias("_end"), F.lit(True).alias("_there"))
    for end in ("source", "target"):
        met = edges.withColumn("_end", F.col(end)).join(known, ["graph_id", "_end"], "left")
        fault = F.when(F.col("_there").isNull(), F.concat_ws(" ", F.lit(f"no {end} node of edge"), "id", F.lit("in"), "graph_id"))
        edges = met.withColumn("id", refused(F.col("id"), fault)).select(*edges.columns)
    return edges
