"""Ranking per disease, top-N, guards and the flat table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.constants import RANKING_VERSION
from tessera.operators.candidates import PAIR
from tessera.operators.ordering import number_rows, top_per_group
from tessera.workspace import Workspace


def _order():
    return [F.col("repurposing_score").desc(), F.col("drug_id").asc()]


def rank(fused: DataFrame, ws: Workspace, name: str = "rank") -> DataFrame:
    """Unique ranks 1..N per disease: score desc, drug id asc. All pairs are ranked;
    a disease with many pairs is spread over many tasks."""
    ranked = number_rows(fused, _order(), ws, name, group=["disease_id"], out="rank")
    return ranked.withColumn("rank", F.col("rank").cast("int"))


def checked_top_n(top_n: int) -> int:
    if isinstance(top_n, bool) or not isinstance(top_n, int) or top_n < 1:
        raise ValueError(f"top_n must be a positive int, got {top_n!r}")
    return top_n


def top_n(fused: DataFrame, n: int) -> DataFrame:
    """The first ``n`` per disease without ranking the rest."""
    return top_per_group(fused, ["disease_id"], _order(), checked_top_n(n), out="rank")


def duplicate_pairs(fused: DataFrame) -> DataFrame:
    return fused.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def ranking_table(ranked: DataFrame) -> DataFrame:
    methods = F.concat_ws(
        ",",
        F.when(F.col("generated_by_gene_target"), "gene_target"),
        F.when(F.col("generated_by_pathway"), "pathway"),
    )
    return ranked.select(
        "rank",
        *PAIR,
        "drug_name",
        "repurposing_score",
        "gene_target_value",
        "gene_target_points",
        "pathway_value",
        "pathway_points",
        "ml_value",
        "ml_points",
        methods.alias("generation_methods"),
    )


def run_provenance(fused: DataFrame, requested: int | None = None) -> DataFrame:
    """Per disease: rows in, rows ranked, applied N, and the scoring version if it is the same everywhere."""
    if requested is not None:
        checked_top_n(requested)
    n = F.count(F.lit(1))
    applied = F.least(F.lit(requested).cast("long"), n) if requested else F.lit(None).cast("long")
    return fused.groupBy("disease_id").agg(
        n.alias("n_input"),
        (applied if requested else n).alias("n_ranked"),
        F.lit(requested).cast("long").alias("top_n_requested"),
        applied.alias("top_n_applied"),
        F.when(F.count_distinct("scoring_version") == 1, F.min("scoring_version")).alias("scoring_version"),
        F.lit(RANKING_VERSION).alias("ranking_version"),
    )
