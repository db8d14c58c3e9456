"""Weighted fusion of the three evidence families into a 0-100 score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.constants import DEFAULT_SCHEME, SCORING_VERSION
from tessera.functions.numbers import blend, clip01, saturate, tidy
from tessera.operators.candidates import PAIR
from tessera.operators.guards import matched

_LABELS = {"gene_target": "gene_target", "pathway": "pathway", "ml": "ml"}


def valid_schemes(schemes: DataFrame) -> DataFrame:
    """Positive finite weights, caps of at least one, shares in [0,1] that sum to one."""
    finite = [f"{w} > 0 and {w} < double('inf') and not isnan({w})" for w in ("gene_target_weight", "pathway_weight", "ml_weight")]
    caps = ["gene_target_cap >= 1", "pathway_cap >= 1"]
    shares = [
        "count_share between 0 and 1",
        "specificity_share between 0 and 1",
        "abs(count_share + specificity_share - 1) <= 1e-9",
    ]
    return schemes.filter(" and ".join(finite + caps + shares))


SCHEME_PARTS = 64


def with_scheme(rows: DataFrame, scheme: dict | None = None, schemes: DataFrame | None = None) -> DataFrame:
    """Attach one scheme as constants, or every valid scheme of a table.

    Every row meets every scheme. Rows are dealt over ``SCHEME_PARTS`` parts and each part gets
    a copy of the schemes, so they meet by an equi-join: Spark broadcasts the copies
    when they are small, and else no task holds more than the schemes and a part of the rows."""
    if schemes is None:
        s = {**DEFAULT_SCHEME, **(scheme or {})}
        return rows.withColumns({"scheme": F.lit("default"), **{k: F.lit(v) for k, v in s.items()}})
    copies = valid_schemes(schemes).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SCHEME_PARTS - 1))))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*PAIR), F.lit(SCHEME_PARTS)).cast("int"))
    return dealt.join(copies, "_part").select(*rows.columns, *schemes.columns)


# fixed values: where each component comes from, and how its value is worked out
GENE_FAMILY = "Level 4 gene-target route (HGNC id join) + Level 5 overlap features"
PATHWAY_FAMILY = (
    "Level 2 disease pathways (derived:opentargets+reactome) ∩ Level 3 drug "
    "pathways (derived:chembl-targets+reactome) — direct Reactome id intersection"
)
MODEL_FAMILY = "Level 6 ML prediction (GroupKFold-validated classifier over Level 5 features)"
FAMILIES = {"gene_target": GENE_FAMILY, "pathway": PATHWAY_FAMILY, "ml": MODEL_FAMILY}
MODEL_METHOD = "value = PredictionResult.model_output (already a [0,1] model output)"


def calculation_method(name: str) -> Column:
    """The formula of a component under the row's scheme."""
    if name == "ml":
        return F.lit(MODEL_METHOD)
    part = "targets" if name == "gene_target" else "pathways"
    whole = "disease_genes" if name == "gene_target" else "disease_pathways"
    count, cap = f"matched_{name}_count", F.col(f"{name}_cap").cast("string")
    return F.concat(
        F.lit("value = "), F.col("count_share").cast("double").cast("string"), F.lit(f"*min({count}, "), cap, F.lit(")/"), cap,
        F.lit(" + "), F.col("specificity_share").cast("double").cast("string"),
        F.lit(f"*fraction_of_drug_{part}_matching_{whole}"),
    )


# --- components ----------------------------------------------------------------------
def _gene_reason() -> Column:
    return (
        F.when(~F.col("has_gene_target_bridge"), "HGNC bridge unavailable")
        .when(F.col("drug_target_hgnc_mapped_count") < 1, "drug has no HGNC-mapped target")
        .when(F.col("disease_gene_hgnc_mapped_count") < 1, "disease has no HGNC-mapped gene")
    )


def _pathway_reason() -> Column:
    return (
        F.when(
            ~F.col("has_reactome_pathway_evidence") | (F.col("drug_pathway_count") < 1),
            "drug Reactome pathway context unavailable",
        ).when(~F.col("disease_pathways_available"), "disease has no derived pathways")
    )


def gene_target_component(rows: DataFrame) -> DataFrame:
    reason = _gene_reason()
    cap, count = F.col("gene_target_cap"), F.col("matched_gene_target_count")
    value = blend(
        count,
        cap,
        F.col("fraction_of_drug_targets_matching_disease_genes"),
        F.col("count_share"),
        F.col("specificity_share"),
    )
    return rows.withColumns(
        {
            "gene_target_reason": reason,
            "gene_target_value": F.when(reason.isNull(), tidy(value, 6)),
            "gene_target_count_norm": F.when(reason.isNull(), tidy(saturate(count, cap), 6)),
        }
    )


def pathway_component(rows: DataFrame) -> DataFrame:
    reason = _pathway_reason()
    cap, count = F.col("pathway_cap"), F.col("matched_pathway_count")
    value = blend(
        count,
        cap,
        F.col("fraction_of_drug_pathways_matching_disease_pathways"),
        F.col("count_share"),
        F.col("specificity_share"),
    )
    return rows.withColumns(
        {
            "pathway_reason": reason,
            "pathway_value": F.when(reason.isNull(), tidy(value, 6)),
            "pathway_count_norm": F.when(reason.isNull(), tidy(saturate(count, cap), 6)),
        }
    )


def ml_component(rows: DataFrame, predictions: DataFrame | None) -> DataFrame:
    """``predictions(disease_id, drug_id, model_output, baseline_output, model_name, top_feature_names)``."""
    if predictions is None:
        none = {"model_output": "double", "baseline_output": "double", "model_name": "string",
                "top_feature_names": "array<string>"}
        rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
        given = F.lit(False)
    else:
        known = predictions.select(
            *PAIR, "model_output", "baseline_output", "model_name", "top_feature_names",
            F.lit(True).alias("_given"),
        )
        rows = matched(rows, known)
        given = F.coalesce("_given", F.lit(False))
    return rows.withColumns(
        {
            "ml_reason": F.when(~given, "no Phase 6 PredictionResult provided"),
            "ml_value": F.when(given, tidy(clip01(F.col("model_output")), 6)),
        }
    ).drop("_given")


# --- fuse ------------------------------------------------------------------------------
def fuse(
    features: DataFrame,
    predictions: DataFrame | None = None,
    scheme: dict | None = None,
    schemes: DataFrame | None = None,
) -> DataFrame:
    """Score every feature row; weights are renormalised over the available components."""
    rows = ml_component(features, predictions)
    rows = pathway_component(gene_target_component(with_scheme(rows, scheme, schemes)))
    weight = {c: F.when(F.col(f"{c}_value").isNotNull(), F.col(f"{c}_weight")) for c in _LABELS}
    total = sum((F.coalesce(w, F.lit(0.0)) for w in weight.values()), F.lit(0.0))
    rows = rows.withColumn("_total", F.nullif(total, F.lit(0.0)))
    effective = {c: weight[c] / F.col("_total") for c in _LABELS}
    part = {c: F.col(f"{c}_value") * effective[c] for c in _LABELS}
    weighted = sum((F.coalesce(p, F.lit(0.0)) for p in part.values()), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), tidy(F.lit(100.0) * weighted, 4)))
    n_available = sum((F.col(f"{c}_value").isNotNull().cast("int") for c in _LABELS), F.lit(0))
    rows = rows.withColumns(
        {
            **{f"{c}_effective_weight": tidy(effective[c], 6) for c in _LABELS},
            **{f"{c}_points": tidy(part[c] * 100.0, 4) for c in _LABELS},
            "repurposing_score": score,
            "n_components_available": n_available,
        }
    )
    n = len(_LABELS)
    return rows.withColumns(
        {
            "n_components_unavailable": F.lit(n) - F.col("n_components_available"),
            "weights_renormalized": F.col("n_components_available").between(1, n - 1),
            "scoring_version": F.lit(SCORING_VERSION),
        }
    ).drop("_total")


def components(fused: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Long form: one row per (row, component) with the numbers behind it."""

    def supporting(name: str) -> Column:
        if name == "gene_target":
            on = ["matched_gene_target_count", "matched_disease_gene_count", "matched_drug_target_count",
                  "fraction_of_drug_targets_matching_disease_genes",
                  "fraction_of_disease_genes_targeted_by_drug", "generated_by_gene_target"]
            off = ["has_gene_target_bridge", "drug_target_hgnc_mapped_count", "disease_gene_hgnc_mapped_count"]
            norm = F.col("gene_target_count_norm").alias("count_norm")
        elif name == "pathway":
            on = ["matched_pathway_count", "disease_pathway_count", "drug_pathway_count",
                  "fraction_of_drug_pathways_matching_disease_pathways",
                  "fraction_of_disease_pathways_matching_drug_pathways", "generated_by_pathway"]
            off = ["has_reactome_pathway_evidence", "disease_pathways_available", "drug_pathway_count"]
            norm = F.col("pathway_count_norm").alias("count_norm")
        else:
            return F.when(
                F.col("ml_value").isNotNull(),
                F.to_json(F.struct("model_output", "baseline_output", "model_name", "top_feature_names")),
            ).otherwise(F.lit("{}"))
        return F.when(
            F.col(f"{name}_value").isNotNull(), F.to_json(F.struct(*on, norm))
        ).otherwise(F.to_json(F.struct(*off)))

    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("component_order"),
                F.lit(c).alias("component"),
                F.col(f"{c}_value").isNotNull().alias("available"),
                F.col(f"{c}_value").alias("value"),
                F.col(f"{c}_weight").cast("double").alias("configured_weight"),
                F.col(f"{c}_effective_weight").alias("effective_weight"),
                F.col(f"{c}_points").alias("contribution_points"),
                F.col(f"{c}_reason").alias("unavailable_reason"),
                calculation_method(c).alias("calculation_method"),
                F.lit(FAMILIES[c]).alias("provenance"),
                supporting(c).alias("supporting"),
            )
            for i, c in enumerate(_LABELS)
        ]
    )
    return fused.select(*(keep or PAIR), F.inline(rows))


def key_mismatches(features: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions for pairs without a feature row; must be empty."""
    return predictions.join(features, PAIR, "left_anti").select(*PAIR)


def availability(fused: DataFrame) -> DataFrame:
    return fused.groupBy("disease_id").agg(
        *[F.count(f"{c}_value").alias(f"n_with_{c}") for c in _LABELS],
        F.count_if("weights_renormalized").alias("n_renormalized"),
        F.count(F.lit(1)).alias("n_pairs"),
    )
