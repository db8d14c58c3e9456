"""One feature row per (disease, drug) candidate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.constants import MODEL_COLUMNS
from tessera.functions.ids import no_blank, strip
from tessera.functions.numbers import ratio
from tessera.operators.candidates import PAIR
from tessera.operators.guards import pair_name, refused


def disease_dimension(diseases: DataFrame, genes: DataFrame, bridged: DataFrame | None, pathways: DataFrame) -> DataFrame:
    n_genes = genes.groupBy("disease_id").agg(F.count(F.lit(1)).cast("int").alias("disease_gene_count"))
    n_paths = pathways.groupBy("disease_id").agg(
        F.count_distinct("reactome_id").cast("int").alias("disease_pathway_count")
    )
    out = diseases.select("disease_id", "disease_name").join(n_genes, "disease_id", "left")
    if bridged is not None:
        mapped = bridged.groupBy("disease_id").agg(
            F.count_distinct("hgnc_id").cast("int").alias("disease_gene_hgnc_mapped_count")
        )
        out = out.join(mapped, "disease_id", "left")
    else:
        out = out.withColumn("disease_gene_hgnc_mapped_count", F.lit(0))
    return out.join(n_paths, "disease_id", "left").fillna(0)


def action(c: Column) -> Column:
    return no_blank(F.upper(strip(c)))


def target_profile(drug_targets: DataFrame) -> DataFrame:
    """Counts over the target rows of every drug; distinct targets, action kinds, mechanisms. The
    rows of a drug and target meet once, are counted by action there, and only sums go on."""
    rows = drug_targets.select("drug_id", "target_id", F.coalesce("action_type", F.lit("")).alias("_action"))
    rows = rows.repartition("drug_id", "target_id").groupBy("drug_id", "target_id", "_action").agg(F.count(F.lit(1)).alias("_n"))
    rows, n, act = rows.withColumn("_act", action(F.col("_action"))), F.col("_n"), F.col("_act")
    counts = {
        "inhibitor_target_count": act == "INHIBITOR",
        "agonist_target_count": act == "AGONIST",
        "antagonist_target_count": act == "ANTAGONIST",
        "targets_with_action_type_count": act.isNotNull(),
        "targets_missing_action_type_count": act.isNull(),
    }
    by_target = rows.groupBy("drug_id", "target_id").agg(
        F.count(F.lit(1)).alias("mechanism_count"), *[F.sum(F.when(c, n).otherwise(0)).alias(k) for k, c in counts.items()]
    )
    return by_target.groupBy("drug_id").agg(
        F.count("target_id").cast("int").alias("drug_target_count"),
        *[F.sum(k).cast("int").alias(k) for k in [*counts, "mechanism_count"]],
    )


def type_histogram(drug_targets: DataFrame, column: str, out: str) -> DataFrame:
    """Map of upper-cased kind to number of target rows; kinds are counted before they are gathered."""
    counts = (
        drug_targets.withColumn("kind", action(F.col(column)))
        .filter("kind is not null")
        .groupBy("drug_id", "kind")
        .agg(F.count(F.lit(1)).cast("int").alias("n"))
    )
    entries = F.array_sort(F.collect_list(F.struct("kind", "n")))
    return counts.groupBy("drug_id").agg(F.map_from_entries(entries).alias(out))


def drug_dimension(
    drugs: DataFrame,
    side_effects: DataFrame,
    targets: DataFrame,
    bridged: DataFrame | None,
    pathways: DataFrame,
) -> DataFrame:
    effects = side_effects.groupBy("drug_id").agg(F.count(F.lit(1)).cast("int").alias("side_effect_count"))
    paths = pathways.groupBy("drug_id").agg(F.count(F.lit(1)).cast("int").alias("drug_pathway_count"))
    parts = [effects, target_profile(targets), paths]
    if bridged is not None:
        parts.append(
            bridged.groupBy("drug_id").agg(
                F.count_distinct("hgnc_id").cast("int").alias("drug_target_hgnc_mapped_count")
            )
        )
    out = reduce(lambda a, b: a.join(b, "drug_id", "left"), parts, drugs.select("drug_id", "drug_name", "chembl_id"))
    if bridged is None:
        out = out.withColumn("drug_target_hgnc_mapped_count", F.lit(0))
    counts = [c for c, t in out.dtypes if t == "int"]
    out = out.fillna(0, counts)
    maps = [
        type_histogram(targets, "action_type", "target_action_type_counts"),
        type_histogram(targets, "target_type", "target_type_counts"),
    ]
    out = reduce(lambda a, b: a.join(b, "drug_id", "left"), maps, out)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    return out.withColumns(
        {c: F.coalesce(c, empty) for c in ("target_action_type_counts", "target_type_counts")}
    )


def features(
    pairs: DataFrame,
    disease_dim: DataFrame,
    drug_dim: DataFrame,
    bridge_available: bool = True,
    pathway_source: str = "level4_index_uncapped",
) -> DataFrame:
    """Join the pair counts with both dimensions and derive ratios and flags.

    A pair whose disease or drug has no profile is an error that ends the job; the left joins
    that find it move no more than inner ones would."""
    known = F.lit(True)
    rows = pairs.join(disease_dim.withColumn("_disease", known), "disease_id", "left")
    rows = rows.join(drug_dim.withColumn("_drug", known), "drug_id", "left")
    fault = F.when(F.col("_disease").isNull(), F.concat(F.lit("no disease profile for candidate "), pair_name()))
    fault = fault.when(F.col("_drug").isNull(), F.concat(F.lit("no drug profile for candidate "), pair_name()))
    rows = rows.withColumn("disease_id", refused(F.col("disease_id"), fault))
    matched_paths = F.col("pathway_reason_count")
    return rows.withColumns(
        {
            "generation_method_count": (
                F.col("generated_by_gene_target").cast("int") + F.col("generated_by_pathway").cast("int")
            ),
            "matched_pathway_count": matched_paths,
            "unique_target_count": F.col("drug_target_count"),
            "fraction_of_drug_targets_matching_disease_genes": ratio(
                F.col("matched_gene_target_count"), F.col("drug_target_hgnc_mapped_count")
            ),
            "fraction_of_disease_genes_targeted_by_drug": ratio(
                F.col("matched_gene_target_count"), F.col("disease_gene_hgnc_mapped_count")
            ),
            "fraction_of_drug_pathways_matching_disease_pathways": ratio(
                matched_paths, F.col("drug_pathway_count")
            ),
            "fraction_of_disease_pathways_matching_drug_pathways": ratio(
                matched_paths, F.col("disease_pathway_count")
            ),
            "drug_pathway_source": F.lit(pathway_source),
            "has_sider_evidence": F.col("side_effect_count") > 0,
            "has_chembl_target_evidence": F.col("drug_target_count") > 0,
            "has_reactome_pathway_evidence": (
                F.lit(pathway_source != "unavailable") & (F.col("drug_pathway_count") > 0)
            ),
            "has_gene_target_bridge": F.lit(bridge_available),
            "disease_pathways_available": F.col("disease_pathway_count") > 0,
        }
    ).select(
        *PAIR,
        "disease_name",
        "drug_name",
        "chembl_id",
        *MODEL_COLUMNS,
        "unique_target_count",
        "target_action_type_counts",
        "target_type_counts",
        "drug_pathway_source",
    )


def missing_dimensions(pairs: DataFrame, disease_dim: DataFrame, drug_dim: DataFrame) -> DataFrame:
    """Candidate keys that a dimension does not know; must be empty before a batch build."""
    no_disease = pairs.join(disease_dim, "disease_id", "left_anti").select(*PAIR, F.lit("disease").alias("missing"))
    no_drug = pairs.join(drug_dim, "drug_id", "left_anti").select(*PAIR, F.lit("drug").alias("missing"))
    return no_disease.unionByName(no_drug)


def flat_long(rows: DataFrame) -> DataFrame:
    """Every scalar and every histogram entry as (feature_name, feature_value)."""
    skip = {*PAIR, "disease_name", "drug_name", "chembl_id", "drug_pathway_source",
            "target_action_type_counts", "target_type_counts"}
    scalars = [c for c in rows.columns if c not in skip]
    named = F.map_from_arrays(
        F.array(*[F.lit(c) for c in scalars]), F.array(*[F.col(c).cast("double") for c in scalars])
    )

    def prefixed(column: str, prefix: str) -> Column:
        return F.transform_values(
            F.transform_keys(column, lambda k, v: F.concat(F.lit(prefix), k)), lambda k, v: v.cast("double")
        )

    every = F.map_concat(
        named,
        prefixed("target_action_type_counts", "action_type__"),
        prefixed("target_type_counts", "target_type__"),
    )
    return rows.select(*PAIR, F.explode(every).alias("feature_name", "feature_value"))
