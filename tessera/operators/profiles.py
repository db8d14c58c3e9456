"""Entity profiles: ordered facts, summaries, nested records at the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.constants import (
    GENES_PER_DISEASE,
    MIN_PATHWAY_GENES,
    PROFILE_PATHWAY_CAP,
    PROFILE_TOP,
    SNAPSHOT,
    SUMMARY_PATHWAYS,
    SUMMARY_TOP,
)
from tessera.functions.numbers import tidy
from tessera.functions.texts import mechanism_phrase
from tessera.operators.candidates import DrugFacts
from tessera.operators.ordering import first_per_key, number_rows, top_per_group
from tessera.workspace import Workspace


def _gene_order() -> list[Column]:
    return [F.col("association_score").desc_nulls_last(), F.col("gene_name").asc_nulls_last(), F.col("gene_id")]


def _pathway_order() -> list[Column]:
    return [
        F.col("gene_support_count").desc_nulls_last(),
        F.col("association_score").desc_nulls_last(),
        F.col("pathway_name").asc_nulls_last(),
        F.col("pathway_id"),
    ]


def _effect_order() -> list[Column]:
    return [F.col("side_effect_name").asc_nulls_last(), F.col("side_effect_id")]


def _target_order() -> list[Column]:
    return [F.col("target_name").asc_nulls_last(), F.col("target_id")]


# --- ordered facts -------------------------------------------------------------------
def ordered_genes(genes: DataFrame, ws: Workspace) -> DataFrame:
    return number_rows(genes, _gene_order(), ws, "ordered_genes", ["disease_id"])


def ordered_pathways(pathways: DataFrame, ws: Workspace) -> DataFrame:
    return number_rows(pathways, _pathway_order(), ws, "ordered_pathways", ["disease_id"])


def ordered_side_effects(effects: DataFrame, ws: Workspace) -> DataFrame:
    return number_rows(effects, _effect_order(), ws, "ordered_effects", ["drug_id"])


def ordered_targets(targets: DataFrame, ws: Workspace) -> DataFrame:
    return number_rows(targets, _target_order(), ws, "ordered_targets", ["drug_id"])


def mechanisms(targets: DataFrame) -> DataFrame:
    """One phrase per (drug, target, action), the first in target-name order."""
    rows = first_per_key(
        targets.withColumn("_action", F.coalesce("action_type", F.lit(""))),
        ["drug_id", "target_id", "_action"],
        _target_order(),
    )
    phrase = mechanism_phrase(F.col("action_type"), F.col("target_name"), F.col("target_id"))
    return rows.select("drug_id", "target_id", "target_name", "action_type", phrase.alias("description"), "source")


# --- grouped arrays (at most ``k`` entries per entity) ----------------------------------
def _gather(df: DataFrame, key: str, place: str, value: Column, out: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), value.alias("v"))))
    return df.groupBy(key).agg(F.transform(pairs, lambda s: s["v"]).alias(out))


def _top(df: DataFrame, key: str, order: list[Column], k: int, value: Column, out: str) -> DataFrame:
    return _gather(top_per_group(df, [key], order, k, out="_p"), key, "_p", value, out)


def _at_cap(n: Column, genes_per_disease: int | None) -> Column:
    """Whether a disease has as many genes as the cap that is given, else as the source system's cap."""
    return n >= (GENES_PER_DISEASE if genes_per_disease is None else genes_per_disease)


def molecular_summary(
    diseases: DataFrame, genes: DataFrame, pathways: DataFrame, genes_per_disease: int | None = None
) -> DataFrame:
    g = genes.groupBy("disease_id").agg(
        F.count(F.lit(1)).alias("gene_count"),
        tidy(F.avg("association_score"), 6).alias("mean_gene_association_score"),
        tidy(F.max("association_score"), 6).alias("max_gene_association_score"),
    )
    p = pathways.groupBy("disease_id").agg(F.count(F.lit(1)).alias("pathway_count"))
    top_genes = _top(genes, "disease_id", _gene_order(), PROFILE_TOP, F.col("gene_name"), "top_gene_symbols")
    top_genes = top_genes.withColumn(
        "top_gene_symbols", F.filter("top_gene_symbols", lambda s: F.coalesce(s, F.lit("")) != "")
    )
    top_paths = _top(
        pathways, "disease_id", _pathway_order(), PROFILE_TOP, F.col("pathway_name"), "top_pathway_names"
    )
    none = F.array().cast("array<string>")
    out = diseases.select("disease_id")
    for part in (g, p, top_genes, top_paths):
        out = out.join(part, "disease_id", "left")
    return out.withColumns(
        {
            "gene_count": F.coalesce("gene_count", F.lit(0)),
            "pathway_count": F.coalesce("pathway_count", F.lit(0)),
            "top_gene_symbols": F.coalesce("top_gene_symbols", none),
            "top_pathway_names": F.coalesce("top_pathway_names", none),
            "genes_truncated": _at_cap(F.coalesce("gene_count", F.lit(0)), genes_per_disease),
        }
    )


def external_ids(entities: DataFrame, identifiers: DataFrame, entity: str, id_column: str) -> DataFrame:
    """Crosswalk entries per entity, long."""
    known = entities.select(F.col(id_column).alias("internal_id"))
    return (
        identifiers.filter(F.col("entity_type") == entity)
        .join(known, "internal_id", "left_semi")
        .select(F.col("internal_id").alias(id_column), "external_id", F.col("external_source").alias("source"), "is_primary")
    )


def fallback_external_ids(entities: DataFrame, entity: str) -> DataFrame:
    """What the entity table itself knows, for runs without a crosswalk."""
    if entity == "disease":
        return entities.filter("ontology_id is not null").select(
            "disease_id", F.col("ontology_id").alias("external_id"), "source", F.lit(True).alias("is_primary")
        )
    both = entities.select(
        "drug_id",
        F.explode(
            F.array(
                F.struct(F.lit("chembl").alias("source"), F.col("chembl_id").alias("external_id")),
                F.struct(F.lit("pubchem").alias("source"), F.col("pubchem_cid").alias("external_id")),
            )
        ).alias("x"),
    )
    return both.filter("x.external_id is not null").select(
        "drug_id", "x.external_id", "x.source", F.lit(False).alias("is_primary")
    )


# --- pathways of a drug, capped for the profile -------------------------------------------
def capped_pathways(by_drug: DataFrame, facts: DataFrame | DrugFacts, limit: int | None = PROFILE_PATHWAY_CAP) -> DataFrame:
    """Best supported pathways per drug with the proteins behind them. Facts not yet unfolded
    unfold for these pathways only."""
    if limit is None:
        kept = by_drug
    else:
        order = [F.col("supporting_target_count").desc(), F.col("pathway_name"), F.col("reactome_id")]
        kept = top_per_group(by_drug, ["drug_id"], order, limit, out="position")
    if isinstance(facts, DrugFacts):
        facts = facts.of(kept)
    else:
        facts = facts.join(kept.select("drug_id", "reactome_id"), ["drug_id", "reactome_id"], "left_semi")
    proteins = facts.groupBy("drug_id", "reactome_id").agg(
        F.sort_array(F.collect_set("uniprot_id")).alias("supporting_uniprot_ids")
    )
    return kept.join(proteins, ["drug_id", "reactome_id"])


def context_availability(
    drugs: DataFrame, targets: DataFrame, by_drug: DataFrame | None, enabled: bool = True
) -> DataFrame:
    """Whether a drug has pathway context, and the reason when it has none."""
    proteins = targets.groupBy("drug_id").agg(F.count_distinct("uniprot_id").alias("n_proteins"))
    out = drugs.select("drug_id").join(proteins, "drug_id", "left").fillna(0, ["n_proteins"])
    if by_drug is not None:
        n = by_drug.groupBy("drug_id").agg(F.count(F.lit(1)).alias("n_pathways"))
        out = out.join(n, "drug_id", "left").fillna(0, ["n_pathways"])
    else:
        out = out.withColumn("n_pathways", F.lit(0).cast("long"))
    reason = (
        F.when(F.lit(not enabled), "pathway enrichment disabled for this call")
        .when(F.col("n_proteins") == 0, "drug has no target with a UniProt accession")
        .when(F.lit(by_drug is None), "Reactome enrichment unavailable: source not present")
        .when(F.col("n_pathways") == 0, "no human Reactome pathway maps to this drug's target proteins")
    )
    looked_up = F.lit(enabled and by_drug is not None) & (F.col("n_proteins") > 0)
    return out.withColumns({"pathway_context_available": looked_up, "unavailable_reason": reason})


# --- provenance ---------------------------------------------------------------------------
# fixed values: sources named in a profile
DISEASE_DATASETS = ["diseases", "disease_genes", "disease_pathways", "identifiers"]
DRUG_DATASETS = ["drugs", "drug_side_effects", "drug_targets", "identifiers"]
DERIVED_PATHWAYS = "derived:opentargets+reactome"
REACTOME = "reactome (UniProt2Reactome, human)"
SCORE_MEANING = (
    "overall association score of the gene with the disease in [0,1]; it says neither that the gene "
    "causes the disease nor that acting on it helps"
)
PATHWAY_MEANING = (
    "derived, not curated: pathways that hold enough of the disease's genes; the score is the mean "
    "of those genes' scores"
)
DRUG_PATHWAY_MEANING = (
    "derived, not curated: pathways of the proteins that the drug's targets name; the count is the "
    "number of targets in the pathway"
)
TARGET_COVERAGE = "curated mechanisms of action only; a drug without a row here may still have targets"
NOT_USED = {
    "pubchem": "the drugs carry its ids; its chemical descriptors have no use here",
    "uniprot": "the targets carry its accessions; nothing else of it is used",
}


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def disease_provenance(genes_per_disease: int | None = None) -> Column:
    """Where a disease profile comes from, over its ``source`` and ``genes_truncated``."""
    return F.struct(
        F.coalesce(F.nullif("source", F.lit("")), F.lit("opentargets")).alias("disease_source"),
        _texts(DISEASE_DATASETS).alias("datasets_used"),
        F.lit("opentargets").alias("gene_source"),
        F.lit(SCORE_MEANING).alias("gene_score_semantics"),
        F.lit(genes_per_disease or GENES_PER_DISEASE).alias("genes_capped_per_disease"),
        "genes_truncated",
        F.lit(DERIVED_PATHWAYS).alias("pathway_source"),
        F.lit(PATHWAY_MEANING).alias("pathway_derivation"),
        F.lit(MIN_PATHWAY_GENES).alias("pathway_min_gene_support"),
        F.lit(SNAPSHOT).alias("snapshot_note"),
    )


def drug_provenance() -> Column:
    """Where a drug profile comes from; optional sources are named as used or as skipped and why."""
    used = F.coalesce("pathway_context_available", F.lit(False))
    skipped = F.create_map(*[F.lit(x) for pair in NOT_USED.items() for x in pair])
    lacking = F.create_map(F.lit("reactome"), F.coalesce("unavailable_reason", F.lit("not available in this run")))
    return F.struct(
        F.lit("sider (Level 1 drugs); PubChem CID + ChEMBL id crosswalk").alias("identity_source"),
        F.lit("sider (SIDER 4.1, MedDRA preferred terms)").alias("side_effect_source"),
        F.lit("chembl (mechanism of action)").alias("target_source"),
        F.lit("chembl (action_type + target_name from drug_targets)").alias("mechanism_source"),
        F.lit(TARGET_COVERAGE).alias("target_coverage_note"),
        F.when(used, REACTOME).otherwise("not integrated").alias("pathway_source"),
        F.lit(DRUG_PATHWAY_MEANING).alias("pathway_derivation"),
        _texts(DRUG_DATASETS).alias("datasets_used"),
        F.when(used, _texts(["reactome"])).otherwise(F.array().cast("array<string>")).alias("optional_sources_used"),
        F.when(used, skipped).otherwise(F.map_concat(skipped, lacking)).alias("optional_sources_skipped"),
        F.lit(SNAPSHOT).alias("snapshot_note"),
    )


# --- nested profiles ----------------------------------------------------------------------
def disease_profiles(
    diseases: DataFrame, genes: DataFrame, pathways: DataFrame, identifiers: DataFrame,
    genes_per_disease: int | None = None,
) -> DataFrame:
    """One record per disease. Its arrays hold all genes and pathways of one disease; with
    ``genes_per_disease`` only the strongest genes."""
    xrefs = external_ids(diseases, identifiers, "disease", "disease_id")
    if genes_per_disease is not None:
        genes = top_per_group(genes, ["disease_id"], _gene_order(), genes_per_disease, out="_p").drop("_p")
    score = F.col("association_score")
    g = F.struct(  # in the order of _gene_order
        score.isNull().alias("unscored"),
        (-F.nanvl(score, F.lit(float("inf")))).alias("by_score"),
        F.col("gene_name").isNull().alias("unnamed"),
        "gene_name", "gene_id", "ensembl_id", "association_score", "source",
    )
    gene = ["gene_id", "gene_name", "ensembl_id", "association_score", "source"]
    last = F.lit(float("inf"))
    p = F.struct(
        F.coalesce(-F.col("gene_support_count").cast("double"), last).alias("by_support"),
        F.coalesce(-F.col("association_score"), last).alias("by_score"),
        "pathway_name", "pathway_id", "reactome_id", "gene_support_count", "association_score", "source",
    )
    parts = [
        genes.groupBy("disease_id").agg(
            F.transform(F.array_sort(F.collect_list(g)), lambda s: F.struct(*[s[c].alias(c) for c in gene])).alias("genes")
        ),
        pathways.groupBy("disease_id").agg(
            F.transform(F.array_sort(F.collect_list(p)), lambda s: s.dropFields("by_support", "by_score")).alias("pathways")
        ),
        xrefs.groupBy("disease_id").agg(
            F.array_sort(F.collect_list(F.struct("source", "external_id", "is_primary"))).alias("external_identifiers")
        ),
        molecular_summary(diseases, genes, pathways, genes_per_disease),
        disease_summaries(diseases, genes, pathways, genes_per_disease),
    ]
    out = diseases
    for part in parts:
        out = out.join(part, "disease_id", "left")
    return out.withColumn("provenance", disease_provenance(genes_per_disease))


def drug_profiles(
    drugs: DataFrame, effects: DataFrame, targets: DataFrame, by_drug: DataFrame, facts: DataFrame | DrugFacts,
    identifiers: DataFrame, pathway_limit: int | None = PROFILE_PATHWAY_CAP,
) -> DataFrame:
    """One record per drug, with the ``pathway_limit`` best supported pathways (None = all)."""
    xrefs = external_ids(drugs, identifiers, "drug", "drug_id")
    e = F.struct("side_effect_name", "side_effect_id", "umls_cui", "source")
    unnamed = F.col("target_name").isNull().alias("unnamed")
    t = F.struct(unnamed, "target_name", "target_id", "target_type", "uniprot_id", "action_type", "source")
    m = F.struct(unnamed, "target_name", "target_id", "action_type", "description")

    def by_name(c: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(c)), lambda s: s.dropFields("unnamed"))

    p = F.struct(
        (-F.col("supporting_target_count")).alias("by_support"), "pathway_name", "reactome_id",
        "supporting_target_count", "supporting_uniprot_ids",
    )

    def placed(s: Column, i: Column) -> Column:
        kept = ["reactome_id", "pathway_name", "supporting_target_count", "supporting_uniprot_ids"]
        return F.struct((i + 1).alias("position"), *[s[c].alias(c) for c in kept])

    parts = [
        effects.groupBy("drug_id").agg(
            F.array_sort(F.collect_list(e)).alias("side_effects"), F.count(F.lit(1)).alias("side_effect_count")
        ),
        targets.groupBy("drug_id").agg(
            by_name(t).alias("targets"), F.count(F.lit(1)).alias("target_count")
        ),
        mechanisms(targets).groupBy("drug_id").agg(by_name(m).alias("mechanisms")),
        capped_pathways(by_drug, facts, pathway_limit).groupBy("drug_id").agg(
            F.transform(F.array_sort(F.collect_list(p)), placed).alias("pathways")
        ),
        xrefs.groupBy("drug_id").agg(
            F.array_sort(F.collect_list(F.struct("source", "external_id", "is_primary"))).alias("external_identifiers")
        ),
        context_availability(drugs, targets, by_drug).drop("n_proteins", "n_pathways"),
        drug_summaries(drugs, effects, targets, by_drug, pathway_limit),
    ]
    out = drugs
    for part in parts:
        out = out.join(part, "drug_id", "left")
    # in the order of the targets, each protein where it is first named
    proteins = F.array_distinct(F.filter(F.transform("targets", lambda x: x["uniprot_id"]), lambda u: F.coalesce(u, F.lit("")) != ""))
    out = out.withColumns(
        {"proteins": F.coalesce(proteins, F.array().cast("array<string>")), "provenance": drug_provenance()}
    )
    return out.fillna(0, ["side_effect_count", "target_count"])


# --- text summaries ---------------------------------------------------------------------------
def _more(n: Column, limit: int, text: str = " ...") -> Column:
    return F.when(n > limit, text).otherwise("")


def _listed(items: Column, prefix: str = "  - ") -> Column:
    """Items as lines; null when there are none, so that ``concat_ws`` skips it."""
    lines = F.transform(items, lambda s: F.concat(F.lit(prefix), s))
    return F.when(F.size(items) > 0, F.array_join(lines, "\n"))


def disease_summaries(
    diseases: DataFrame, genes: DataFrame, pathways: DataFrame, genes_per_disease: int | None = None
) -> DataFrame:
    counts_g = genes.groupBy("disease_id").agg(F.count(F.lit(1)).alias("_ng"))
    counts_p = pathways.groupBy("disease_id").agg(F.count(F.lit(1)).alias("_np"))
    named = F.coalesce(F.nullif("gene_name", F.lit("")), F.col("gene_id"))
    support = F.concat("pathway_name", F.lit(" (n="), F.coalesce(F.col("gene_support_count").cast("string"), F.lit("None")), F.lit(")"))
    none = F.array().cast("array<string>")
    rows = (
        diseases.join(counts_g, "disease_id", "left")
        .join(counts_p, "disease_id", "left")
        .join(_top(genes, "disease_id", _gene_order(), SUMMARY_TOP, named, "_g"), "disease_id", "left")
        .join(_top(pathways, "disease_id", _pathway_order(), SUMMARY_TOP, support, "_p"), "disease_id", "left")
        .withColumns({"_ng": F.coalesce("_ng", F.lit(0)), "_np": F.coalesce("_np", F.lit(0)),
                      "_g": F.coalesce("_g", none), "_p": F.coalesce("_p", none)})
    )
    cap = F.when(_at_cap(F.col("_ng"), genes_per_disease), ", Level 1 cap reached").otherwise("")
    # fixed values: wording of the summary
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Disease: "), "disease_name"),
        F.concat(F.lit("Internal ID: "), "disease_id"),
        F.concat(F.lit("Ontology ID: "), F.nullif("ontology_id", F.lit(""))),
        F.lit(""),
        F.concat(F.lit("Associated genes ("), F.col("_ng"), cap, F.lit("):")),
        F.concat(F.lit("  "), F.array_join("_g", ", "), _more(F.col("_ng"), SUMMARY_TOP)),
        F.lit(""),
        F.concat(F.lit("Associated pathways ("), F.col("_np"), F.lit(", derived from disease genes x Reactome):")),
        _listed(F.col("_p")),
        F.when(F.col("_np") > SUMMARY_TOP, "  ..."),
        F.lit(""),
        F.lit("Evidence:"),
        F.lit("  - disease-gene associations: Open Targets Platform association scores"),
        F.lit(
            "  - disease-pathway associations: DERIVED (Reactome gene->pathway; "
            f">= {MIN_PATHWAY_GENES} supporting genes), not curated"
        ),
        F.lit(""),
        F.lit(
            "Note: 'associated with' does not mean 'causes'. This profile is "
            "hypothesis-generating evidence, not a clinical or therapeutic claim."
        ),
    )
    return rows.select("disease_id", text.alias("summary_text"))


def drug_summaries(
    drugs: DataFrame, effects: DataFrame, targets: DataFrame, by_drug: DataFrame,
    pathway_limit: int | None = PROFILE_PATHWAY_CAP,
) -> DataFrame:
    none = F.array().cast("array<string>")
    n_effects = effects.groupBy("drug_id").agg(F.count(F.lit(1)).alias("_ne"))
    n_targets = targets.groupBy("drug_id").agg(F.count(F.lit(1)).alias("_nt"))
    acts = mechanisms(targets)
    pathway = F.concat("pathway_name", F.lit(" (targets="), "supporting_target_count", F.lit(")"))
    order_p = [F.col("supporting_target_count").desc(), F.col("pathway_name"), F.col("reactome_id")]
    rows = (
        drugs.join(n_effects, "drug_id", "left")
        .join(n_targets, "drug_id", "left")
        .join(_top(effects, "drug_id", _effect_order(), SUMMARY_TOP, F.col("side_effect_name"), "_e"), "drug_id", "left")
        .join(_top(acts, "drug_id", _target_order(), SUMMARY_TOP, F.col("description"), "_m"), "drug_id", "left")
        .join(_top(by_drug, "drug_id", order_p, SUMMARY_PATHWAYS, pathway, "_p"), "drug_id", "left")
        .join(context_availability(drugs, targets, by_drug), "drug_id", "left")
        .withColumns({"_ne": F.coalesce("_ne", F.lit(0)), "_nt": F.coalesce("_nt", F.lit(0)),
                      **{c: F.coalesce(c, none) for c in ("_e", "_m", "_p")}})
    )
    shown = F.least("n_pathways", F.lit(pathway_limit))
    # fixed values: wording of the summary
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Drug: "), "drug_name"),
        F.concat(F.lit("Internal ID: "), "drug_id"),
        F.concat(F.lit("ChEMBL ID: "), F.nullif("chembl_id", F.lit(""))),
        F.concat(F.lit("PubChem CID: "), F.nullif("pubchem_cid", F.lit(""))),
        F.lit(""),
        F.concat(F.lit("Side effects ("), F.col("_ne"), F.lit(", SIDER):")),
        F.concat(F.lit("  "), F.array_join("_e", ", "), _more(F.col("_ne"), SUMMARY_TOP)),
        F.lit(""),
        F.when(F.col("_nt") > 0, F.concat(F.lit("Targets ("), F.col("_nt"), F.lit(", ChEMBL mechanism of action):")))
        .otherwise("Targets: none in the SIDER∩ChEMBL mechanism-of-action intersection"),
        _listed(F.col("_m")),
        F.lit(""),
        F.when(
            F.col("n_pathways") > 0,
            F.concat(F.lit("Target pathways ("), shown, F.lit(", derived via Reactome):")),
        ).otherwise(F.concat(F.lit("Target pathways: unavailable ("), "unavailable_reason", F.lit(")"))),
        _listed(F.col("_p")),
        F.lit(""),
        F.lit("Provenance: SIDER -> side effects; ChEMBL -> targets/mechanisms; Reactome -> optional target pathways."),
        F.lit(
            "Note: target and pathway annotations are mechanistic / annotation evidence "
            "only. They are not evidence of clinical benefit for any disease."
        ),
    )
    return rows.select("drug_id", text.alias("summary_text"))
