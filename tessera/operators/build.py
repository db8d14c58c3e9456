"""From landed source rows to the six tables, the id registries and the crosswalk."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.constants import GENES_PER_DISEASE, MIN_PATHWAY_GENES
from tessera.functions import ids
from tessera.functions.numbers import tidy
from tessera.operators.conform import conform, counted_rows, rejections, split_valid, to_contract
from tessera.operators.ordering import first_per_key, left_join_spread, top_per_group
from tessera.operators.registry import mint, names, xrefs
from tessera.workspace import Workspace


@dataclass
class Built:
    """One built table, the registry it minted, and what it reported.

    ``input`` (rows that came to the contract) and ``output`` (rows of the table) are known once
    ``keep`` has written the table, ``ids`` (ids minted) once the registry is built."""

    table: DataFrame
    registry: DataFrame
    rejected: list[DataFrame] = field(default_factory=list)
    observations: list[DataFrame] = field(default_factory=list)
    input: Observation | None = None
    ids: Observation | None = None
    output: Observation | None = None


def keep(b: Built, name: str, ws: Workspace) -> Built:
    """Write the table; its counts come with the write."""
    b.output = Observation()
    b.table = ws.store(name, counted_rows(b.table, b.output))
    return b


def _by_key(registry: DataFrame, key: str, out: str) -> DataFrame:
    return registry.select(F.col("key").alias(key), F.col("internal_id").alias(out))


# --- drugs -------------------------------------------------------------------------
def compound_map(raw_map: DataFrame) -> DataFrame:
    """The first ChEMBL id of each compound; rows with a missing side drop out."""
    keys = {"cid": ids.compound_key(F.col("pubchem_cid")), "chembl_id": ids.chembl_key(F.col("chembl_id"))}
    keyed = ids.worked_out(raw_map, {"seq": F.col("seq"), **keys}).dropna()
    return keyed.groupBy("cid").agg(F.min_by("chembl_id", "seq").alias("chembl_id"))


def drug_rows(raw_names: DataFrame) -> DataFrame:
    cid, name = ids.compound_key(F.col("stitch_id")), ids.name_key(F.col("drug_name"))
    return raw_names.select("seq", "stitch_id", cid.alias("cid"), name.alias("drug_name")).withColumn(
        "reason",
        F.when(F.col("cid").isNull(), "unmappable_pubchem_cid").when(
            F.col("drug_name").isNull(), "missing_name"
        ),
    )


def build_drugs(raw_names: DataFrame, raw_map: DataFrame, ws: Workspace) -> Built:
    rows = drug_rows(raw_names)
    good = rows.filter("reason is null")
    came, ids_made = Observation(), Observation()
    registry = mint(good.select(F.col("cid").alias("key"), "seq"), "drug", ws, ids_made)
    cid_ref = F.concat(F.lit("CID:"), F.col("cid"))
    full = (
        good.join(_by_key(registry, "cid", "drug_id"), "cid")
        .join(compound_map(raw_map), "cid", "left")
        .select(
            "seq",
            "cid",
            "drug_id",
            "drug_name",
            F.coalesce("chembl_id", cid_ref).alias("canonical_identifier"),
            F.col("cid").alias("pubchem_cid"),
            "chembl_id",
            F.lit("sider").alias("source"),
        )
    )
    full = ws.store("drug_rows", full)
    clean, rejected = conform(full, "drugs", seen=came)
    bad = rejections(rows.filter("reason is not null"), "build:drugs", F.col("reason"), F.col("stitch_id"))
    name = F.col("drug_name")
    return Built(
        clean,
        registry,
        [bad, rejected],
        [
            xrefs(
                full,
                "drug",
                "drug_id",
                [
                    (F.col("cid"), "sider", name, True),
                    (cid_ref, "pubchem", name, False),
                    (F.col("chembl_id"), "chembl", None, False),
                ],
            )
        ],
        came,
        ids_made,
    )


# --- drug side effects ------------------------------------------------------------------
def preferred_terms(raw: DataFrame) -> DataFrame:
    """Preferred terms only; the preferred concept id wins over the label's."""
    return raw.filter(F.col("meddra_type") == "PT").select(
        "seq",
        "stitch_id",
        F.coalesce("umls_meddra", "umls_label").alias("umls_cui"),
        "side_effect_name",
    )


def build_drug_side_effects(raw: DataFrame, drug_registry: DataFrame, ws: Workspace) -> Built:
    """Rows are reduced to one per (compound, concept) before they meet the drugs."""
    keyed = preferred_terms(raw).select(
        "seq",
        "stitch_id",
        ids.compound_key(F.col("stitch_id")).alias("cid"),
        ids.concept_key(F.col("umls_cui")).alias("cui"),
        F.col("umls_cui").alias("raw_cui"),
        ids.name_key(F.col("side_effect_name")).alias("name"),
    )
    named = F.col("name").isNotNull()
    pairs = keyed.groupBy("cid", "cui").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("seq", "stitch_id", "raw_cui")).alias("first"),
        F.count_if(~named).alias("n_unnamed"),
        F.min(F.when(~named, F.col("seq"))).alias("unnamed_seq"),
        F.min(F.when(named, F.struct("seq", "name"))).alias("named"),
    )
    pairs = ws.store(
        "side_effect_pairs",
        left_join_spread(pairs, _by_key(drug_registry, "cid", "drug_id"), "cid", "cui"),
    )
    stage = "build:drug_side_effects"
    known = F.col("drug_id").isNotNull()
    with_cui = pairs.filter(known & F.col("cui").isNotNull())
    lost = pairs.withColumn("seq", F.col("first.seq"))
    rejected = [
        rejections(
            lost.filter(~known), stage, F.lit("drug_not_in_drugs"), F.col("first.stitch_id"), n=F.col("n")
        ),
        rejections(
            lost.filter(known & F.col("cui").isNull()),
            stage,
            F.lit("unmappable_umls_cui"),
            F.col("first.raw_cui"),
            n=F.col("n"),
        ),
        rejections(
            with_cui.filter("n_unnamed > 0").withColumn("seq", F.col("unnamed_seq")),
            stage,
            F.lit("missing_side_effect_name"),
            F.col("cui"),
            n=F.col("n_unnamed"),
        ),
    ]
    kept = with_cui.filter("named is not null").select(
        "drug_id", "cui", F.col("named.seq").alias("seq"), F.col("named.name").alias("side_effect_name"), (F.col("n") - F.col("n_unnamed")).alias("n")
    )
    came, ids_made = Observation(), Observation()
    seen = kept.select(F.col("cui").alias("key"), "seq", F.col("side_effect_name").alias("name"))
    registry = mint(seen, "side_effect", ws, ids_made)
    full = kept.join(_by_key(registry, "cui", "side_effect_id"), "cui").withColumns(
        {"umls_cui": F.col("cui"), "source": F.lit("sider")}
    )
    rejected.append(
        rejections(
            full.filter("n > 1"),
            stage,
            F.lit("duplicate_primary_key"),
            F.to_json(F.struct("drug_id", "side_effect_id")),
            n=F.col("n") - 1,
        )
    )
    found = xrefs(names(registry), "side_effect", "internal_id", [(F.col("key"), "sider", F.col("name"), True)])
    table = to_contract(counted_rows(full, came, F.col("n")), "drug_side_effects")
    return Built(table, registry.drop("named"), rejected, [found], came, ids_made)


# --- diseases and their genes ---------------------------------------------------------
def disease_rows(raw: DataFrame) -> DataFrame:
    oid, name = ids.ontology_key(F.col("ontology_id")), ids.name_key(F.col("disease_name"))
    return raw.select(
        "seq", F.col("ontology_id").alias("raw_id"), oid.alias("ontology_id"), name.alias("disease_name")
    )


def unresolved_seeds(seeds: DataFrame, raw_diseases: DataFrame) -> DataFrame:
    """Requested ids without a payload."""
    wanted = ids.ontology_key(F.col("ontology_id")).alias("wanted")
    found = raw_diseases.select(wanted).distinct()
    return seeds.select("*", wanted).join(found, "wanted", "left_anti").drop("wanted")


def build_diseases(raw: DataFrame, ws: Workspace, seeds: DataFrame | None = None) -> Built:
    rows = disease_rows(raw)
    good = rows.filter(F.col("ontology_id").isNotNull() & F.col("disease_name").isNotNull())
    came, ids_made = Observation(), Observation()
    registry = mint(good.select(F.col("ontology_id").alias("key"), "seq"), "disease", ws, ids_made)
    full = good.join(_by_key(registry, "ontology_id", "disease_id"), "ontology_id").withColumn(
        "source", F.lit("opentargets")
    )
    clean, rejected = conform(full, "diseases", seen=came)
    stage = "build:diseases"
    lost = rows.filter(F.col("ontology_id").isNull() | F.col("disease_name").isNull())
    bad = [rejections(lost, stage, F.lit("missing_id_or_name"), F.col("raw_id")), rejected]
    if seeds is not None:
        bad.append(
            rejections(
                unresolved_seeds(seeds, raw), stage, F.lit("seed_id_unresolved"), F.col("ontology_id")
            )
        )
    names = [
        xrefs(full, "disease", "disease_id", [(F.col("ontology_id"), "opentargets", F.col("disease_name"), True)])
    ]
    return Built(clean, registry, bad, names, came, ids_made)


def _gene_keys(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {
            "onto": ids.ontology_key(F.col("ontology_id")),
            "gene": ids.gene_key(F.col("ensembl_id")),
        }
    )


def strongest_genes(raw: DataFrame, k: int = GENES_PER_DISEASE) -> DataFrame:
    """The ``k`` strongest associations of every disease, with their place."""
    keyed = _gene_keys(raw)
    order = [F.col("association_score").desc_nulls_last(), F.col("gene"), F.col("ensembl_id")]
    return top_per_group(keyed, ["onto"], order, k, out="place")


def build_disease_genes(
    raw: DataFrame, disease_registry: DataFrame, ws: Workspace, genes_per_disease: int | None = None
) -> Built:
    """Every landed association, in the order of ``seq``; with ``genes_per_disease`` only the
    strongest of each disease."""
    if genes_per_disease is not None:
        raw = strongest_genes(raw, genes_per_disease).drop("place")
    else:
        raw = _gene_keys(raw)
    rows = raw.join(_by_key(disease_registry, "onto", "disease_id"), "onto", "left").withColumn(
        "reason",
        F.when(F.col("disease_id").isNull(), "disease_not_in_diseases").when(
            F.col("gene").isNull(), "unmappable_ensembl_id"
        ),
    )
    good = rows.filter("reason is null")
    came, ids_made = Observation(), Observation()
    seen = good.select(F.col("gene").alias("key"), "seq", ids.name_key(F.col("gene_symbol")).alias("name"))
    registry = mint(seen, "gene", ws, ids_made)
    # moved by the gene's key, one to one with its id, before the ids: the join and the choice among repeats need no other move or order
    moved = good.select("seq", "disease_id", "gene", "gene_symbol", "association_score").repartition("gene")
    full = moved.join(_by_key(registry, "gene", "gene_id"), "gene").select(
        "seq",
        "disease_id",
        "gene_id",
        F.nullif("gene_symbol", F.lit("")).alias("gene_name"),
        F.col("gene").alias("ensembl_id"),
        "association_score",
        F.lit("opentargets").alias("source"),
    )
    best = first_per_key(
        full, ["disease_id", "ensembl_id"], [F.col("association_score").desc_nulls_last(), F.col("seq")]
    )
    good_rows = split_valid(counted_rows(best, came), "disease_genes")[0]
    bad = split_valid(best, "disease_genes")[1]
    stage = "build:disease_genes"
    rejected = [
        rejections(
            rows.filter("reason is not null"),
            stage,
            F.col("reason"),
            F.when(F.col("reason") == "unmappable_ensembl_id", F.col("ensembl_id")).otherwise(F.col("ontology_id")),
        ),
        rejections(bad, stage, F.col("reason"), F.to_json(F.struct("disease_id", "gene_id"))),
    ]
    found = xrefs(names(registry), "gene", "internal_id", [(F.col("key"), "opentargets", F.col("name"), True)])
    return Built(to_contract(good_rows, "disease_genes"), registry.drop("named"), rejected, [found], came, ids_made)


# --- drug targets ------------------------------------------------------------------------
def target_rows(raw: DataFrame) -> DataFrame:
    columns = {
        "seq": F.col("seq"),
        "tcid": ids.chembl_key(F.col("target_chembl_id")),
        "target_name": F.nullif("target_name", F.lit("")),
        "target_type": F.nullif("target_type", F.lit("")),
        "uniprot_id": ids.protein_key(F.col("uniprot_id")),
    }
    return ids.worked_out(raw, columns).filter("tcid is not null")


def target_dimension(raw: DataFrame, ws: Workspace) -> Built:
    """Every target gets an id, used or not; the last duplicate gives the details."""
    rows = target_rows(raw)
    ids_made = Observation()
    registry = mint(rows.select(F.col("tcid").alias("key"), "seq"), "target", ws, ids_made)
    last = first_per_key(rows, ["tcid"], [F.col("seq").desc()])
    ids_of = _by_key(registry, "tcid", "target_id")
    dimension = last.join(ids_of, "tcid").select("tcid", "target_id", "target_name", "target_type", "uniprot_id")
    seen = rows.join(ids_of, "tcid")
    names = [
        xrefs(
            seen,
            "target",
            "target_id",
            [(F.col("tcid"), "chembl", F.col("target_name"), True), (F.col("uniprot_id"), "uniprot", None, False)],
        )
    ]
    return Built(dimension, registry, [], names, ids=ids_made)


def first_drug_per_chembl(raw_names: DataFrame, raw_map: DataFrame, drug_registry: DataFrame) -> DataFrame:
    """The drug that first claims a ChEMBL id."""
    claims = (
        drug_rows(raw_names)
        .filter("reason is null")
        .join(compound_map(raw_map), "cid")
        .join(_by_key(drug_registry, "cid", "drug_id"), "cid")
    )
    return (
        claims.groupBy("chembl_id")
        .agg(F.min(F.struct("seq", "drug_id")).alias("f"))
        .select(F.col("chembl_id").alias("mol"), F.col("f.drug_id").alias("drug_id"))
    )


def build_drug_targets(raw: DataFrame, claims: DataFrame, dimension: DataFrame, ws: Workspace) -> Built:
    """Mechanism rows are reduced to one per (molecule, target) before the two joins."""
    pairs = raw.select(
        "seq",
        F.col("chembl_id").alias("raw_mol"),
        F.col("target_chembl_id").alias("raw_target"),
        ids.chembl_key(F.col("chembl_id")).alias("mol"),
        ids.chembl_key(F.col("target_chembl_id")).alias("tcid"),
        F.nullif("action_type", F.lit("")).alias("action_type"),
    )
    pairs = pairs.groupBy("mol", "tcid").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("seq", "action_type", "raw_mol", "raw_target")).alias("f"),
    )
    pairs = pairs.select("mol", "tcid", "n", "f.*")
    joined = left_join_spread(left_join_spread(pairs, claims, "mol", "seq"), dimension, "tcid", "seq")
    known, described = F.col("drug_id").isNotNull(), F.col("target_id").isNotNull()
    # a raw id is told of only where it is rejected
    raw_ids = {"raw_mol": F.when(~known, F.col("raw_mol")), "raw_target": F.when(known & ~described, F.col("raw_target"))}
    joined = ws.store("mechanism_pairs", joined.withColumns(raw_ids).drop("mol", "tcid"))
    stage = "build:drug_targets"
    full = joined.filter(known & described).withColumn("source", F.lit("chembl"))
    rejected = [
        rejections(joined.filter(~known), stage, F.lit("drug_not_in_drugs"), F.col("raw_mol"), n=F.col("n")),
        rejections(
            joined.filter(known & ~described),
            stage,
            F.lit("target_details_unavailable"),
            F.col("raw_target"),
            n=F.col("n"),
        ),
        rejections(
            full.filter("n > 1"),
            stage,
            F.lit("duplicate_primary_key"),
            F.to_json(F.struct("drug_id", "target_id")),
            n=F.col("n") - 1,
        ),
    ]
    came = Observation()
    table = to_contract(counted_rows(full, came, F.col("n")), "drug_targets")
    return Built(table, claims, rejected, input=came)


# --- disease pathways (derived) -------------------------------------------------------
def gene_pathway_edges(raw: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """Distinct (gene, pathway). With ``genes(ensembl_id)`` only their edges are kept,
    before the distinct shuffles anything."""
    keys = {"ensembl_id": ids.gene_key(F.col("ensembl_id")), "reactome_id": ids.reactome_key(F.col("reactome_id"))}
    edges = ids.worked_out(raw, keys).dropna()
    if genes is not None:
        edges = edges.join(genes.select("ensembl_id").distinct(), "ensembl_id", "left_semi")
    return edges.distinct()


def pathway_names(raw: DataFrame) -> DataFrame:
    columns = {"seq": F.col("seq"), "reactome_id": ids.reactome_key(F.col("reactome_id")), "pathway_name": F.col("pathway_name")}
    return (
        ids.worked_out(raw, columns)
        .filter("reactome_id is not null")
        .groupBy("reactome_id")
        .agg(F.max_by("pathway_name", "seq").alias("pathway_name"))
    )


def pathway_support(genes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct genes and mean score per (disease, pathway), before the threshold.

    A gene occurs once per disease and an edge once per pathway, so the distinct
    gene count is a plain count.
    """
    return (
        genes.select("disease_id", "ensembl_id", "association_score")
        .join(edges, "ensembl_id")
        .groupBy("disease_id", "reactome_id")
        .agg(
            F.count("ensembl_id").cast("int").alias("gene_support_count"),
            tidy(F.avg("association_score"), 6).alias("association_score"),
        )
    )


def _accounting(minimum: int) -> list[Column]:
    low = F.col("gene_support_count") < minimum
    return [
        F.count(F.lit(1)).alias("n_candidate_pairs"),
        F.count_if(low).alias("n_dropped"),
        F.count_if(~low).alias("n_kept"),
    ]


def support_accounting(support: DataFrame, minimum: int = MIN_PATHWAY_GENES) -> DataFrame:
    return support.agg(*_accounting(minimum))


def accounted(support: DataFrame, seen: Observation, minimum: int = MIN_PATHWAY_GENES) -> DataFrame:
    """``support``; whoever writes it tells ``seen`` the same three numbers."""
    return support.observe(seen, *_accounting(minimum))


def build_disease_pathways(
    support: DataFrame, names: DataFrame, ws: Workspace, minimum: int = MIN_PATHWAY_GENES
) -> Built:
    pair = F.concat_ws("|", "disease_id", "reactome_id")
    kept = support.filter(F.col("gene_support_count") >= minimum).withColumn("seq", pair)
    came, ids_made = Observation(), Observation()
    registry = mint(kept.select(F.col("reactome_id").alias("key"), "seq"), "pathway", ws, ids_made)
    full = (
        kept.join(_by_key(registry, "reactome_id", "pathway_id"), "reactome_id")
        .join(names, "reactome_id", "left")
        .withColumn("pathway_name", F.coalesce(F.nullif("pathway_name", F.lit("")), F.lit("unknown pathway")))
        .withColumn("source", F.lit("derived:opentargets+reactome"))
    )
    low = support.filter(F.col("gene_support_count") < minimum).withColumn("seq", pair)
    rejected = [
        rejections(
            low,
            "build:disease_pathways",
            F.lit("below_min_gene_support"),
            F.to_json(F.struct("disease_id", "reactome_id")),
        )
    ]
    names_seen = [
        xrefs(full, "pathway", "pathway_id", [(F.col("reactome_id"), "reactome", F.col("pathway_name"), True)])
    ]
    table = to_contract(counted_rows(full, came), "disease_pathways")
    return Built(table, registry, rejected, names_seen, came, ids_made)
