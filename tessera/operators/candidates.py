"""Linking diseases to drugs through shared genes and shared pathways.

Match facts stay long, one row per reason. Nothing is gathered per pair until a
caller asks for the roll-ups of the pairs it will publish.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import no_blank, strip, worked_out
from tessera.operators.ordering import number_rows, split_join
from tessera.workspace import Workspace

PAIR = ["disease_id", "drug_id"]
#: The most codes in one list.
LIST = 1000


# --- bridge -------------------------------------------------------------------------
@dataclass
class Bridge:
    """Gene id and protein accession to a shared id, and the shared id's symbol."""

    genes: DataFrame  # ensembl_id, hgnc_id
    proteins: DataFrame  # uniprot_id, hgnc_id
    symbols: DataFrame  # hgnc_id, symbol


def bridge(raw: DataFrame) -> Bridge:
    """First row wins per gene and per protein, last row wins per symbol."""
    rows = raw.filter(F.coalesce("hgnc_id", F.lit("")) != "")

    def first(df: DataFrame, key: str) -> DataFrame:
        return (
            df.groupBy(key)
            .agg(F.min(F.struct("seq", "hgnc_id")).alias("f"))
            .select(key, F.col("f.hgnc_id").alias("hgnc_id"))
        )

    genes = rows.filter(F.col("ensembl_gene_id").startswith("ENSG")).select(
        "seq", "hgnc_id", F.upper(strip(F.col("ensembl_gene_id"))).alias("ensembl_id")
    )
    proteins = rows.select(
        "seq", "hgnc_id", F.explode(F.split("uniprot_ids", r"\|")).alias("p")
    ).select("seq", "hgnc_id", no_blank(F.upper(strip(F.col("p")))).alias("uniprot_id"))
    symbols = (
        rows.filter(F.coalesce("symbol", F.lit("")) != "")
        .groupBy("hgnc_id")
        .agg(F.max(F.struct("seq", "symbol")).alias("l"))
        .select("hgnc_id", F.col("l.symbol").alias("symbol"))
    )
    return Bridge(
        first(genes, "ensembl_id"), first(proteins.filter("uniprot_id is not null"), "uniprot_id"), symbols
    )


def bridged_genes(disease_genes: DataFrame, b: Bridge) -> DataFrame:
    """Disease genes with their shared id and symbol; the gene's own name is the fallback."""
    return (
        disease_genes.join(b.genes, "ensembl_id")
        .join(b.symbols, "hgnc_id", "left")
        .withColumn("gene_symbol", F.coalesce("symbol", "gene_name"))
        .drop("symbol")
    )


def bridged_targets(drug_targets: DataFrame, b: Bridge) -> DataFrame:
    keyed = drug_targets.filter("uniprot_id is not null").withColumn(
        "_acc", F.upper(strip(F.col("uniprot_id")))
    )
    return keyed.join(b.proteins.withColumnRenamed("uniprot_id", "_acc"), "_acc").drop("_acc")


def bridge_coverage(drug_targets: DataFrame, bridged: DataFrame) -> DataFrame:
    rows = drug_targets.agg(F.count("uniprot_id").alias("target_rows"))
    return rows.join(bridged.agg(F.count(F.lit(1)).alias("target_rows_bridged")))


# --- pathways of a drug --------------------------------------------------------------
def protein_pathways(raw: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Distinct (protein, pathway, name); rows with a missing side drop out. With
    ``targets(uniprot_id)`` only their proteins are kept, before the distinct."""
    columns = {
        "uniprot_id": no_blank(F.upper(strip(F.col("uniprot")))),
        "reactome_id": no_blank(strip(F.col("reactome_id"))),
        "pathway_name": F.col("pathway_name"),
    }
    rows = worked_out(raw, columns).filter("uniprot_id is not null and reactome_id is not null")
    if targets is not None:
        used = targets.select(F.upper("uniprot_id").alias("uniprot_id")).dropna().distinct()
        rows = rows.join(used, "uniprot_id", "left_semi")
    return rows.distinct()


def drug_protein_pathways(drug_targets: DataFrame, index: DataFrame) -> DataFrame:
    """(drug, protein, pathway, name) facts of the distinct proteins of every drug."""
    proteins = drug_targets.filter("uniprot_id is not null").select("drug_id", "uniprot_id").distinct()
    keyed = proteins.withColumn("_acc", F.upper("uniprot_id"))
    return keyed.join(index.withColumnRenamed("uniprot_id", "_acc"), "_acc").drop("_acc")


def drug_pathways(facts: DataFrame) -> DataFrame:
    """Every pathway of every drug with its support, uncapped. Facts are counted by name first,
    so that only the few names of a pathway are compared."""
    return _over_names(facts.groupBy("drug_id", "reactome_id", "pathway_name").agg(F.count(F.lit(1)).alias("n")))


def _over_names(named: DataFrame) -> DataFrame:
    return named.groupBy("drug_id", "reactome_id").agg(
        F.min("pathway_name").alias("pathway_name"),
        F.sum("n").cast("int").alias("supporting_target_count"),
    )


def protein_pathway_lists(index: DataFrame, codes: DataFrame) -> DataFrame:
    """(protein, _codes): the (pathway, name) codes of each protein as short lists."""
    return _listed(_same(index, codes, ["reactome_id", "pathway_name"]), ["uniprot_id"])


class DrugFacts:
    """The facts of ``drug_protein_pathways`` before they unfold: the pathways of a protein go to
    its drugs as a list, which unfolds where a drug's rows lie together."""

    def __init__(self, drug_targets: DataFrame, index: DataFrame, ws: Workspace) -> None:
        self.codes = _coded(index, ["reactome_id", "pathway_name"], ws, "pathway_codes")
        lists = ws.store("protein_pathway_lists", protein_pathway_lists(index, self.codes))
        self.rows = drug_protein_pathways(drug_targets, lists)

    def drug_pathways(self) -> DataFrame:
        """``drug_pathways`` of the facts."""
        rows = self.rows.select("drug_id", "_codes").repartition("drug_id")
        unfolded = rows.select("drug_id", F.explode("_codes").alias("_code"))
        return _over_names(unfolded.groupBy("drug_id", "_code").agg(F.count(F.lit(1)).alias("n")).join(self.codes, "_code"))

    def of(self, kept: DataFrame) -> DataFrame:
        """(drug, pathway, protein) facts of the given pathways of each drug, ``kept(drug_id, reactome_id)``."""
        known = self.codes.select("_code", "reactome_id")
        wanted = kept.select("drug_id", "reactome_id").join(known, "reactome_id").groupBy("drug_id").agg(F.collect_set("_code").alias("_wanted"))
        both = self.rows.join(wanted, "drug_id")
        found = both.select("drug_id", "uniprot_id", F.explode(F.array_intersect("_codes", "_wanted")).alias("_code"))
        return found.join(known, "_code").drop("_code")


def drug_pathways_of(drug_targets: DataFrame, index: DataFrame, ws: Workspace) -> DataFrame:
    """``drug_pathways`` of ``drug_protein_pathways``, worked out before the facts unfold."""
    return DrugFacts(drug_targets, index, ws).drug_pathways()


# --- match facts ------------------------------------------------------------------------
def gene_target_matches(genes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per (disease gene row, drug target row) that share an id."""
    g = genes.select(
        "hgnc_id",
        "disease_id",
        "gene_symbol",
        "association_score",
        F.col("gene_id").alias("disease_gene_id"),
        F.col("gene_name").alias("disease_gene_name"),
        F.col("ensembl_id").alias("disease_gene_ensembl_id"),
        F.coalesce("source", F.lit("opentargets")).alias("disease_gene_source"),
    )
    t = targets.select(
        "hgnc_id",
        "drug_id",
        F.col("target_id").alias("drug_target_id"),
        F.col("target_name").alias("drug_target_name"),
        F.col("uniprot_id").alias("drug_target_uniprot_id"),
        F.col("action_type").alias("drug_action_type"),
        F.coalesce("source", F.lit("chembl")).alias("drug_target_source"),
    )
    return split_join(g, t, "hgnc_id")


def gene_matches_of(pairs: DataFrame, genes: DataFrame, targets: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """The same facts for given pairs only, starting from the pairs. With a workspace the targets,
    ids and genes of the pairs are written: Spark knows then how few they are, and leaves the
    other genes and targets where they lie."""
    kept = (lambda name, df: df) if ws is None else ws.store
    asked = pairs.select(*PAIR).distinct()
    t = kept("asked_targets", targets.join(asked.select("drug_id").distinct(), "drug_id", "left_semi"))
    links = asked.join(t.select("drug_id", "hgnc_id").distinct(), "drug_id").select("disease_id", "hgnc_id").distinct()
    g = kept("asked_genes", genes.join(kept("asked_links", links), ["disease_id", "hgnc_id"], "left_semi"))
    matches = gene_target_matches(g, t)
    return matches.join(asked, PAIR, "left_semi").select(*matches.columns)


def _pathway_sides(disease_pathways: DataFrame, by_drug: DataFrame) -> tuple[DataFrame, DataFrame]:
    d = disease_pathways.filter("reactome_id is not null").select(
        "reactome_id",
        "disease_id",
        F.col("pathway_id").alias("disease_pathway_id"),
        F.col("pathway_name").alias("_name"),
        F.coalesce("source", F.lit("derived:opentargets+reactome")).alias("disease_pathway_source"),
        F.col("gene_support_count").alias("disease_gene_support_count"),
    )
    p = by_drug.select(
        "reactome_id",
        "drug_id",
        F.col("pathway_name").alias("_drug_name"),
        F.col("supporting_target_count").alias("drug_supporting_target_count"),
    )
    return d, p


def _named(matches: DataFrame) -> DataFrame:
    return matches.withColumn("pathway_name", F.coalesce("_name", "_drug_name")).drop("_name", "_drug_name")


def pathway_matches(disease_pathways: DataFrame, by_drug: DataFrame) -> DataFrame:
    """One row per (disease pathway, drug) that share a pathway id, with both supports.

    The drugs are spread before they meet the pathways of the diseases, by far the smaller
    side: where Spark broadcasts that one, whatever is counted or gathered per pair
    afterwards finds the matches of a drug together and moves none of them."""
    d, p = _pathway_sides(disease_pathways, by_drug)
    return _named(p.repartition("drug_id").join(d, "reactome_id"))


def pathway_matches_of(pairs: DataFrame, disease_pathways: DataFrame, by_drug: DataFrame) -> DataFrame:
    """The same facts for given pairs only: start from the pairs, not from the pathways,
    so that a pathway shared by many drugs costs nothing for the pairs left out."""
    d, p = _pathway_sides(disease_pathways, by_drug)
    return _named(pairs.select(*PAIR).join(p, "drug_id").join(d, ["disease_id", "reactome_id"]))


# --- pairs -----------------------------------------------------------------------------
def gene_pair_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy(*PAIR).agg(
        F.count(F.lit(1)).cast("int").alias("gene_target_reason_count"),
        F.count_distinct("hgnc_id").cast("int").alias("matched_gene_target_count"),
        F.count_distinct("disease_gene_id").cast("int").alias("matched_disease_gene_count"),
        F.count_distinct("drug_target_id").cast("int").alias("matched_drug_target_count"),
    )


def _by_shared_id(rows: DataFrame, entity: str, item: str, name: str, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """``rows(hgnc_id, entity, item)`` -> per (entity, shared id) its rows and the items that are
    found under that id alone; and the distinct (entity, shared id, item) of all other items."""
    key = [entity, item]
    rows = rows.select("hgnc_id", *key).filter("hgnc_id is not null")
    each = ws.store(f"shared{name}", rows.groupBy(*key, "hgnc_id").agg(F.count(F.lit(1)).alias("n")))
    several = each.filter(F.col(item).isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("_ids")).filter("_ids > 1")
    several = ws.store(f"several{name}", several.select(*[F.col(c).alias(f"_{c}") for c in key]))
    same = F.col(entity).eqNullSafe(F.col(f"_{entity}")) & (F.col(item) == F.col(f"_{item}"))
    marked = each.join(several.withColumn("_again", F.lit(True)), same, "left")
    alone = (F.col(item).isNotNull() & F.col("_again").isNull()).cast("long")
    sums = marked.groupBy("hgnc_id", entity).agg(F.sum("n").alias(f"{name}_rows"), F.sum(alone).alias(name))
    return ws.store(f"sums{name}", sums), each.join(several, same, "left_semi").select("hgnc_id", *key)


def _coded(rows: DataFrame, columns: list[str], ws: Workspace, name: str) -> DataFrame:
    """(columns, _code): a short number for each distinct combination, null like any value."""
    codes = number_rows(rows.select(*columns).distinct(), [F.col(c) for c in columns], ws, name, out="_code")
    return ws.store(name, codes.select(*columns, F.col("_code").cast("int").alias("_code")))


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Inner join that takes null for a value."""
    kept = right.withColumnsRenamed({c: f"_as_{c}" for c in columns})
    met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_as_{c}")) for c in columns])
    return left.join(kept, met).drop(*[f"_as_{c}" for c in columns])


def _listed(rows: DataFrame, key: list[str]) -> DataFrame:
    """The codes of every key as lists; a list holds codes of one range of ``LIST`` numbers, so
    that none grows with its key."""
    cut = rows.withColumn("_cut", F.floor(F.col("_code") / LIST))
    return cut.groupBy(*key, "_cut").agg(F.collect_list("_code").alias("_codes")).drop("_cut")


def gene_pair_counts_of(genes: DataFrame, targets: DataFrame, ws: Workspace) -> DataFrame:
    """``gene_pair_counts`` of ``gene_target_matches``, worked out before the matches unfold.

    Each side is reduced to one row per shared id, so a pair meets once per shared id and its
    counts are sums. The diseases of a shared id meet its drugs as one list of short numbers,
    which unfolds where the rows of a drug lie together: what is shuffled grows with the target
    rows, not with the pairs of each shared id. A gene or target found under several shared ids of
    its disease or drug must not count twice for a pair; those few are made distinct by pair and
    added as rows of their own."""
    g, genes_again = _by_shared_id(genes.withColumnRenamed("gene_id", "disease_gene_id"), "disease_id", "disease_gene_id", "_genes", ws)
    t, targets_again = _by_shared_id(targets.withColumnRenamed("target_id", "drug_target_id"), "drug_id", "drug_target_id", "_targets", ws)
    diseases = _coded(genes, ["disease_id"], ws, "disease_codes")
    lists = ws.store("lists_genes", _listed(_same(g, diseases, ["disease_id"]), ["hgnc_id", "_genes_rows", "_genes"]))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    met = split_join(lists, t, "hgnc_id").select(
        "drug_id", "_codes", (F.col("_genes_rows") * F.col("_targets_rows")).alias("_reasons"), one.alias("_ids"), "_genes", "_targets"
    )
    links = lists.select("hgnc_id", F.explode("_codes").alias("_code"))
    more_genes = _same(genes_again, diseases, ["disease_id"]).join(t.select("hgnc_id", "drug_id"), "hgnc_id")
    more_targets = targets_again.join(links, "hgnc_id")
    for more, item, genes_more, targets_more in ((more_genes, "disease_gene_id", one, zero), (more_targets, "drug_target_id", zero, one)):
        more = more.select("drug_id", "_code", item).distinct()
        met = met.unionByName(
            more.select(
                "drug_id", F.array("_code").alias("_codes"), zero.alias("_reasons"), zero.alias("_ids"),
                genes_more.alias("_genes"), targets_more.alias("_targets"),
            )
        )
    unfolded = met.repartition("drug_id").withColumn("_code", F.explode("_codes"))
    counts = unfolded.groupBy("drug_id", "_code").agg(
        F.sum("_reasons").cast("int").alias("gene_target_reason_count"),
        F.sum("_ids").cast("int").alias("matched_gene_target_count"),
        F.sum("_genes").cast("int").alias("matched_disease_gene_count"),
        F.sum("_targets").cast("int").alias("matched_drug_target_count"),
    )
    return counts.join(diseases, "_code").drop("_code").select(*PAIR, *[c for c in counts.columns if c.endswith("_count")])


def pathway_pair_counts(matches: DataFrame) -> DataFrame:
    """Pathway ids are unique per disease and per drug, so rows are distinct ids."""
    return matches.groupBy(*PAIR).agg(F.count(F.lit(1)).cast("int").alias("pathway_reason_count"))


def candidate_pairs(by_gene: DataFrame, by_pathway: DataFrame) -> DataFrame:
    """All pairs of either route with the counts of both; both inputs are already
    partitioned by the pair, so the outer join adds no shuffle."""
    zero = ["gene_target_reason_count", "matched_gene_target_count", "matched_disease_gene_count",
            "matched_drug_target_count", "pathway_reason_count"]
    both = by_gene.join(by_pathway, PAIR, "full_outer").fillna(0, zero)
    return both.withColumns(
        {
            "generated_by_gene_target": F.col("gene_target_reason_count") > 0,
            "generated_by_pathway": F.col("pathway_reason_count") > 0,
        }
    )


def route_pairs(matches: DataFrame) -> DataFrame:
    return matches.select(*PAIR).distinct()


def route_counts(pairs: DataFrame, diseases: DataFrame, drugs: DataFrame) -> DataFrame:
    """Set algebra of the two routes per disease; diseases without candidates count zero."""
    g, p = F.col("generated_by_gene_target"), F.col("generated_by_pathway")
    counts = pairs.groupBy("disease_id").agg(
        F.count_if(g).alias("gene_target"),
        F.count_if(p).alias("pathway"),
        F.count_if(g & ~p).alias("gene_target_only"),
        F.count_if(p & ~g).alias("pathway_only"),
        F.count_if(g & p).alias("both"),
        F.count(F.lit(1)).alias("candidates"),
    )
    universe = drugs.agg(F.count(F.lit(1)).alias("universe"))
    return (
        diseases.select("disease_id").join(counts, "disease_id", "left").fillna(0).join(universe)
    )


def rollups(gene: DataFrame, pathway: DataFrame) -> DataFrame:
    """Distinct sorted ids per pair. A pair holds at most the genes of one disease and
    the pathways of one drug. A match stays one row, with a column for each kind of id."""
    kinds = {
        "matched_gene_hgnc_ids": "hgnc_id", "matched_gene_symbols": "gene_symbol", "matched_disease_gene_ids": "disease_gene_id",
        "matched_drug_target_ids": "drug_target_id", "matched_pathway_reactome_ids": "reactome_id",
    }

    def ids(df: DataFrame) -> DataFrame:
        values = [(F.nullif(c, F.lit("")) if c in df.columns else F.lit(None).cast("string")).alias(k) for k, c in kinds.items()]
        return df.select(*PAIR, *values).filter(F.coalesce(*kinds).isNotNull())

    facts = ids(gene.drop("reactome_id")).unionByName(ids(pathway.select(*PAIR, "reactome_id")))
    out = facts.groupBy(*PAIR).agg(*[F.sort_array(F.collect_set(k)).alias(k) for k in kinds])
    methods = F.filter(
        F.array(
            F.when(F.size("matched_gene_hgnc_ids") > 0, "gene_target"),
            F.when(F.size("matched_pathway_reactome_ids") > 0, "pathway"),
        ),
        lambda m: m.isNotNull(),
    )
    return out.withColumn("generation_methods", methods)


def route_provenance(
    gene_bridge_reason: str | None, pathway_reason: str | None, spark
) -> DataFrame:
    """Which routes ran and why one did not."""
    rows = [
        ("gene_target", gene_bridge_reason is None, gene_bridge_reason),
        ("pathway", pathway_reason is None, pathway_reason),
    ]
    return spark.createDataFrame(rows, "route string, available boolean, unavailable_reason string")


def empty_gene_matches(genes: DataFrame, targets: DataFrame) -> DataFrame:
    """The gene route without a bridge: no matches, same columns."""
    h = F.lit(None).cast("string")
    return gene_target_matches(
        genes.withColumns({"hgnc_id": h, "gene_symbol": F.col("gene_name")}), targets.withColumn("hgnc_id", h)
    )
