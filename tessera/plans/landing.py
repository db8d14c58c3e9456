"""Source files derived from the given tables, in the shapes the readers expect.

Every file keeps some dirt: lines with too many fields, other species, comments,
broken payloads. Arrays of records are written in lines of at most a thousand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.constants import HUMAN
from tessera.operators.ordering import number_rows
from tessera.plans.study import Study

#: Associations in one payload of a disease.
PAGE_ROWS = 1000


def _tsv(*columns: Column | str) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.array_join(F.array(*[c.cast("string") for c in cols]), "\t", "")


def _lines(df: DataFrame, path: str, gzip: bool = False) -> str:
    writer = df.select(F.col("line").alias("value")).write.mode("overwrite")
    (writer.option("compression", "gzip") if gzip else writer).text(path)
    return path


def _arrays(df: DataFrame, seq: str, path: str) -> str:
    record = F.struct(*[c for c in df.columns if c != seq])
    chunk = F.floor(F.col(seq) / 1000)
    rows = df.groupBy(chunk).agg(F.to_json(F.collect_list(record)).alias("line"))
    return _lines(rows, path, gzip=True)


class Landing:
    """Writes each source file once, on first use."""

    def __init__(self, study: Study) -> None:
        self.s = study
        self.raw = study.raw
        self.root = study.ws.path("landed")
        self._paths: dict[str, str] = {}

    def path(self, name: str) -> str:
        if name not in self._paths:
            self._paths[name] = getattr(self, f"_{name}")(f"{self.root}/{name}")
        return self._paths[name]

    def _drug_names(self, p: str) -> str:
        r = self.raw["raw_drug_names"]
        extra = F.when(F.col("seq") % 70 == 0, F.lit("\textra")).otherwise(F.lit(""))
        return _lines(r.select(F.concat(_tsv("stitch_id", "drug_name"), extra).alias("line")), p)

    def _side_effects(self, p: str) -> str:
        r = self.raw["raw_side_effects"]
        return _lines(
            r.select(_tsv("stitch_id", F.lit("x"), "umls_label", "meddra_type", "umls_meddra", "side_effect_name").alias("line")),
            p, gzip=True,
        )

    def _species(self) -> Column:
        return F.when(F.col("reactome_id").endswith("3"), "Mus musculus").otherwise(HUMAN)

    def _pathway_names(self, p: str) -> str:
        r = self.raw["raw_pathway_names"]
        return _lines(r.select(_tsv("reactome_id", "pathway_name", self._species()).alias("line")), p)

    def _gene_pathways(self, p: str) -> str:
        r = self.raw["raw_gene_pathways"]
        key = F.when(F.length("pathway_name") % 2 == 0, F.lower("ensembl_id")).otherwise(F.col("ensembl_id"))
        return _lines(
            r.select(_tsv(key, "reactome_id", F.lit("u"), "pathway_name", F.lit("IEA"), self._species()).alias("line")), p
        )

    def _protein_pathways(self, p: str) -> str:
        r = self.raw["raw_gene_pathways"]
        return _lines(
            r.select(
                _tsv(F.concat(F.lit(" "), F.lower("uniprot")), "reactome_id", F.lit("u"), "pathway_name", F.lit("IEA"), self._species()).alias("line")
            ),
            p,
        )

    def _gene_bridge(self, p: str) -> str:
        r = self.raw["raw_gene_bridge"].withColumns({"status": F.lit("Approved"), "locus": F.lit("x")})
        wide = r.select("status", "hgnc_id", "symbol", "locus", "ensembl_gene_id", "uniprot_ids")
        wide.write.mode("overwrite").csv(p, sep="\t", header=True)
        return p

    def _mechanisms(self, p: str) -> str:
        r = self.raw["raw_mechanisms"]
        mol = F.when(F.col("seq") % 13 != 0, F.col("chembl_id"))
        d = r.select(
            "seq", mol.alias("molecule_chembl_id"), "target_chembl_id", "action_type",
            F.concat(F.lower("action_type"), F.lit(" mechanism")).alias("mechanism_of_action"), F.lit(1).alias("unused"),
        )
        return _arrays(d, "seq", p)

    def _targets(self, p: str) -> str:
        r = self.raw["raw_targets"]
        syn = F.array(
            F.struct(F.lit("UNIPROT").alias("syn_type"), F.col("target_name").alias("component_synonym")),
            F.struct(F.lit("GENE_SYMBOL").alias("syn_type"), F.concat(F.lit("SYM"), "seq").alias("component_synonym")),
        )
        empty = F.struct(F.lit("").alias("accession"), F.lit(None).cast(syn_type()).alias("target_component_synonyms"))
        full = F.struct(F.col("uniprot_id").alias("accession"), syn.alias("target_component_synonyms"))
        parts = F.when(F.col("seq") % 6 == 0, F.array(empty, full)).when(F.col("seq") % 6 != 5, F.array(full))
        d = r.select("seq", "target_chembl_id", F.col("target_name").alias("pref_name"), "target_type", parts.alias("target_components"))
        return _arrays(d, "seq", p)

    def _compound_map(self, p: str) -> str:
        r = self.raw["raw_chembl_map"]
        pair = F.map_from_arrays(F.array("pubchem_cid"), F.array("chembl_id"))
        return _lines(r.select(F.to_json(pair).alias("line")), p)

    def _diseases(self, p: str) -> str:
        target = F.struct(
            F.col("ensembl_id").alias("id"), F.col("gene_symbol").alias("approvedSymbol"),
            F.concat(F.lit("gene "), "gene_symbol").alias("approvedName"),
        )
        # pages of a bounded number of associations, cut where they lie in order
        placed = number_rows(self.s.landed_genes, [F.col("seq")], self.s.ws, "pages", group=["ontology_id"])
        page = F.floor((F.col("position") - 1) / PAGE_ROWS).cast("int")
        record = F.struct("position", F.struct(F.col("association_score").alias("score"), target.alias("target")).alias("r"))
        rows = placed.groupBy("ontology_id", page.alias("page")).agg(F.array_sort(F.collect_list(record)).alias("rs"))
        d = self.raw["raw_diseases"].join(rows, "ontology_id", "left")
        disease = F.struct(
            F.col("ontology_id").alias("id"), F.col("disease_name").alias("name"),
            F.struct(F.transform("rs", lambda s: s["r"]).alias("rows")).alias("associatedTargets"), "page",
        )
        good = F.to_json(F.struct(F.struct(disease.alias("disease")).alias("data")))
        line = F.when(F.col("seq") % 9 == 8, F.lit('{"data": {"disease": null}}')).when(
            F.col("seq") % 9 == 7, F.concat(F.lit('{"data": {"disease": '), "disease_name")
        ).otherwise(good)
        files = d.select(F.translate("ontology_id", ":", "_").alias("file"), line.alias("value"))
        files.write.mode("overwrite").option("compression", "gzip").partitionBy("file").text(p)
        return p

    def _known_drugs(self, p: str) -> str:
        k = self.raw["raw_known_pairs"]
        row = F.struct(F.struct(F.col("chembl_id").alias("id")).alias("drug"), F.concat(F.lit("PHASE"), F.length("chembl_id") % 4).alias("maxClinicalStage"))
        d = k.groupBy("ontology_id").agg(F.collect_list(row).alias("rows"))
        disease = F.struct(F.col("ontology_id").alias("id"), F.struct("rows").alias("drugAndClinicalCandidates"))
        d = d.select(F.col("ontology_id").alias("file"), F.to_json(F.struct(F.struct(disease.alias("disease")).alias("data"))).alias("value"))
        d.write.mode("overwrite").partitionBy("file").text(p)
        return p

    def _seeds(self, p: str) -> str:
        r = self.raw["raw_seeds"]
        note = F.when(F.col("seq") % 3 == 0, F.concat("ontology_id", F.lit("  wanted"))).otherwise(F.col("ontology_id"))
        lines = F.array(F.when(F.col("seq") % 4 == 0, F.lit("# comment")), F.when(F.col("seq") % 8 == 0, F.lit("   ")), note, F.when(F.col("seq") % 10 == 0, note))
        return _lines(r.select(F.explode(F.array_compact(lines)).alias("line")), p)

    def _aliases(self, p: str) -> str:
        r = self.raw["raw_aliases"].orderBy("seq")
        lines = F.array(F.when(F.col("seq") % 4 == 0, F.lit("# alias file")), F.when(F.col("seq") % 5 == 0, F.col("alias")), _tsv("alias", "ontology_id"))
        return _lines(r.select(F.explode(F.array_compact(lines)).alias("line")), p)


def syn_type() -> str:
    return "array<struct<syn_type:string,component_synonym:string>>"
