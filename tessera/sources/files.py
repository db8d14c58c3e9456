"""Readers for landed source files and the typed table store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.constants import HUMAN, TABLES
from tessera.functions.ids import SPACE, no_blank, ontology_key, query_text, strip


class TablesNotBuilt(FileNotFoundError):
    """A stored table was asked for before it was built."""


# --- lines ---------------------------------------------------------------------------
def _file_order() -> Column:
    """Text that sorts like the lines of the files."""
    return F.format_string(
        "%s|%020d|%020d", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id(),
    )


def read_lines(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """(seq, value) per line; ``spread`` repartitions after an unsplittable file. Where there are
    files enough for all cores, nothing moves."""
    lines = spark.read.text(path).select(_file_order().alias("seq"), "value")
    few = spread and lines.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    return lines.repartition("seq") if few else lines


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str], spread: bool = False) -> DataFrame:
    """Headerless TSV, all text: blank lines and lines with too many fields are skipped,
    missing and empty fields are null."""
    parts = F.split("value", "\t", -1)
    lines = read_lines(spark, path, spread).filter((F.trim("value") != "") & (F.size(parts) <= len(columns)))
    return lines.select("seq", *[no_blank(F.get(parts, i)).alias(c) for i, c in enumerate(columns)])


def read_drug_names(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, ["stitch_id", "drug_name"]).na.drop(subset=["stitch_id"])


def read_side_effects(spark: SparkSession, path: str) -> DataFrame:
    """Gzip files arrive in one task and are spread before anything else happens.

    The columns stay raw; ``preferred_terms`` in the builder keeps the preferred rows."""
    columns = ["stitch_id", "stitch_stereo", "umls_label", "meddra_type", "umls_meddra", "side_effect_name"]
    return read_tsv(spark, path, columns, spread=True)


def read_pathway_names(spark: SparkSession, path: str, species: str = HUMAN) -> DataFrame:
    rows = read_tsv(spark, path, ["reactome_id", "pathway_name", "species"])
    return rows.filter(F.col("species") == species).select("seq", "reactome_id", "pathway_name")


_MEMBER = ["reactome_id", "url", "pathway_name", "evidence_code", "species"]


def read_gene_pathways(spark: SparkSession, path: str, species: str = HUMAN) -> DataFrame:
    rows = read_tsv(spark, path, ["ensembl_id", *_MEMBER])
    wanted = (F.col("species") == species) & F.col("ensembl_id").startswith("ENSG")
    return rows.filter(wanted).select("ensembl_id", "reactome_id", "pathway_name", "evidence_code")


def read_protein_pathways(spark: SparkSession, path: str, species: str = HUMAN) -> DataFrame:
    rows = read_tsv(spark, path, ["uniprot", *_MEMBER]).filter(F.col("species") == species)
    return (
        rows.filter("uniprot is not null and reactome_id is not null")
        .select(F.upper(strip(F.col("uniprot"))).alias("uniprot"), strip(F.col("reactome_id")).alias("reactome_id"), "pathway_name")
        .distinct()
    )


def read_gene_bridge(spark: SparkSession, path: str) -> DataFrame:
    """Wide TSV with a header; only the four bridge columns are used."""
    wanted = ["hgnc_id", "symbol", "ensembl_gene_id", "uniprot_ids"]
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    return rows.select(_file_order().alias("seq"), *wanted)


# --- JSON --------------------------------------------------------------------------------
_MECHANISM = "molecule_chembl_id string, target_chembl_id string, action_type string, mechanism_of_action string"
_TARGET = (
    "target_chembl_id string, pref_name string, target_type string, target_components array<struct<"
    "accession string, target_component_synonyms array<struct<syn_type string, component_synonym string>>>>"
)
_DISEASE = (
    "data struct<disease struct<id string, name string, associatedTargets struct<rows array<struct<"
    "score double, target struct<id string, approvedSymbol string, approvedName string>>>>, page int>>, _corrupt string"
)
_KNOWN = (
    "data struct<disease struct<id string, name string, drugAndClinicalCandidates struct<rows array<struct<"
    "drug struct<id string>, maxClinicalStage string>>>>>"
)


def _json(spark: SparkSession, path: str, schema: str, multiline: bool, **options: str) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", str(multiline).lower()).option("recursiveFileLookup", "true")
    return reader.options(**options).json(path)


def read_mechanisms(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    rows = _json(spark, path, _MECHANISM, multiline).select(
        _file_order().alias("seq"), F.col("molecule_chembl_id").alias("chembl_id"),
        "target_chembl_id", "action_type", "mechanism_of_action",
    )
    return rows.na.drop(subset=["chembl_id", "target_chembl_id"])


def read_targets(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """First non-empty accession over the components; first gene symbol among their synonyms."""
    parts = F.coalesce("target_components", F.array().cast("array<struct<accession string, target_component_synonyms array<struct<syn_type string, component_synonym string>>>>"))
    accession = F.get(F.filter(F.transform(parts, lambda p: p["accession"]), lambda a: F.coalesce(a, F.lit("")) != ""), 0)
    synonyms = F.flatten(F.filter(F.transform(parts, lambda p: p["target_component_synonyms"]), lambda s: s.isNotNull()))
    symbols = F.filter(
        synonyms, lambda s: (s["syn_type"] == "GENE_SYMBOL") & (F.coalesce(s["component_synonym"], F.lit("")) != "")
    )
    rows = _json(spark, path, _TARGET, multiline).select(
        _file_order().alias("seq"), "target_chembl_id", F.col("pref_name").alias("target_name"), "target_type",
        accession.alias("uniprot_id"), F.get(symbols, 0)["component_synonym"].alias("gene_symbol"),
    )
    return rows.na.drop(subset=["target_chembl_id"])


def read_compound_map(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects {compound: ChEMBL id}, one per line or file; an absent file gives no rows."""
    try:
        lines = spark.read.option("recursiveFileLookup", "true").text(path).select(_file_order().alias("seq"), "value")
    except AnalysisException:
        return spark.createDataFrame([], "seq string, pubchem_cid string, chembl_id string")
    return lines.select("seq", F.explode(F.from_json("value", "map<string,string>")).alias("pubchem_cid", "chembl_id"))


def first_chembl_synonym(compounds: DataFrame) -> DataFrame:
    """``(cid, synonyms)`` -> the first synonym per compound that is a ChEMBL id."""
    found = F.get(F.filter("synonyms", lambda s: s.startswith("CHEMBL")), 0)
    return compounds.select(F.col("cid").cast("string").alias("pubchem_cid"), found.alias("chembl_id")).na.drop()


def read_disease_payloads(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Payloads in file-name order; corrupt and null ones drop out. A disease may come in several
    payloads, numbered by ``page``, so that no row has to hold all of its associations."""
    rows = _json(spark, path, _DISEASE, multiline, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    return rows.filter("_corrupt is null and data.disease is not null").select(_file_order().alias("seq"), "data.disease.*")


def payload_diseases(payloads: DataFrame) -> DataFrame:
    return payloads.groupBy(F.col("id").alias("ontology_id"), F.col("name").alias("disease_name")).agg(F.min("seq").alias("seq"))


def payload_genes(payloads: DataFrame) -> DataFrame:
    rows = payloads.select(
        F.col("id").alias("ontology_id"), F.coalesce("page", F.lit(0)).alias("page"), F.posexplode("associatedTargets.rows").alias("p", "r")
    )
    at = lambda c: F.lpad(F.col(c).cast("string"), 11, "0")
    return rows.select(
        F.concat_ws("|", "ontology_id", at("page"), at("p")).alias("seq"),
        "ontology_id", F.col("r.target.id").alias("ensembl_id"), F.col("r.target.approvedSymbol").alias("gene_symbol"),
        F.col("r.target.approvedName").alias("gene_full_name"), F.col("r.score").alias("association_score"),
    )


def read_known_drugs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Clinical candidates, long: (ontology_id, chembl_id, max_stage); the last stage of a drug wins."""
    rows = _json(spark, path, _KNOWN, multiline).filter("data.disease is not null")
    long = rows.select(
        ontology_key(F.col("data.disease.id")).alias("ontology_id"),
        F.posexplode("data.disease.drugAndClinicalCandidates.rows").alias("p", "r"),
    ).filter(F.coalesce("r.drug.id", F.lit("")) != "")
    last = F.max(F.struct("p", F.col("r.maxClinicalStage").alias("stage")))
    return long.groupBy("ontology_id", F.col("r.drug.id").alias("chembl_id")).agg(last["stage"].alias("max_stage"))


# --- lists ------------------------------------------------------------------------------------
def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """First word of every line that is neither blank nor a comment, distinct by first sight."""
    lines = read_lines(spark, path).withColumn("value", strip(F.col("value")))
    kept = lines.filter(~F.col("value").rlike(r"^#") & (F.col("value") != ""))
    word = F.regexp_extract("value", rf"^[^{SPACE}]+", 0)
    return kept.groupBy(word.alias("ontology_id")).agg(F.min("seq").alias("seq"))


def read_alias_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, alias, ontology_id); comments and lines with fewer than two fields drop out."""
    lines = read_lines(spark, path).withColumn("value", strip(F.col("value")))
    parts = F.split("value", "\t")
    kept = lines.filter(~F.col("value").rlike(r"^#") & (F.size(parts) >= 2))
    return kept.select("seq", F.get(parts, 0).alias("alias"), F.get(parts, 1).alias("ontology_id"))


def alias_map(rows: DataFrame) -> DataFrame:
    keyed = rows.select("seq", query_text(F.col("alias")).alias("alias"), ontology_key(F.col("ontology_id")).alias("ontology"))
    last = F.max(F.struct("seq", "ontology"))
    return keyed.filter("alias <> '' and ontology is not null").groupBy("alias").agg(last["ontology"].alias("ontology"))


# --- table store ---------------------------------------------------------------------------------
CROSSWALK = "identifiers"
_CROSSWALK_SCHEMA = (
    "internal_id string, entity_type string, external_id string, external_source string, name string, is_primary boolean"
)


def table_schema(name: str) -> str:
    if name == CROSSWALK:
        return _CROSSWALK_SCHEMA
    return ", ".join(f"{c} {t}" for c, t, _ in TABLES[name])


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = f"{root}/{name}.parquet"
    try:
        return spark.read.schema(table_schema(name)).parquet(path)
    except AnalysisException as e:
        raise TablesNotBuilt(f"{path} not found, run the ingestion first") from e


def available_tables(spark: SparkSession, root: str) -> list[str]:
    found = []
    for name in [*TABLES, CROSSWALK]:
        try:
            load_table(spark, root, name)
            found.append(name)
        except TablesNotBuilt:
            pass
    return found


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Schema column order; parquet and a CSV copy."""
    for name, df in tables.items():
        ordered = df.select(*[c.split()[0] for c in table_schema(name).split(", ")])
        ordered.write.mode("overwrite").parquet(f"{root}/{name}.parquet")
        ordered.write.mode("overwrite").csv(f"{root}/{name}.csv", header=True)


def write_report(parts: dict[str, DataFrame], root: str) -> None:
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{root}/_reports/{name}")


# --- coverage ---------------------------------------------------------------------------------------
# fixed values: table -> (inputs it needs, note when one is missing)
NEEDS = {
    "drugs": (["sider"], "requires SIDER"),
    "drug_side_effects": (["sider", "drugs"], "requires SIDER+drugs"),
    "diseases": (["opentargets"], "requires Open Targets"),
    "disease_genes": (["opentargets"], "requires Open Targets"),
    "drug_targets": (["chembl", "drugs"], "requires ChEMBL+drugs"),
    "disease_pathways": (["reactome", "disease_genes"], "requires Reactome + disease_genes"),
}


def coverage(ready: Sequence[str]) -> list[tuple[str, bool, str]]:
    """(table, built, note): a table builds when its sources and parent tables do."""
    have, out = set(ready), []
    for table, (needs, note) in NEEDS.items():
        ok = all(n in have for n in needs)
        if ok:
            have.add(table)
        out.append((table, ok, "" if ok else note))
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").isEmpty()
    except AnalysisException:
        return False
