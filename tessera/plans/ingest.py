"""The full ingestion over landed files: read, build in dependency order, write, check, report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators import build, registry
from tessera.operators.conform import ledger
from tessera.operators.quality import quality_checks, row_counts, verdict
from tessera.plans import report
from tessera.plans.report import RunReport
from tessera.sources import files
from tessera.workspace import Workspace

# fixed values: source -> files that must be present
REQUIRED = {
    "sider": ["drug_names", "side_effects"],
    "chembl": ["mechanisms", "targets"],
    "opentargets": ["diseases"],
    "reactome": ["pathway_names", "gene_pathways"],
}


@dataclass
class Ingested:
    tables: dict[str, DataFrame]
    identifiers: DataFrame | None
    rejected: DataFrame | None
    coverage: DataFrame
    checks: DataFrame | None = None
    verdict: DataFrame | None = None
    counts: DataFrame | None = None
    report: RunReport | None = None
    registries: dict[str, DataFrame] = field(default_factory=dict)


def ready_sources(spark: SparkSession, paths: dict[str, str]) -> list[str]:
    return [
        s for s, names in REQUIRED.items()
        if all(n in paths and files.path_exists(spark, paths[n]) for n in names)
    ]


def build_all(
    spark: SparkSession,
    paths: dict[str, str],
    ws: Workspace,
    out: str | None = None,
    multiline: bool = True,
    genes_per_disease: int | None = None,
) -> Ingested:
    """``paths`` maps a file name of ``REQUIRED`` (plus ``compound_map``, ``seeds``) to where
    it landed. A table whose inputs are missing is skipped and reported; the rest build."""
    ready = ready_sources(spark, paths)
    plan = files.coverage(ready)
    builds = {t for t, ok, _ in plan if ok}
    made: dict[str, build.Built] = {}

    lost_seeds, support_counts = None, Observation()

    def keep(name: str, b: build.Built) -> build.Built:
        made[name] = build.keep(b, f"in_{name}", ws)
        return b

    no_map = spark.createDataFrame([], "seq string, pubchem_cid string, chembl_id string")
    if "drugs" in builds:
        names = files.read_drug_names(spark, paths["drug_names"])
        cmap = files.read_compound_map(spark, paths["compound_map"]) if "chembl" in ready and "compound_map" in paths else no_map
        drugs = keep("drugs", build.build_drugs(names, cmap, ws))
        raw = files.read_side_effects(spark, paths["side_effects"])
        keep("drug_side_effects", build.build_drug_side_effects(raw, drugs.registry, ws))
    if "diseases" in builds:
        payloads = files.read_disease_payloads(spark, paths["diseases"], multiline)
        seeds = files.read_seeds(spark, paths["seeds"]) if "seeds" in paths else None
        found = files.payload_diseases(payloads)
        diseases = keep("diseases", build.build_diseases(found, ws, seeds))
        lost_seeds = None if seeds is None else build.unresolved_seeds(seeds, found)
        genes = ws.store("in_genes", files.payload_genes(payloads))
        keep("disease_genes", build.build_disease_genes(genes, diseases.registry, ws, genes_per_disease))
    if "drug_targets" in builds:
        dimension = keep("targets", build.target_dimension(files.read_targets(spark, paths["targets"], multiline), ws))
        claims = build.first_drug_per_chembl(names, cmap, drugs.registry)
        mech = files.read_mechanisms(spark, paths["mechanisms"], multiline)
        keep("drug_targets", build.build_drug_targets(mech, claims, dimension.table, ws))
    if "disease_pathways" in builds:
        genes = made["disease_genes"].table
        edges = build.gene_pathway_edges(files.read_gene_pathways(spark, paths["gene_pathways"]), genes)
        support = ws.store("in_support", build.accounted(build.pathway_support(genes, edges), support_counts))
        titles = build.pathway_names(files.read_pathway_names(spark, paths["pathway_names"]))
        keep("disease_pathways", build.build_disease_pathways(support, titles, ws))

    tables = {t: made[t].table for t in files.NEEDS if t in made}
    seen = [o for b in made.values() for o in b.observations]
    lost = [r for b in made.values() for r in b.rejected]
    covered = spark.createDataFrame(plan, "table_name string, built boolean, note string")
    result = Ingested(tables, registry.crosswalk(seen) if seen else None, ledger(lost, ws) if lost else None, covered)
    result.registries = {n: b.registry for n, b in made.items()}
    stages = [*report.source_stages(ready), *report.build_stages(plan, made, support_counts)]
    ids = {entity: made[name].ids for entity, name in report.ENTITIES.items() if name in made}
    result.report = report.RunReport(spark, stages, {t: made[t] for t in tables}, ids, result.rejected, lost_seeds)
    if tables:
        result.identifiers = ws.store("in_identifiers", result.identifiers)
        result.counts = row_counts(tables)
        result.checks = ws.store("in_checks", quality_checks(tables))
        result.verdict = verdict(result.checks)
        if out:
            files.write_tables({**tables, files.CROSSWALK: result.identifiers}, out)
            files.write_report(
                {"coverage": covered, "rejections": result.rejected, "checks": result.checks,
                 "stages": result.report.stages(), "counts": result.report.counts(), "verdict": result.verdict.withColumn("finished_at", F.current_timestamp())},
                out,
            )
    return result
