"""Builds on small frames with known answers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import build, conform, quality, registry
from tessera.plans import ingest
from tessera.sources import files


@pytest.fixture
def frames(spark):
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    return {
        "names": df(
            [(0, "CID100000085", "Carnitine"), (1, "CID100000119", " GABA  drug "), (2, "CID000000085", "again"), (3, "bad", "x")],
            "seq int, stitch_id string, drug_name string",
        ),
        "map": df([(1, "85", "CHEMBL1"), (2, "85", "CHEMBL0"), (3, "119", "CHEMBL2")], "seq int, pubchem_cid string, chembl_id string"),
        "effects": df(
            [(0, "CID100000085", None, "C0000737", "PT", "Abdominal pain"), (1, "CID100000085", "C0000737", "X", "PT", "abdominal  PAIN"),
             (2, "CID100000119", "C0000729", None, "PT", "Cramp"), (3, "CID199999999", "C0000737", None, "PT", "Pain"),
             (4, "CID100000119", "C0000111", None, "LLT", "Low")],
            "seq int, stitch_id string, umls_meddra string, umls_label string, meddra_type string, side_effect_name string",
        ),
        "mech": df(
            [(0, "CHEMBL1", "CHEMBL2001", "INHIBITOR"), (1, "CHEMBL1", "CHEMBL2001", "AGONIST"), (2, "CHEMBL2", "CHEMBL2002", None), (3, "CHEMBL9", "CHEMBL2001", None)],
            "seq int, chembl_id string, target_chembl_id string, action_type string",
        ),
        "targets": df(
            [(0, "CHEMBL2001", "EGFR", "SINGLE PROTEIN", "P00533"), (1, "CHEMBL2002", "X", "COMPLEX", None)],
            "seq int, target_chembl_id string, target_name string, target_type string, uniprot_id string",
        ),
        "diseases": df([(0, "MONDO_1", "Glioma"), (1, "EFO_2", "Asthma")], "seq int, ontology_id string, disease_name string"),
        "seeds": df([(0, "MONDO:1"), (1, "EFO_2"), (2, "EFO_404")], "seq int, ontology_id string"),
        "genes": df(
            [("1|1", "MONDO_1", "ENSG1.3", "A", 0.2), ("1|2", "MONDO_1", "ENSG1", "A", 0.7), ("1|3", "MONDO_1", "ENSG2", "B", 0.5),
             ("1|4", "MONDO_1", "ENSG3", "C", None), ("2|1", "EFO_2", "ENSG1", "A", 0.1), ("9|1", "EFO_9", "ENSG1", "A", 0.9), ("2|2", "EFO_2", "LRG_1", "Z", 0.3)],
            "seq string, ontology_id string, ensembl_id string, gene_symbol string, association_score double",
        ),
        "edges": df([("ENSG1", "R-HSA-1"), ("ENSG2", "R-HSA-1"), ("ENSG3", "R-HSA-1"), ("ENSG1", "R-HSA-2"), ("ENSG1", "R-HSA-1")], "ensembl_id string, reactome_id string"),
        "titles": df([(1, "R-HSA-2", "Zother"), (2, "R-HSA-2", "Other")], "seq int, reactome_id string, pathway_name string"),
    }


def _built(f, ws):
    drugs = build.build_drugs(f["names"], f["map"], ws)
    effects = build.build_drug_side_effects(f["effects"], drugs.registry, ws)
    diseases = build.build_diseases(f["diseases"], ws, f["seeds"])
    genes = build.build_disease_genes(f["genes"], diseases.registry, ws, 200)
    dimension = build.target_dimension(f["targets"], ws)
    claims = build.first_drug_per_chembl(f["names"], f["map"], drugs.registry)
    links = build.build_drug_targets(f["mech"], claims, dimension.table, ws)
    support = build.pathway_support(genes.table, build.gene_pathway_edges(f["edges"]))
    paths = build.build_disease_pathways(support, build.pathway_names(f["titles"]), ws)
    return drugs, effects, diseases, genes, links, paths


def test_tables_and_ledger(spark, frames, ws):
    drugs, effects, diseases, genes, links, paths = _built(frames, ws)
    d = {r["drug_id"]: r for r in drugs.table.collect()}
    assert {k: (r["drug_name"], r["canonical_identifier"]) for k, r in d.items()} == {
        "DRUG:000001": ("carnitine", "CHEMBL1"), "DRUG:000002": ("gaba drug", "CHEMBL2"),
    }
    assert effects.table.count() == 2
    assert {(r["target_id"], r["action_type"]) for r in links.table.collect()} == {("TGT:000001", "INHIBITOR"), ("TGT:000002", None)}
    scores = {(r["disease_id"], r["ensembl_id"]): r["association_score"] for r in genes.table.collect()}
    assert scores == {("DIS:000001", "ENSG1"): 0.7, ("DIS:000001", "ENSG2"): 0.5, ("DIS:000001", "ENSG3"): None, ("DIS:000002", "ENSG1"): 0.1}
    p = paths.table.collect()
    assert [(r["disease_id"], r["pathway_name"], r["gene_support_count"], r["association_score"]) for r in p] == [("DIS:000001", "unknown pathway", 3, 0.6)]
    lost = [r for b in (drugs, effects, diseases, genes, links, paths) for r in b.rejected]
    counts = {(r["stage"], r["reason"]): r["n_rejected"] for r in conform.ledger(lost, ws).collect()}
    assert counts == {
        ("build:drugs", "unmappable_pubchem_cid"): 1, ("build:drugs", "duplicate_primary_key"): 1,
        ("build:drug_side_effects", "drug_not_in_drugs"): 1, ("build:drug_side_effects", "duplicate_primary_key"): 1,
        ("build:diseases", "seed_id_unresolved"): 1, ("build:disease_genes", "disease_not_in_diseases"): 1,
        ("build:disease_genes", "unmappable_ensembl_id"): 1, ("build:drug_targets", "drug_not_in_drugs"): 1,
        ("build:drug_targets", "duplicate_primary_key"): 1, ("build:disease_pathways", "below_min_gene_support"): 3,
    }


def test_quality_passes_and_fails(spark, frames, ws):
    drugs, effects, diseases, genes, links, paths = _built(frames, ws)
    tables = {"drugs": drugs.table, "diseases": diseases.table, "drug_targets": links.table,
              "drug_side_effects": effects.table, "disease_genes": genes.table, "disease_pathways": paths.table}
    assert quality.verdict(quality.quality_checks(tables)).first()["ok"]
    broken = {**tables, "drug_targets": links.table.unionByName(links.table).replace("DRUG:000001", "DRUG:9", "drug_id")}
    r = quality.verdict(quality.quality_checks(broken)).first()
    assert (r["ok"], r["n_hard_failures"]) == (False, 2)
    no_parent = {k: v for k, v in tables.items() if k != "drugs"}
    missing = {r["check_name"]: r["detail"] for r in quality.quality_checks(no_parent).collect() if not r["passed"]}
    assert missing["drug_targets.drug_id -> drugs"] == "drugs table missing"


def test_contract(spark):
    df = spark.createDataFrame([("D", "G", 1.5), ("D", "G", 0.5), ("D", "G", 0.1), (None, "G", 0.5)], "disease_id string, gene_id string, association_score double")
    df = df.selectExpr("*", "'s' as source", "cast(association_score * 10 as int) as seq")
    clean, rejected = conform.conform(df, "disease_genes")
    assert clean.columns == [c for c, _, _ in conform.TABLES["disease_genes"]]
    assert [r["association_score"] for r in clean.collect()] == [0.1]
    assert {r["reason"]: r["n"] for r in rejected.collect()} == {"schema_violation": 1, "missing_required_field": 1, "duplicate_primary_key": 1}


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_only_one_source_present(spark, tmp_path, ws):
    paths = {
        "drug_names": _write(tmp_path / "names.tsv", "CID100000085\tcarnitine\nCID100000119\tgaba\textra\n\n\tno id\n"),
        "side_effects": _write(tmp_path / "se.tsv", "CID100000085\tx\tC0000737\tPT\t\tPain\nCID100000085\tx\tC0000737\tLLT\t\tPain\n"),
    }
    done = ingest.build_all(spark, paths, ws, str(tmp_path / "out"))
    assert {n: t.count() for n, t in done.tables.items()} == {"drugs": 1, "drug_side_effects": 1}
    notes = {r["table_name"]: r["note"] for r in done.coverage.collect() if not r["built"]}
    assert notes["drug_targets"] == "requires ChEMBL+drugs" and set(notes) == {"diseases", "disease_genes", "drug_targets", "disease_pathways"}
    assert files.available_tables(spark, str(tmp_path / "out")) == ["drugs", "drug_side_effects", "identifiers"]
    with pytest.raises(files.TablesNotBuilt):
        files.load_table(spark, str(tmp_path / "out"), "diseases")


def test_json_readers(spark, tmp_path):
    target = {"target_chembl_id": "CHEMBL1", "pref_name": "E", "target_type": "T", "target_components": [
        {"accession": None, "target_component_synonyms": [{"syn_type": "UNIPROT", "component_synonym": "u"}]},
        {"accession": "P1", "target_component_synonyms": [{"syn_type": "GENE_SYMBOL", "component_synonym": "S1"}]},
        {"accession": "P2", "target_component_synonyms": [{"syn_type": "GENE_SYMBOL", "component_synonym": "S2"}]}]}
    p = _write(tmp_path / "targets.json", json.dumps([target, {"pref_name": "no id"}], indent=1))
    assert [(r["uniprot_id"], r["gene_symbol"]) for r in files.read_targets(spark, p).collect()] == [("P1", "S1")]
    m = _write(tmp_path / "mech.json", json.dumps([{"molecule_chembl_id": "C1", "target_chembl_id": "T1", "x": 1}, {"molecule_chembl_id": "C2"}]))
    assert [r["chembl_id"] for r in files.read_mechanisms(spark, m).collect()] == ["C1"]
    folder = tmp_path / "ot"
    _write(folder / "b.json", json.dumps({"data": {"disease": {"id": "B", "name": "b", "associatedTargets": {"rows": [{"score": 0.5, "target": {"id": "E1", "approvedSymbol": "S"}}]}}}}, indent=1))
    _write(folder / "a.json", json.dumps({"data": {"disease": {"id": "A", "name": "a"}}}))
    _write(folder / "c.json", "{broken")
    _write(folder / "d.json", json.dumps({"data": {"disease": None}}))
    payloads = files.read_disease_payloads(spark, str(folder))
    assert [r["ontology_id"] for r in files.payload_diseases(payloads).orderBy("seq").collect()] == ["A", "B"]
    assert [tuple(r)[1:4] for r in files.payload_genes(payloads).collect()] == [("B", "E1", "S")]
    assert files.read_compound_map(spark, str(tmp_path / "absent.json")).count() == 0


def test_lists(spark, tmp_path):
    seeds = _write(tmp_path / "seeds.tsv", "# head\n\nEFO_1 first\n  MONDO_2\nEFO_1\n")
    assert [r["ontology_id"] for r in files.read_seeds(spark, seeds).orderBy("seq").collect()] == ["EFO_1", "MONDO_2"]
    aliases = _write(tmp_path / "aliases.tsv", "# head\nGBM\tMONDO:1\nno tab\n gbm.\tmondo_2\n")
    assert [tuple(r) for r in files.alias_map(files.read_alias_lines(spark, aliases)).collect()] == [("gbm", "MONDO_2")]


def test_gene_rows_are_not_moved_by_their_disease(spark, frames, ws):
    diseases = build.build_diseases(frames["diseases"], ws)
    genes = build.build_disease_genes(frames["genes"].repartition(4), diseases.registry, ws)
    plan = genes.table._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(onto" not in plan and plan.count("BroadcastHashJoin") == 2
    assert genes.table.count() == 4


def test_gene_rows_are_not_moved_again_for_names_and_repeats(spark, frames, ws):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        named = frames["genes"].withColumn("gene_symbol", F.when(F.col("seq") != "1|1", F.concat(F.lit(" "), "gene_symbol", "seq")))
        diseases = build.build_diseases(frames["diseases"], ws)
        genes = build.build_disease_genes(named, diseases.registry, ws)
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(disease_id" not in plan(genes.table)
        found = genes.observations[0]
        assert "ontology_id" not in plan(found)
        rows = registry.crosswalk([found]).select("external_id", "name", "is_primary").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {tuple(r) for r in rows} == {("ENSG1", "a1|2", True), ("ENSG2", "b1|3", True), ("ENSG3", "c1|4", True)}
    assert genes.table.count() == 4
