"""Places where less than the whole job was once done."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F
from test_twins import _rows

import __spark_entry__ as entry
from tessera.operators import profiles
from tessera.plans import catalog
from tessera.sources.given import TABLES

LARGER = "/root/testdata/sf0.01"
GIVEN = pytest.mark.skipif(not Path(LARGER).exists(), reason="given tables not present")


# --- profiles -------------------------------------------------------------------------
@GIVEN
@pytest.mark.parametrize("name", ["e9_molecular_summary", "e10_disease_profiles", "e17_disease_summaries", "p2_overview"])
def test_diseases_with_more_genes_than_the_old_cap(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{LARGER}/{t}.parquet'")
    got, cur = entry.queries()[name](spark, LARGER), con.execute(entry.oracle_sql()[name])
    want = [d[0] for d in cur.description]
    assert _rows(got.columns, got.collect()) == _rows(want, cur.fetchall())


def test_profile_keeps_all_genes_in_order(spark):
    diseases = spark.createDataFrame([("D", "d", "EFO_1", "s")], "disease_id string, disease_name string, ontology_id string, source string")
    rows = [("D", f"G{i:03}", None if i % 50 == 7 else f"N{i % 90:03}", f"E{i}", None if i % 40 == 3 else (i % 11) / 10, "s") for i in range(450)]
    rows.append(("D", "G999", "N", "E", float("nan"), "s"))
    genes = spark.createDataFrame(rows, "disease_id string, gene_id string, gene_name string, ensembl_id string, association_score double, source string")
    paths = spark.createDataFrame([], "disease_id string, pathway_id string, pathway_name string, reactome_id string, gene_support_count int, association_score double, source string")
    xref = spark.createDataFrame([], "internal_id string, entity_type string, external_id string, external_source string, is_primary boolean")
    order = [r["gene_id"] for r in genes.orderBy(*profiles._gene_order()).collect()]

    whole = profiles.disease_profiles(diseases, genes, paths, xref).first()
    assert [g["gene_id"] for g in whole["genes"]] == order
    assert whole["gene_count"] == 451 and "Associated genes (451" in whole["summary_text"]

    cut = profiles.disease_profiles(diseases, genes, paths, xref, genes_per_disease=50).first()
    assert [g["gene_id"] for g in cut["genes"]] == order[:50]
    assert cut["genes_truncated"] and "Associated genes (50, Level 1 cap reached)" in cut["summary_text"]


def test_drug_profile_keeps_all_pathways_when_asked(spark):
    drugs = spark.createDataFrame([("R", "r", None, "1", "s")], "drug_id string, drug_name string, chembl_id string, pubchem_cid string, source string")
    effects = spark.createDataFrame([], "drug_id string, side_effect_id string, side_effect_name string, umls_cui string, source string")
    targets = spark.createDataFrame([("R", "T", "t", "k", "P", None, "s")], "drug_id string, target_id string, target_name string, target_type string, uniprot_id string, action_type string, source string")
    by_drug = spark.createDataFrame([("R", f"H{i:03}", f"n{i // 2:03}", i % 3) for i in range(150)], "drug_id string, reactome_id string, pathway_name string, supporting_target_count long")
    facts = by_drug.select("drug_id", "reactome_id", F.lit("P").alias("uniprot_id"))
    xref = spark.createDataFrame([], "internal_id string, entity_type string, external_id string, external_source string, is_primary boolean")
    order = [r["reactome_id"] for r in by_drug.orderBy(F.desc("supporting_target_count"), "pathway_name", "reactome_id").collect()]
    for limit, n in ((None, 150), (7, 7)):
        r = profiles.drug_profiles(drugs, effects, targets, by_drug, facts, xref, limit).first()
        assert [(p["position"], p["reactome_id"]) for p in r["pathways"]] == list(enumerate(order[:n], 1))
        assert f"Target pathways ({n}," in r["summary_text"]


# --- sizes of a study -------------------------------------------------------------------
def test_reports_follow_the_sizes_of_their_study(spark, monkeypatch):
    ranked = spark.range(1, 31).select(F.lit("D").alias("disease_id"), F.concat(F.lit("R"), "id").alias("drug_id"), F.lit("n").alias("drug_name"),
                                       F.col("id").cast("int").alias("rank"), F.lit(1.0).alias("repurposing_score"))
    asked = spark.createDataFrame([(1, "resolved", "D")], "query_id int, status string, match_id string")
    s = SimpleNamespace(top_n=25, graph_top_n=8, ranked=ranked, top=ranked, pairs=ranked, resolved_diseases=asked, nodes=None, edges=None)
    assert catalog.p1_disease_runs(s).count() == 25
    assert catalog.p3_found_pairs(s).filter("found").count() == 25
    counts = F.create_map(F.lit("a"), F.lit("1"))
    monkeypatch.setattr(catalog.graph, "graph_metadata", lambda nodes, edges, top: top.withColumns({"node_type_counts": counts, "edge_type_counts": counts}))
    assert catalog.k7_graph_metadata(s).count() == 8
