"""Candidates, features, fusion, ranking, narratives and graphs on worked examples."""

from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import candidates, features, fusion, graph, narrative, profiles, ranking, resolve
from tessera.workspace import Workspace


@pytest.fixture(scope="module")
def stage(spark, tmp_path_factory):
    return Workspace(spark, "stage", root=str(tmp_path_factory.mktemp("stage")))


@pytest.fixture(scope="module")
def world(spark, stage):
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    diseases = df([("DIS:1", "glioma", "MONDO_1", "ot"), ("DIS:2", "empty", "MONDO_2", "ot")], "disease_id string, disease_name string, ontology_id string, source string")
    genes = df([("DIS:1", "GENE:1", "EGFR", "ENSG1", 0.9, "ot"), ("DIS:1", "GENE:2", "TP53", "ENSG2", 0.8, "ot")],
               "disease_id string, gene_id string, gene_name string, ensembl_id string, association_score double, source string")
    paths = df([("DIS:1", "PATH:1", "Signal", "R-HSA-1", 5, 0.5, "d"), ("DIS:1", "PATH:2", "Repair", "R-HSA-2", 3, 0.4, "d")],
               "disease_id string, pathway_id string, pathway_name string, reactome_id string, gene_support_count int, association_score double, source string")
    drugs = df([(f"DRUG:{i}", n, c) for i, n, c in ((1, "erlotinib", "CHEMBL1"), (2, "plain", None), (3, "other", "CHEMBL3"))],
               "drug_id string, drug_name string, chembl_id string")
    effects = df([("DRUG:1", "SE:1", "rash"), ("DRUG:1", "SE:2", "nausea")], "drug_id string, side_effect_id string, side_effect_name string")
    targets = df([("DRUG:1", "TGT:1", "EGFR kinase", "SINGLE PROTEIN", "P00533", "INHIBITOR", "chembl"), ("DRUG:3", "TGT:2", None, None, None, " ", "chembl")],
                 "drug_id string, target_id string, target_name string, target_type string, uniprot_id string, action_type string, source string")
    bridge = candidates.Bridge(
        df([("ENSG1", "HGNC:1"), ("ENSG2", "HGNC:2")], "ensembl_id string, hgnc_id string"),
        df([("P00533", "HGNC:1")], "uniprot_id string, hgnc_id string"),
        df([("HGNC:1", "EGFR")], "hgnc_id string, symbol string"),
    )
    index = df([("P00533", "R-HSA-1", "Signal")], "uniprot_id string, reactome_id string, pathway_name string")
    bg, bt = candidates.bridged_genes(genes, bridge), candidates.bridged_targets(targets, bridge)
    dp = candidates.drug_pathways(candidates.drug_protein_pathways(targets, index))
    gm, pm = candidates.gene_target_matches(bg, bt), candidates.pathway_matches(paths, dp)
    pairs = candidates.candidate_pairs(candidates.gene_pair_counts(gm), candidates.pathway_pair_counts(pm))
    feats = features.features(pairs, features.disease_dimension(diseases, genes, bg, paths), features.drug_dimension(drugs, effects, targets, bt, dp))
    gm, pm, pairs, feats = (stage.store(n, d) for n, d in (("gm", gm), ("pm", pm), ("pairs", pairs), ("feats", feats)))
    return {"diseases": diseases, "drugs": drugs, "genes": genes, "paths": paths, "targets": targets, "gm": gm, "pm": pm, "pairs": pairs, "features": feats, "dp": dp, "effects": effects}


def test_one_candidate_by_both_routes(world):
    r = world["pairs"].collect()
    assert [(x["disease_id"], x["drug_id"], x["gene_target_reason_count"], x["pathway_reason_count"]) for x in r] == [("DIS:1", "DRUG:1", 1, 1)]
    c = {x["disease_id"]: x.asDict() for x in candidates.route_counts(world["pairs"], world["diseases"], world["drugs"]).collect()}
    assert (c["DIS:1"]["both"], c["DIS:1"]["universe"], c["DIS:2"]["candidates"]) == (1, 3, 0)
    u = candidates.rollups(world["gm"], world["pm"]).first()
    assert (u["matched_gene_hgnc_ids"], u["matched_pathway_reactome_ids"], u["generation_methods"]) == (["HGNC:1"], ["R-HSA-1"], ["gene_target", "pathway"])
    assert candidates.pathway_matches_of(world["pairs"], world["paths"], world["dp"]).select("reactome_id").first()[0] == "R-HSA-1"


def test_feature_values(world):
    f = world["features"].first()
    assert f["fraction_of_drug_targets_matching_disease_genes"] == 1.0
    assert f["fraction_of_disease_genes_targeted_by_drug"] == 0.5
    assert f["fraction_of_drug_pathways_matching_disease_pathways"] == 1.0
    assert f["fraction_of_disease_pathways_matching_drug_pathways"] == 0.5
    assert (f["side_effect_count"], f["inhibitor_target_count"], f["mechanism_count"], f["generation_method_count"]) == (2, 1, 1, 2)
    assert f["target_action_type_counts"] == {"INHIBITOR": 1}


def test_without_a_bridge_ratios_are_null(world):
    none = candidates.empty_gene_matches(world["genes"], world["targets"])
    pairs = candidates.candidate_pairs(candidates.gene_pair_counts(none), candidates.pathway_pair_counts(world["pm"]))
    dim = features.disease_dimension(world["diseases"], world["genes"], None, world["paths"])
    drug = features.drug_dimension(world["drugs"], world["effects"], world["targets"], None, world["dp"])
    f = fusion.fuse(features.features(pairs, dim, drug, bridge_available=False)).first()
    assert f["fraction_of_drug_targets_matching_disease_genes"] is None and f["gene_target_reason"] == "HGNC bridge unavailable"
    assert (f["pathway_effective_weight"], f["weights_renormalized"]) == (1.0, True)


# --- fusion -------------------------------------------------------------------------------
BASE = {
    "disease_id": "DIS:1", "drug_id": "DRUG:1", "has_gene_target_bridge": True, "drug_target_hgnc_mapped_count": 4, "disease_gene_hgnc_mapped_count": 9,
    "matched_gene_target_count": 2, "fraction_of_drug_targets_matching_disease_genes": 0.5, "has_reactome_pathway_evidence": True,
    "disease_pathways_available": True, "drug_pathway_count": 12, "matched_pathway_count": 5, "fraction_of_drug_pathways_matching_disease_pathways": 0.4,
}
SCHEMA = (
    "disease_id string, drug_id string, has_gene_target_bridge boolean, drug_target_hgnc_mapped_count int, disease_gene_hgnc_mapped_count int, matched_gene_target_count int,"
    "fraction_of_drug_targets_matching_disease_genes double, has_reactome_pathway_evidence boolean, disease_pathways_available boolean, drug_pathway_count int,"
    "matched_pathway_count int, fraction_of_drug_pathways_matching_disease_pathways double"
)


def fused(spark, changes=(), output=None, **kw):
    row = {**BASE, **dict(changes)}
    feats = spark.createDataFrame([tuple(row.values())], SCHEMA)
    preds = None
    if output is not None:
        preds = spark.createDataFrame([("DIS:1", "DRUG:1", output, 0.1, "m", ["a"])], "disease_id string, drug_id string, model_output double, baseline_output double, model_name string, top_feature_names array<string>")
    return fusion.fuse(feats, preds, **kw).first()


def test_component_values_and_renormalised_weights(spark):
    f = fused(spark)
    assert (f["gene_target_value"], f["pathway_value"], f["ml_value"]) == (0.45, 0.45, None)
    assert f["gene_target_effective_weight"] == pytest.approx(0.45 / 0.70, abs=1e-6)
    assert f["repurposing_score"] == 45.0 and f["weights_renormalized"]


def test_extremes_and_missing_evidence(spark):
    full = {"matched_gene_target_count": 50, "fraction_of_drug_targets_matching_disease_genes": 1.0, "matched_pathway_count": 99, "fraction_of_drug_pathways_matching_disease_pathways": 1.0}
    assert fused(spark, full, 1.0)["repurposing_score"] == 100.0
    nothing = {"matched_gene_target_count": 0, "fraction_of_drug_targets_matching_disease_genes": 0.0, "matched_pathway_count": 0, "fraction_of_drug_pathways_matching_disease_pathways": 0.0}
    assert fused(spark, nothing, 0.0)["repurposing_score"] == 0.0
    gone = {"drug_target_hgnc_mapped_count": 0, "drug_pathway_count": 0, "has_reactome_pathway_evidence": False}
    f = fused(spark, gone)
    assert (f["repurposing_score"], f["n_components_available"], f["weights_renormalized"]) == (0.0, 0, False)
    assert fused(spark, {}, float("nan"))["ml_value"] == 0.0 and fused(spark, {}, 7.0)["ml_value"] == 1.0


def test_invalid_schemes_drop_out(spark):
    cols = "scheme string, gene_target_weight double, pathway_weight double, ml_weight double, gene_target_cap int, pathway_cap int, count_share double, specificity_share double"
    good = ("good", 1.0, 1.0, 1.0, 1, 1, 0.25, 0.75)
    bad = [("w", 0.0, 1.0, 1.0, 1, 1, 0.5, 0.5), ("inf", float("inf"), 1.0, 1.0, 1, 1, 0.5, 0.5), ("cap", 1.0, 1.0, 1.0, 0, 1, 0.5, 0.5), ("sum", 1.0, 1.0, 1.0, 1, 1, 0.5, 0.6)]
    f = fused(spark, schemes=spark.createDataFrame([good, *bad], cols))
    assert f["scheme"] == "good" and f["gene_target_value"] == pytest.approx(0.25 + 0.75 * 0.5)


# --- ranking ---------------------------------------------------------------------------------
def test_rank_order_ties_and_top_n(spark, ws):
    rows = [("A", f"DRUG:{i:03d}", float(s)) for i, s in enumerate([5, 9, 9, 1, 5])] + [("B", "DRUG:009", 3.0)]
    df = spark.createDataFrame(rows, "disease_id string, drug_id string, repurposing_score double")
    full = {(r["disease_id"], r["drug_id"]): r["rank"] for r in ranking.rank(df, ws).collect()}
    assert full == {("A", "DRUG:001"): 1, ("A", "DRUG:002"): 2, ("A", "DRUG:000"): 3, ("A", "DRUG:004"): 4, ("A", "DRUG:003"): 5, ("B", "DRUG:009"): 1}
    assert {(r["disease_id"], r["drug_id"]): r["rank"] for r in ranking.top_n(df, 2).collect()} == {k: v for k, v in full.items() if v <= 2}
    assert ranking.duplicate_pairs(df.unionByName(df.limit(1))).count() == 1
    for wrong in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            ranking.top_n(df, wrong)


# --- narratives ------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def ranked(spark, world, stage):
    f = fusion.fuse(world["features"]).withColumn("rank", F.lit(1))
    return stage.store("ranked", narrative.with_rollups(f, candidates.rollups(world["gm"], world["pm"])))


def _answer(**changes):
    body = {"disease_id": "DIS:1", "drug_id": "DRUG:1", "rank": 1, "repurposing_score": None, "summary": "words on HGNC:1", "evidence_notes": {"gene_target": "note"}, "limitations": ["few"]}
    return {**body, **changes}


@pytest.mark.parametrize(
    ("change", "failure"),
    [
        ({}, None),
        ({"rank": "1"}, None),
        ({"rank": 1.9}, None),
        ({"evidence_notes": None}, None),
        ({"evidence_notes": []}, None),
        ({"disease_id": "DIS:9"}, "response disease_id does not match the input candidate"),
        ({"drug_id": 5}, "response drug_id does not match the input candidate"),
        ({"rank": 2}, "response rank does not match the input candidate"),
        ({"rank": "1.5"}, "response rank was not an integer"),
        ({"rank": None}, "response rank was not an integer"),
        ({"repurposing_score": [1]}, "response repurposing_score was not a number"),
        ({"repurposing_score": 1e9}, "response repurposing_score does not match the input candidate"),
        ({"repurposing_score": "nan"}, "response repurposing_score does not match the input candidate"),
        ({"summary": " \n"}, "response summary was empty or not a string"),
        ({"summary": 5}, "response summary was empty or not a string"),
        ({"limitations": "x"}, "response limitations was not a list of strings"),
        ({"limitations": ["x", 1]}, "response limitations was not a list of strings"),
        ({"evidence_notes": [1]}, "response evidence_notes was not an object"),
        ({"summary": "it is safe and effective"}, "response used disallowed clinical-claim language: 'effective'"),
        ({"evidence_notes": {"z": "cures", "a": "treats"}}, "response used disallowed clinical-claim language: 'cures'"),
        ({"limitations": ["see GENE:99"]}, "response referenced an identifier not present in the supplied evidence: 'GENE:99'"),
    ],
)
def test_grounding_checks(spark, ranked, change, failure):
    score = ranked.first()["repurposing_score"]
    body = {**_answer(repurposing_score=score + 0.04), **change}
    df = spark.createDataFrame([("DIS:1", "DRUG:1", json.dumps(body))], "disease_id string, drug_id string, response string")
    assert narrative.validate_responses(df, ranked).first()["failure"] == failure


def test_broken_json_and_missing_keys(spark, ranked):
    df = spark.createDataFrame([("DIS:1", "DRUG:1", "{oops"), ("DIS:1", "DRUG:1", "[1]"), ("DIS:1", "DRUG:1", '{"rank": 1}')], "disease_id string, drug_id string, response string")
    got = [r["failure"] for r in narrative.validate_responses(df, ranked).collect()]
    assert sorted(got) == sorted(["response was not a JSON object"] * 2 + ["response missing required keys: ['disease_id', 'drug_id', 'repurposing_score', 'summary', 'limitations']"])


def test_accepted_prose_replaces_text_only(spark, ranked):
    base = narrative.narratives(ranked)
    score = ranked.first()["repurposing_score"]
    df = spark.createDataFrame([("DIS:1", "DRUG:1", json.dumps(_answer(repurposing_score=score, summary=" own words ", limitations=[" "])))], "disease_id string, drug_id string, response string")
    m, b = narrative.merge_responses(base, narrative.validate_responses(df, ranked)).first(), base.first()
    assert (m["summary"], m["gene_target_description"], m["provider"]) == ("own words", "note", "external")
    assert (m["pathway_description"], m["limitations"], m["repurposing_score"]) == (b["pathway_description"], b["limitations"], score)


# --- graph -----------------------------------------------------------------------------------
def _graph(world, ranked):
    genes, paths = graph.gene_reasons(world["gm"], ranked), graph.pathway_reasons(world["pm"], ranked)
    told = narrative.narratives(ranked)
    return graph.first_seen(graph.nodes(ranked, genes, paths, told)), graph.first_seen(graph.edges(ranked, genes, paths, told))


def test_graph_shape(world, ranked):
    nodes, edges = _graph(world, ranked)
    assert {r["type"]: r["count"] for r in nodes.groupBy("type").count().collect()} == {
        "disease": 1, "drug": 1, "disease_gene": 1, "drug_target": 1, "pathway": 1, "evidence_component": 2, "score": 1, "rank": 1, "explanation": 1,
    }
    assert graph.dangling(edges, nodes).count() == 0
    ids = {r["id"] for r in edges.collect()}
    assert "disease_gene:GENE:1->matched_to->drug_target:TGT:1" in ids and "drug:DRUG:1->participates_in->pathway:R-HSA-1" in ids
    j = graph.target_joins(nodes, edges).first()
    assert (j["gene_symbol"], j["target_name"], j["uniprot_id"], j["hgnc_id"]) == ("EGFR", "EGFR kinase", "P00533", "HGNC:1")


def test_reach_matches_brute_force(spark, ws):
    arrows = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "d"), ("e", "f")]
    edges = spark.createDataFrame([("g", f"{s}>{t}", s, t) for s, t in arrows], "graph_id string, id string, source string, target string")
    names = sorted(set(itertools.chain(*arrows)))
    seeds = spark.createDataFrame([("g", n) for n in names], "graph_id string, id string")
    got_nodes, got_edges = graph.reach(edges, seeds, ws)

    def walk(seed, way):
        seen, todo, used = {seed}, [seed], set()
        while todo:
            at = todo.pop()
            for s, t in arrows:
                here, there = (s, t) if way == "descendant" else (t, s)
                if here == at:
                    used.add(f"{s}>{t}")
                    if there not in seen:
                        seen.add(there)
                        todo.append(there)
        return seen - {seed}, used

    want = {(n, w): walk(n, w) for n in names for w in ("descendant", "ancestor")}
    assert {(r["seed"], r["way"], r["id"]) for r in got_nodes.collect()} == {(s, w, i) for (s, w), (ns, _) in want.items() for i in ns}
    assert {(r["seed"], r["way"], r["edge_id"]) for r in got_edges.collect()} == {(s, w, i) for (s, w), (_, es) in want.items() for i in es}


# --- resolution --------------------------------------------------------------------------------
def test_containing_pairs_match_brute_force(spark):
    texts = ["a", "ab", "abc", "bcd", "abcdabc", "xyz salt", "salt", "sal", "t", "zz top", "top", "aaaa", "aa"]
    asks = ["ab", "salt and abc", "q", "aaa", "bcda", "zz top salt", "t"]
    q = spark.createDataFrame([(x,) for x in asks], "norm string")
    k = spark.createDataFrame([(x,) for x in texts], "key string")
    got = {tuple(r) for r in resolve.containing_pairs(q, k).collect()}
    assert got == {(a, t) for a in asks for t in texts if a in t or t in a}


def test_resolution_statuses(spark):
    diseases = spark.createDataFrame([("DIS:000001", "glioblastoma", "MONDO_1", "s"), ("DIS:000002", "twin", "EFO_2", "s"), ("DIS:000003", "Twin.", None, "s")], "disease_id string, disease_name string, ontology_id string, source string")
    xref = spark.createDataFrame([("DIS:000001", "disease", "EFO_7", "x", "brain tumour", False)], "internal_id string, entity_type string, external_id string, external_source string, name string, is_primary boolean")
    aliases = spark.createDataFrame([("gbm", "EFO_7"), ("lost", "EFO_404")], "alias string, ontology string")
    keys = resolve.disease_keys(diseases, xref, aliases)
    asked = [" 'Glioblastoma'. ", "dis:000002", "DIS:999999", "efo:7", "MONDO_404", "GBM", "Brain  Tumour", "twin", "", None, "glio"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    out = resolve.resolve_diseases(q, keys, diseases)
    got = {r["query_id"]: (r["status"], r["match_type"], r["match_id"]) for r in out.collect()}
    one = "DIS:000001"
    assert got == {
        0: ("resolved", "exact_name", one), 1: ("resolved", "internal_id", "DIS:000002"), 2: ("not_supported", None, None), 3: ("resolved", "ontology_id", one),
        4: ("not_supported", None, None), 5: ("resolved", "alias", one), 6: ("resolved", "exact_name", one), 7: ("ambiguous", "exact_name", None),
        8: ("empty_query", None, None), 9: ("empty_query", None, None), 10: ("not_supported", None, None),
    }
    assert {r["entity_id"] for r in resolve.ambiguous_diseases(q, keys).collect()} == {"DIS:000002", "DIS:000003"}
    names = diseases.selectExpr("disease_id as entity_id", "disease_name as name")
    assert [r["suggestion"] for r in resolve.suggestions(out, keys, names).collect()] == ["glioblastoma"]
    assert [r["alias"] for r in resolve.unresolved_aliases(aliases, keys).collect()] == ["lost"]


def test_profile_order_and_context(world, ws):
    s = profiles.molecular_summary(world["diseases"], world["genes"], world["paths"])
    r = {x["disease_id"]: x for x in s.collect()}
    assert (r["DIS:1"]["top_gene_symbols"], r["DIS:1"]["mean_gene_association_score"], r["DIS:2"]["gene_count"]) == (["EGFR", "TP53"], 0.85, 0)
    c = {x["drug_id"]: x["unavailable_reason"] for x in profiles.context_availability(world["drugs"], world["targets"], world["dp"]).collect()}
    assert c == {"DRUG:1": None, "DRUG:2": "drug has no target with a UniProt accession", "DRUG:3": "drug has no target with a UniProt accession"}
