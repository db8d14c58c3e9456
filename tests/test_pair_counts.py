"""Counts per pair worked out before the matches unfold, against the matches themselves."""

from __future__ import annotations

import random
from pathlib import Path

from tessera.operators import candidates, profiles

GENES = "hgnc_id string, disease_id string, gene_symbol string, association_score double, gene_id string, gene_name string, ensembl_id string, source string"
TARGETS = "hgnc_id string, drug_id string, target_id string, target_name string, uniprot_id string, action_type string, source string"


def _sides(spark, n=300):
    draw = random.Random(7)

    def some(kind: str, k: int):
        return draw.choice([None, *[f"{kind}{i}" for i in range(k)] * 3])

    genes = [(some("H", 12), some("D", 4), "S", 0.5, some("G", 20), "n", "e", None) for _ in range(n)]
    targets = [(some("H", 12), some("R", 9), some("T", 15), "n", "u", "a", None) for _ in range(n)]
    return spark.createDataFrame(genes, GENES), spark.createDataFrame(targets, TARGETS)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_counts_equal_those_of_the_matches(spark, ws):
    """Rows repeat, ids are null, and genes and targets are found under several shared ids."""
    genes, targets = _sides(spark)
    expected = candidates.gene_pair_counts(candidates.gene_target_matches(genes, targets))
    got = candidates.gene_pair_counts_of(genes, targets, ws)
    assert got.columns == expected.columns and got.dtypes == expected.dtypes
    assert _rows(got) == _rows(expected)


def test_pairs_meet_once_for_a_shared_id(spark, ws):
    """2,000 gene rows and 2,000 target rows of one pair and shared id are four million matches."""
    genes = spark.range(2000).selectExpr("'H' hgnc_id", "'D' disease_id", "'G' || id gene_id")
    targets = spark.range(2000).selectExpr("'H' hgnc_id", "'R' drug_id", "'T' || id target_id")
    got = candidates.gene_pair_counts_of(genes, targets, ws)
    assert _rows(got) == [("D", "R", 4_000_000, 1, 2000, 2000)]


def test_diseases_of_a_shared_id_move_as_one_list(spark, ws):
    """The rows of a drug lie together before diseases unfold, so no pair is shuffled."""
    genes = spark.range(2500).selectExpr("'H' hgnc_id", "'D' || id disease_id", "'G' gene_id")
    targets = spark.range(3).selectExpr("'H' hgnc_id", "'R' || id drug_id", "'T' target_id")
    counts = candidates.gene_pair_counts_of(genes, targets, ws)
    assert counts.count() == 7500 and {tuple(r)[2:] for r in counts.collect()} == {(1, 1, 1, 1)}
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(disease_id" not in plan and "hashpartitioning(drug_id" in plan
    (lists,) = [p for p in Path(ws.root).iterdir() if p.name.endswith("lists_genes")]
    assert spark.read.parquet(str(lists)).count() == 3


def test_pathways_of_a_drug_equal_those_of_its_facts(spark, ws):
    """Proteins repeat in another case, a pathway has several names or none, ids are null."""
    draw = random.Random(3)
    targets = [(draw.choice([None, "R0", "R1", "R2"]), draw.choice([None, "p1", "P1", "P2", "P3"])) for _ in range(40)]
    index = {(f"P{draw.randrange(5)}", f"R-{draw.randrange(6)}", draw.choice([None, "a", "b"])) for _ in range(40)}
    targets = spark.createDataFrame(targets, "drug_id string, uniprot_id string")
    index = spark.createDataFrame(sorted(index, key=repr), "uniprot_id string, reactome_id string, pathway_name string")
    expected = candidates.drug_pathways(candidates.drug_protein_pathways(targets, index))
    got = candidates.drug_pathways_of(targets, index, ws)
    assert got.dtypes == expected.dtypes and _rows(got) == _rows(expected)
    for limit in (2, None):
        with_facts = profiles.capped_pathways(expected, candidates.drug_protein_pathways(targets, index), limit)
        with_lists = profiles.capped_pathways(expected, candidates.DrugFacts(targets, index, ws), limit)
        assert with_facts.count() > 3 and with_lists.dtypes == with_facts.dtypes and _rows(with_lists) == _rows(with_facts)


def test_matches_of_some_pairs_are_those_among_all(spark):
    genes, targets = _sides(spark, 120)
    pairs = spark.createDataFrame([("D0", "R1"), ("D2", "R3"), ("D0", "R1"), ("D9", "R1"), (None, "R1")], "disease_id string, drug_id string")
    every = candidates.gene_target_matches(genes, targets)
    got = candidates.gene_matches_of(pairs, genes, targets)
    assert got.columns == every.columns
    assert _rows(got) == _rows(every.join(pairs, candidates.PAIR, "left_semi").select(*got.columns))


def test_counting_pathway_matches_moves_no_match(spark, ws):
    """The drugs are spread once; matches are counted per pair where they are made."""
    kinds = "reactome_id string, disease_id string, pathway_id string, pathway_name string, source string, gene_support_count int"
    paths = ws.store("paths", spark.createDataFrame([("R-1", "D1", "P1", "n", None, 3)], kinds))
    drugs = spark.range(50).selectExpr("'DRUG' || id % 7 drug_id", "'R-' || id % 3 reactome_id", "'n' pathway_name", "1 supporting_target_count")
    counts = candidates.pathway_pair_counts(candidates.pathway_matches(paths, drugs))
    assert len(counts.collect()) == 7
    assert "hashpartitioning(disease_id" not in counts._jdf.queryExecution().executedPlan().toString()


def test_rollups_shuffle_one_row_for_a_match(spark):
    genes, targets = _sides(spark, 40)
    genes = genes.replace("G3", "")
    paths = spark.createDataFrame([("D1", "R1", "p2"), ("D1", "R1", "p1"), ("D8", "R8", ""), ("D8", "R7", "p"), (None, "R1", "p1")], "disease_id string, drug_id string, reactome_id string")
    matches = candidates.gene_target_matches(genes, targets)
    d = candidates.rollups(matches, paths)
    found = {(r["disease_id"], r["drug_id"]): r for r in d.collect()}
    assert len(found) == d.count() and ("D8", "R8") not in found
    assert found["D8", "R7"]["generation_methods"] == ["pathway"]
    for pair in {(r["disease_id"], r["drug_id"]) for r in matches.collect()}:
        rows = [r for r in matches.collect() if (r["disease_id"], r["drug_id"]) == pair]
        assert found[pair]["matched_disease_gene_ids"] == sorted({r["disease_gene_id"] for r in rows} - {None, ""})
        assert found[pair]["matched_gene_hgnc_ids"] == sorted({r["hgnc_id"] for r in rows})
        break
    assert found["D1", "R1"]["matched_pathway_reactome_ids"] == ["p1", "p2"]
    assert "inline" not in d._jdf.queryExecution().analyzed().toString()
