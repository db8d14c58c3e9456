"""What moves, how often, and how little of it: plans of the steps that grew too fast, and their rows."""

from __future__ import annotations

import contextlib
import io
from pathlib import Path

from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.operators import build, candidates, features, profiles, registry, resolve
from tessera.operators.ordering import row_place
from tessera.plans import catalog
from tessera.plans.study import Study
from tessera.sources import files

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_text_that_starts_with_a_letter_is_not_cast(spark):
    texts = ["12", " 7 ", "+5", "-3", "mondo:1|2", "", "1x", "\x7f9", "é1", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", row_place(F.col("t")).alias("p"))
    got = {r["t"]: (r["p"]["number"], r["p"]["text"]) for r in df.collect()}
    assert {t: got[t][0] for t in ("12", " 7 ", "+5", "-3", "mondo:1|2", "", "1x", "é1", None)} == {
        "12": 12, " 7 ": 7, "+5": 5, "-3": -3, "mondo:1|2": None, "": None, "1x": None, "é1": None, None: None,
    }
    assert got["\x7f9"][0] == spark.sql("select try_cast('\x7f9' as bigint)").first()[0]
    assert "CASE WHEN" in _plan(df).upper()


def test_ids_are_trimmed_only_where_their_ends_ask_for_it(spark):
    texts = [" chembl1 ", "chembl2", "　chembl3", "chembl4\x85", "chembl 5", "", " ", "xchembl", "chémblé", "chemblé", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.upper(ids.strip(F.col("t")))
    key = ids.chembl_key(F.col("t"))
    assert _rows(df.select("t", key)) == _rows(df.select("t", F.when(plain.startswith("CHEMBL"), plain)))
    assert "CASE WHEN" in _plan(df.select(ids.ontology_key(F.col("t")))).upper()


def test_targets_of_a_drug_are_counted_without_unfolding_rows(spark):
    rows = [
        ("D1", "T1", "inhibitor"), ("D1", "T1", " INHIBITOR "), ("D1", "T1", "inhibitor"), ("D1", "T2", None), ("D1", "T2", ""),
        ("D1", None, "agonist"), ("D2", "T1", "antagonist"), ("D2", "T3", "opener"), (None, "T1", "agonist"),
    ]
    d = features.target_profile(spark.createDataFrame(rows, "drug_id string, target_id string, action_type string"))
    assert "Expand" not in _plan(d)
    assert _rows(d) == sorted([("D1", 2, 3, 1, 0, 4, 2, 4), ("D2", 2, 0, 0, 1, 2, 0, 2), (None, 1, 0, 1, 0, 1, 0, 1)], key=repr)


def test_matches_of_given_pairs_are_cut_before_they_meet(spark, ws):
    genes = spark.createDataFrame(
        [(f"H{i % 7}", f"D{i % 3}", "S", 0.5, f"G{i}", "n", "e", None) for i in range(60)],
        "hgnc_id string, disease_id string, gene_symbol string, association_score double, gene_id string, gene_name string, ensembl_id string, source string",
    )
    targets = spark.createDataFrame(
        [(f"H{i % 5}", f"R{i % 4}", f"T{i}", "n", "u", "a", None) for i in range(40)],
        "hgnc_id string, drug_id string, target_id string, target_name string, uniprot_id string, action_type string, source string",
    )
    pairs = spark.createDataFrame([("D0", "R1"), ("D2", "R3")], "disease_id string, drug_id string")
    got = candidates.gene_matches_of(pairs, genes, targets, ws)
    assert _rows(got) == _rows(candidates.gene_matches_of(pairs, genes, targets)) and got.count() > 0
    assert {p.name.split("-", 1)[1] for p in Path(ws.root).iterdir()} >= {"asked_targets", "asked_links", "asked_genes"}


def test_graphs_read_the_matches_of_the_published_pairs(spark, ws):
    s = Study(spark, SMALL, ws, model_kind="stand_in")
    s.nodes  # noqa: B018
    made = [p.name.split("-", 1)[1] for p in Path(s.ws.root).iterdir()]
    assert made.count("asked_genes") == 1 and made.count("top_genes") == 1 and made.count("graph_genes") == 1


def test_gene_rows_move_once_for_ids_and_repeats(spark, ws):
    diseases = build.build_diseases(spark.createDataFrame([(1, "mondo:1", "a")], "seq long, ontology_id string, disease_name string"), ws)
    raw = [("s1", "mondo:1", "ensg1", "G1", 0.5), ("s2", "mondo:1", "ENSG1.2", "G1", 0.7), ("s3", "mondo:1", "ensg2", "", 0.1)]
    raw = spark.createDataFrame(raw, "seq string, ontology_id string, ensembl_id string, gene_symbol string, association_score double")
    b = build.build_disease_genes(raw, diseases.registry, ws)
    assert "Exchange hashpartitioning(disease_id" not in _plan(b.table)
    assert _rows(b.table.select("ensembl_id", "gene_name", "association_score")) == [("ENSG1", "G1", 0.7), ("ENSG2", None, 0.1)]


def test_damaged_tables_come_from_one_scan(spark, ws):
    s = Study(spark, SMALL, ws, model_kind="stand_in")
    d = catalog._damaged(s)["drug_targets"]
    assert "Union" not in _plan(d)
    t = s.tables["drug_targets"]
    last = F.substring("target_id", -1, 1)
    want = [
        t, t.filter(last == "7").withColumn("drug_id", F.concat(F.lit("X"), "drug_id")), t.filter(last == "3"),
        t.filter(last == "5").withColumn("target_id", F.lit(None).cast("string")), t.filter(last == "9").withColumn("drug_id", F.lit("")),
    ]
    assert d.columns == t.columns
    assert _rows(d) == sorted((tuple(r) for w in want for r in w.collect()), key=repr)


def test_targets_are_ordered_without_the_columns_nobody_asks_for(spark, monkeypatch):
    given = []
    real = profiles.ordered_targets
    monkeypatch.setattr(profiles, "ordered_targets", lambda t, ws: given.append(t.columns) or real(t, ws))
    assert catalog.QUERIES["e12_ordered_targets"](spark, SMALL).count() > 0
    assert given == [["drug_id", "target_id", "target_name"]]


def test_many_small_rows_keep_their_parts(spark):
    seen = spark.range(40).selectExpr("'drug' entity_type", "'D' || id % 9 internal_id", "'x' external_id", "'s' external_source", "'n' name", "true is_primary", "string(id) seq")
    found = registry.crosswalk([seen])
    assert "REPARTITION_BY_NUM" in _plan(found) and found.count() == 9
    resolved = spark.createDataFrame([("not_supported", "name", "alt 1"), ("not_supported", "name", "sa")], "status string, shape string, normalized_query string")
    keys = spark.createDataFrame([("name", f"salt {i}", f"D{i}", 1) for i in range(20)], "kind string, key string, entity_id string, phase int")
    names = spark.createDataFrame([(f"D{i}", f"Salt {i}") for i in range(20)], "entity_id string, name string")
    top = resolve.suggestions(resolved, keys, names)
    assert "REPARTITION_BY_NUM" in _plan(top)
    assert [r["suggestion"] for r in top.filter("normalized_query = 'alt 1'").orderBy("place").collect()] == ["Salt 1", "Salt 10", "Salt 11", "Salt 12", "Salt 13"]


def test_landed_records_are_compressed_and_many_files_stay_where_they_are(spark, ws, tmp_path):
    land = catalog._landing(Study(spark, SMALL, ws, model_kind="stand_in"))
    for name in ("mechanisms", "diseases"):
        landed = [p for p in Path(land.path(name)).rglob("part-*")]
        assert landed and all(p.suffix == ".gz" for p in landed)
    spark.range(64).selectExpr("string(id) value").repartition(16).write.option("compression", "gzip").text(str(tmp_path / "many"))
    spark.range(64).selectExpr("string(id) value").coalesce(1).write.option("compression", "gzip").text(str(tmp_path / "one"))
    assert "Exchange" in _plan(files.read_lines(spark, str(tmp_path / "one"), spread=True))
    assert files.read_lines(spark, str(tmp_path / "many"), spread=True).count() == 64


def test_keys_are_worked_out_once_and_not_again_for_the_filter_on_them(spark, ws):
    rows = [("ENSG1", "R-HSA-1"), (" ensg1.4 ", "r-hsa-1"), (None, "R-1"), ("G2", "R-2"), ("ENSG3", None)]
    raw = ws.store("raw", spark.createDataFrame(rows, "ensembl_id string, p string"))
    edges = build.gene_pathway_edges(raw.withColumn("reactome_id", F.regexp_replace("p", "^HSA", "R")))
    assert [tuple(r) for r in edges.collect()] == [("ENSG1", "R-HSA-1")]
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
