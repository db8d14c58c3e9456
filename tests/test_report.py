"""The run report, payload pages, the order of rows, one-pass checks and cut gram lists."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from tessera.constants import PRIMARY_KEY, TABLES
from tessera.operators import ordering, quality, registry, resolve
from tessera.plans import ingest, report
from tessera.sources import files


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_report_of_a_run_with_two_sources(spark, tmp_path, ws):
    disease = lambda i, page, rows: {"data": {"disease": {"id": i, "name": f"n {i}", "page": page, "associatedTargets": {"rows": rows}}}}
    gene = lambda g, s: {"score": s, "target": {"id": g, "approvedSymbol": f"S{g}", "approvedName": "x"}}
    pages = [disease("EFO_1", 0, [gene("ENSG1", 0.5), gene("ENSG2", 0.25)]), disease("EFO_1", 1, [gene("ENSG1", 0.75), gene("ENSG3", 7.0), gene("bad", 0.1)])]
    whole = {k: v for k, v in disease("EFO_2", 0, [gene("ENSG1", 0.125)])["data"]["disease"].items() if k != "page"}
    paths = {
        "drug_names": _write(tmp_path / "names.tsv", "CID100000085\tcarnitine\nCID100000119\tgaba\nno id\tx\nCID100000085\tagain\n"),
        "side_effects": _write(tmp_path / "se.tsv", "CID100000085\tx\tC0000737\tPT\t\tPain\n" * 3 + "CID100000999\tx\tC0000737\tPT\t\tPain\n"),
        "diseases": str(tmp_path / "ot"),
        "seeds": _write(tmp_path / "seeds.txt", "EFO_9\nEFO_1\nEFO_7\nEFO_9\n"),
    }
    _write(tmp_path / "ot" / "one.json", "\n".join(json.dumps(p) for p in pages))
    _write(tmp_path / "ot" / "a-much-longer-name.json", json.dumps({"data": {"disease": whole}}))
    out = str(tmp_path / "out")
    done = ingest.build_all(spark, paths, ws, out, multiline=False)

    stages = {r["stage"]: r for r in done.report.stages().collect()}
    assert [r["stage"] for r in done.report.stages().orderBy("position").collect()] == [
        "snapshot", *[f"download:{s}" for s in report.LICENCES], *[f"build:{t}" for t in files.NEEDS]
    ]
    absent = {n for n, r in stages.items() if not r["available"]}
    assert absent == {"download:chembl", "download:reactome", "build:drug_targets", "build:disease_pathways"}
    assert stages["download:chembl"]["note"] == report.ABSENT and stages["build:drug_targets"]["note"] == "requires ChEMBL+drugs"
    assert stages["build:diseases"]["note"] == "seed ids not resolvable in Open Targets: EFO_9, EFO_7"
    counts = {n: (r["input_rows"], r["output_rows"], r["n_rejected"]) for n, r in stages.items() if n.startswith("build:")}
    assert counts == {
        "build:drugs": (3, 2, 2), "build:drug_side_effects": (3, 1, 3), "build:diseases": (2, 2, 2),
        "build:disease_genes": (4, 3, 2), "build:drug_targets": (0, 0, 0), "build:disease_pathways": (0, 0, 0),
    }
    made = {(r["kind"], r["name"]): r["n"] for r in done.report.counts().collect()}
    assert made[("entity", "gene")] == 3 and made[("dataset", "disease_genes")] == 3 and ("entity", "target") not in made
    for name, table in done.tables.items():
        assert made[("dataset", name)] == table.count()
    stored = spark.read.json(f"{out}/_reports/stages").collect()
    assert {(r["stage"], r["output_rows"]) for r in stored} == {(r["stage"], r["output_rows"]) for r in stages.values()}
    scores = {(r["ensembl_id"]): r["association_score"] for r in done.tables["disease_genes"].filter("disease_id = 'DIS:000002'").collect()}
    assert scores == {"ENSG1": 0.75, "ENSG2": 0.25}  # both pages of the disease in the later file


def test_first_name_comes_from_the_row_that_minted_the_id(spark, ws):
    for rows in ([("k", "b/x|1", "second"), ("k", "a/much-longer|1", "first")], [("k", "10", "second"), ("k", "9", "first")]):
        df = spark.createDataFrame(rows, "key string, seq string, name string")
        if rows[0][1].isdigit():
            df = df.withColumn("seq", F.col("seq").cast("long"))
        minted = registry.mint(df.select("key", "seq"), "gene", ws)
        seen = df.join(minted.select("key", "internal_id"), "key")
        named = registry.crosswalk([registry.xrefs(seen, "gene", "internal_id", [(F.col("key"), "s", F.col("name"), True)])])
        first = minted.first()["seq"]
        assert named.first()["name"] == "first" == next(r["name"] for r in df.collect() if r["seq"] == first)


def test_checks_scan_each_table_once(spark, tmp_path):
    tables = {}
    for name, columns in TABLES.items():
        rows = spark.range(40).select(*[F.concat(F.lit(f"{c}:"), F.col("id") % 9).cast(kind).alias(c) if kind == "string" else F.lit(None).cast(kind).alias(c) for c, kind, _ in columns])
        rows.write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    checks = quality.quality_checks(tables)
    plan = checks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == len(tables) + len(quality.FOREIGN_KEY)  # and the keys of each parent
    got = {r["check_name"]: (r["passed"], r["detail"]) for r in checks.collect()}
    for name in TABLES:
        surplus = 40 - tables[name].select(*PRIMARY_KEY[name]).distinct().count()
        assert got[f"{name}: unique primary key"] == (False, f"{surplus} duplicate rows")
        assert got[f"{name}: required ids populated"] == (True, "")
    assert got["disease_genes.disease_id -> diseases"] == (True, "")
    assert got["disease_genes.association_score: missing-value level"] == (False, "100% null")
    empty = {n: t.limit(0) for n, t in tables.items()}
    none = {r["check_name"]: r["passed"] for r in quality.quality_checks(empty).collect()}
    assert not none["drugs: non-empty"] and none["disease_genes.disease_id -> diseases"] and len(none) == 18


def test_suggestions_against_brute_force(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abc ") for _ in range(n)).strip() or "a"
    known = [(f"E{i:03}", word(rnd.randint(1, 9)), rnd.randint(0, 1)) for i in range(160)]
    names = {e: f"Name {k.upper()} {i % 40}" for i, (e, k, _) in enumerate(known)}
    asked = sorted({word(rnd.randint(1, 7)) for _ in range(60)} | {"a", "b", "ab", "abc", "zz", "zzzz"})
    keys = spark.createDataFrame([("name", k, e, p) for e, k, p in known], "kind string, key string, entity_id string, phase int")
    resolved = spark.createDataFrame([("not_supported", "name", q) for q in asked], "status string, shape string, normalized_query string")
    got = {}
    for r in resolve.suggestions(resolved, keys, spark.createDataFrame(list(names.items()), "entity_id string, name string")).collect():
        got.setdefault(r["normalized_query"], {})[r["place"]] = r["suggestion"]
    first = {}
    for e, k, p in known:
        first[k] = min(first.get(k, (p, e)), (p, e))
    want = {}
    for q in asked:
        hits = {}
        for e, k, p in known:
            if q in k or k in q:
                at = (first[k], (p, e))
                hits[names[e]] = min(hits.get(names[e], at), at)
        best = sorted(hits, key=lambda n: (hits[n], n))[:5]
        if best:
            want[q] = dict(enumerate(best, 1))
    assert got == want


def test_joins_without_hot_keys_stay_plain(spark):
    left = spark.range(200).select((F.col("id") % 50).cast("string").alias("k"), "id")
    right = spark.range(50).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("b"))
    got = ordering.split_join(left, right, "k")
    assert len(got.collect()) == 200
    final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "REPARTITION" not in final and "Union" not in final


def test_equal_rows_of_a_hot_key_are_dealt_out(spark):
    left = spark.range(400).select(F.lit("hot").alias("k"), F.lit(1).alias("a"))
    right = spark.range(300).select(F.lit("hot").alias("k"), F.col("id").alias("b"))
    parts = ordering.split_join(left, right, "k", pairs_per_part=10_000).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 120_000 and max(r["count"] for r in parts) < 60_000
