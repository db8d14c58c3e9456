"""The model family on planted data and against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.constants import MODEL_COLUMNS
from tessera.operators import model


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(42)
    rows = []
    for d in range(8):
        for k in range(40):
            x = [float(rng.randint(0, 5)) for _ in MODEL_COLUMNS]
            hit = MODEL_COLUMNS.index("matched_gene_target_count")
            y = int(x[hit] + rng.gauss(0, 0.4) > 2.5)
            rows.append((f"DIS:{d}", f"DRUG:{k:03d}", *x, y))
    cols = ", ".join(f"{c} double" for c in MODEL_COLUMNS)
    return spark.createDataFrame(rows, f"disease_id string, drug_id string, {cols}, label int").cache()


def test_signal_is_learned_and_attribution_adds_up(spark, planted, ws):
    forest = model.fit(planted, "random_forest", trees=10)
    d = model.score(model.forest_attribution(planted, forest, ws), forest).collect()
    base = model.baseline(forest, ws)
    for r in d[:60]:
        assert sum(r["contributions"]) == pytest.approx(r["model_output"] - base, abs=1e-5)
    assert model.global_importance(forest, spark).orderBy("place").first()["feature_name"] == "matched_gene_target_count"
    logit = model.fit(planted, "logistic_regression")
    assert model.global_importance(logit, spark).orderBy("place").first()["feature_name"] == "matched_gene_target_count"


def test_cross_validation_holds_out_whole_diseases(spark, planted, ws):
    scores = model.cross_validate(planted, ws, ["random_forest"], trees=5)
    per = scores.groupBy("model", "disease_id").agg(F.count_distinct("fold").alias("n"), F.count(F.lit(1)).alias("rows"))
    assert {(r["n"], r["rows"]) for r in per.collect()} == {(1, 40)}
    best = model.select_model(model.cv_summary(model.fold_metrics(scores))).first()
    assert best["pr_auc_mean"] > 0.8 and best["n_folds"] == 5


def test_folds_are_balanced(spark):
    sizes = [13, 11, 7, 7, 5, 3, 2]
    rows = [(f"d{i}",) for i, n in enumerate(sizes) for _ in range(n)]
    got = {r["disease_id"]: r["fold"] for r in model.folds(spark.createDataFrame(rows, "disease_id string"), 3).collect()}
    loads, want = [0, 0, 0], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        f = loads.index(min(loads))
        want[f"d{i}"], loads[f] = f, loads[f] + sizes[i]
    assert got == want


def test_metrics_match_brute_force(spark):
    rng = random.Random(1)
    rows = [("m", 0, rng.randint(0, 1), round(rng.random(), 1)) for _ in range(200)] + [("m", 1, 0, 0.5), ("m", 1, 0, 0.1)]
    got = {r["fold"]: r for r in model.fold_metrics(spark.createDataFrame(rows, "model string, fold int, label int, score double")).collect()}
    y, s = np.array([r[2] for r in rows[:200]]), np.array([r[3] for r in rows[:200]])
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp, n = ((s >= t) & (y == 1)).sum(), (s >= t).sum()
        ap += (tp / len(pos) - last) * tp / n
        last = tp / len(pos)
    assert got[0]["roc_auc"] == pytest.approx(auc, abs=1e-6) and got[0]["pr_auc"] == pytest.approx(ap, abs=1e-6)
    assert got[1]["roc_auc"] is None and (got[1]["precision"], got[1]["recall"], got[1]["f1"]) == (0.0, 0.0, 0.0)


def test_one_class_is_refused(spark, planted):
    with pytest.raises(ValueError, match="degenerate"):
        model.fit(planted.withColumn("label", F.lit(0)), "logistic_regression")
    with pytest.raises(ValueError, match="empty"):
        model.fit(planted.limit(0), "logistic_regression")


def test_absent_model(spark, tmp_path):
    with pytest.raises(model.NotTrained):
        model.load(str(tmp_path / "none"), spark)


def test_models_score_where_counts_were_observed(spark, planted, ws):
    """The session holds an observation manager then, which no task can carry."""
    seen = Observation()
    planted.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 320
    for name in model.MODELS:
        assert model.score(planted, model.fit(planted, name, trees=4)).filter("model_output between 0 and 1").count() == 320


def test_a_stored_record_tells_how_the_model_was_chosen(spark, planted, ws):
    chosen = model.train(planted, ws, trees=6)
    model.save(chosen, ws.path("bundle"), spark)
    path = ws.path("bundle2")
    model.save(chosen, path, spark)
    back = model.load(path, spark)
    assert back.name == chosen.name and back.metadata["n_rows"] == 320 and back.metadata["seed"] == 42
    assert back.metadata["prevalence"] == pytest.approx(back.metadata["n_positive"] / 320)
    best = max(back.metadata["validation"], key=lambda r: (r["pr_auc_mean"], r["roc_auc_mean"]))
    assert {r["model"] for r in back.metadata["validation"]} == set(model.MODELS)
    assert best["pr_auc_mean"] == next(r for r in back.metadata["validation"] if r["model"] == back.name)["pr_auc_mean"]
    assert best["pr_auc_mean"] > back.metadata["prevalence"]
    pair = ["disease_id", "drug_id"]
    both = model.score(planted, chosen).select(*pair, "model_output").exceptAll(model.score(planted, back).select(*pair, "model_output"))
    assert both.isEmpty()


def test_forest_facts_tell_a_forest_that_breaks_its_settings(spark, planted, ws, monkeypatch):
    forest = model.fit(planted, "random_forest", trees=5)
    clean = {"n_trees": 5, "n_small_leaves": 0, "n_foreign_splits": 0, "n_outside": 0, "n_deep": 0}
    assert model.forest_facts(forest, ws).first().asDict() == clean
    monkeypatch.setattr(model, "MAX_DEPTH", 1)
    monkeypatch.setattr(model, "LEAF_ROWS", 10_000)
    r = model.forest_facts(forest, ws).first()
    assert r["n_deep"] > 0 and r["n_small_leaves"] > 0


def test_rows_walk_a_forest_as_in_the_model_of_spark(spark, planted, ws):
    odd = planted.withColumns(
        {
            MODEL_COLUMNS[3]: F.when(F.col("drug_id") < "DRUG:005", None).otherwise(F.col(MODEL_COLUMNS[3])),
            MODEL_COLUMNS[4]: F.when(F.col("drug_id") < "DRUG:007", float("inf")).otherwise(F.col(MODEL_COLUMNS[4])),
        }
    )
    for trees in (1, 25):
        forest = model.fit(odd, "random_forest", trees=trees)
        pair, p = ["disease_id", "drug_id"], vector_to_array("probability")[1]
        told = forest.model.transform(model._vector(odd, forest.name, forest.stats)).select(*pair, p.alias("p"))
        both = model.score(odd, forest).join(told, pair)
        assert both.count() == 320 and both.filter("abs(model_output - p) > 6e-7").isEmpty()
        assert "features" not in both.columns and "probability" not in both.columns


def test_a_forest_of_single_leaves_walks_nowhere(spark, planted, ws):
    forest = model.fit(planted.filter("drug_id < 'DRUG:001'"), "random_forest", trees=3)
    d = model.score(model.forest_attribution(planted, forest, ws), forest)
    assert d.filter("model_output between 0 and 1").count() == 320
    assert d.agg(F.max(F.aggregate("contributions", F.lit(0.0), lambda a, c: a + F.abs(c)))).first()[0] == 0
