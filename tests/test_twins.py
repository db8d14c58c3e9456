"""Every query with an SQL twin returns the same rows on the smallest folder."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from oracles import twins
from tessera.plans.catalog import QUERIES
from tessera.sources.given import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="given tables not present")
SQL = twins.all_sql() if Path(FOLDER).exists() else {}
SLOW: set[str] = set()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else v


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    got = QUERIES[name](spark, FOLDER)
    cur = con.execute(SQL[name])
    want_columns = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(want_columns)
    assert _rows(got.columns, got.collect()) == _rows(want_columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(twins.FINAL) - SLOW))
def test_queries_without_twin_have_rows(spark, name):
    assert not QUERIES[name](spark, FOLDER).isEmpty()


def test_entry(spark):
    assert {"disease_id", "drug_id", "rank", "repurposing_score"} == set(entry.entry(spark).columns)


def test_forest_attribution_adds_up(spark):
    for r in QUERIES["m16_forest_attribution"](spark, FOLDER).collect():
        assert r["model_output"] - r["baseline_output"] == pytest.approx(r["sum_contributions"], abs=1e-4)


def test_score_invariants(spark):
    for r in QUERIES["r4_ranking_table"](spark, FOLDER).collect():
        points = sum(r[f"{c}_points"] or 0.0 for c in ("gene_target", "pathway", "ml"))
        assert points == pytest.approx(r["repurposing_score"], abs=1e-2)
        assert 0.0 <= r["repurposing_score"] <= 100.0


def test_stored_model_scores_like_the_fitted_one(spark):
    fresh = {(r[0], r[1]): r["model_output"] for r in QUERIES["m6_logistic_regression"](spark, FOLDER).collect()}
    stored = {(r[0], r[1]): r["model_output"] for r in QUERIES["m13_stored_model"](spark, FOLDER).collect()}
    assert all(stored[k] == pytest.approx(v, abs=1e-6) for k, v in fresh.items())
