"""Damaged input ends a study's jobs before anything is written; sound input costs no shuffle."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import fusion, guards
from tessera.plans.study import Study

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="given tables not present")


@pytest.fixture(scope="module")
def sound(spark):
    return Study(spark, FOLDER)


def damaged(sound, **parts):
    """A study that shares the sound one's tables, but for some."""
    s = Study(sound.spark, FOLDER, ws=sound.ws)
    for name in ("pairs", "disease_dim", "drug_dim", "features", "predictions", "fused"):
        s.__dict__[name] = parts.get(name, getattr(sound, name))
        if name in parts:
            break
    return s


def fails(df, text):
    with pytest.raises(Exception, match=text):
        df.collect()


def test_a_candidate_without_profile(sound):
    for dim, key, text in (("disease_dim", "disease_id", "no disease profile"), ("drug_dim", "drug_id", "no drug profile")):
        cut = getattr(sound, dim).filter(F.col(key) != sound.pairs.agg(F.min(key)).first()[0])
        with pytest.raises(Exception, match=f"{text} for candidate DIS:"):
            damaged(sound, **{dim: cut}).features  # noqa: B018


def test_predictions_that_do_not_fit(sound):
    one = sound.predictions.limit(1)
    stray = sound.predictions.unionByName(one.withColumn("drug_id", F.lit("DRUG:X")))
    fails(damaged(sound, predictions=stray).fused, "no feature row for the prediction of DIS:.*/DRUG:X")
    fails(damaged(sound, predictions=sound.predictions.unionByName(one)).fused, "duplicate prediction")
    twice = sound.features.unionByName(sound.features.limit(1))
    fails(fusion.fuse(twice, sound.predictions), "duplicate candidate")
    with pytest.raises(Exception, match="no feature row"):
        damaged(sound, predictions=stray).top  # noqa: B018
    few = fusion.fuse(sound.features, sound.predictions.limit(3))
    assert few.count() == sound.features.count() and few.filter("ml_value is not null").count() == 3


def test_a_ranked_pair_without_candidate(sound):
    best = sound.top.limit(5).select("disease_id", "drug_id", "rank")
    fails(guards.joined_to_candidates(best, sound.pairs.limit(0).select("disease_id", "drug_id")), "no candidate for ranked pair")
    strange = sound.fused.withColumn("drug_id", F.concat(F.lit("X"), "drug_id"))
    with pytest.raises(Exception, match="no candidate for ranked pair DIS:.*/XDRUG:"):
        damaged(sound, fused=strange).top  # noqa: B018


def test_edges_that_end_nowhere(sound):
    one = sound.nodes.filter("type = 'drug'").limit(1)
    fewer = sound.nodes.join(one, ["graph_id", "id"], "left_anti")
    fails(guards.attached(sound.edges, fewer), "no (source|target) node of edge")
    assert guards.attached(sound.edges, sound.nodes).exceptAll(sound.edges).isEmpty()


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_guards_share_the_shuffles_of_their_joins(spark, sound):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        plain = sound.features.join(sound.predictions, ["disease_id", "drug_id"], "left")
        assert shuffles(guards.matched(sound.features, sound.predictions)) == shuffles(plain) == 2
    finally:
        spark.conf.set(limit, before)


def test_schemes_meet_rows_by_an_equi_join(spark, sound):
    schemes = spark.range(5).select(
        F.concat(F.lit("s"), "id").alias("scheme"), F.lit(0.4).alias("gene_target_weight"), F.lit(0.3).alias("pathway_weight"),
        F.lit(0.3).alias("ml_weight"), F.lit(5).alias("gene_target_cap"), F.lit(10).alias("pathway_cap"),
        F.lit(0.5).alias("count_share"), F.lit(0.5).alias("specificity_share"),
    )
    all_rows = fusion.with_scheme(sound.features, schemes=schemes)
    plan = all_rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert all_rows.count() == 5 * sound.features.count()
