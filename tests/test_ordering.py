"""Ordering, minting and the joins that must survive hot keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ordering, registry


def test_numbers_match_brute_force_with_a_hot_group(spark, ws):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randint(0, 9)}", rng.randint(0, 50), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(7)
    got = ordering.number_rows(df, [F.col("v").desc(), F.col("id")], ws, "n", group=["g"])
    want, seen = {}, {}
    for g, v, i in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    assert {r["id"]: r["position"] for r in got.collect()} == want


def test_numbers_without_groups(spark, ws):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    got = ordering.number_rows(df, [F.col("v")], ws, "n")
    assert all(r["position"] == r["v"] + 1 for r in got.collect())


def test_numbering_nothing(spark, ws):
    assert ordering.number_rows(spark.createDataFrame([], "v int"), [F.col("v")], ws, "n").count() == 0


def test_mint_follows_first_sight(spark, ws):
    seen = spark.createDataFrame([("b", 3), ("a", 5), ("b", 9), ("c", 1), ("a", 2)], "key string, seq int")
    got = {r["key"]: r["internal_id"] for r in registry.mint(seen, "drug", ws).collect()}
    assert got == {"c": "DRUG:000001", "a": "DRUG:000002", "b": "DRUG:000003"}


def test_mint_refuses_empty_keys(spark, ws):
    with pytest.raises(Exception, match="empty gene key"):
        registry.mint(spark.createDataFrame([("", 1)], "key string, seq int"), "gene", ws)


def test_crosswalk_keeps_first_name_and_any_primary(spark):
    rows = [("gene", "G1", "E1", "s", None, False, "1"), ("gene", "G1", "E1", "s", "n2", True, "2"), ("gene", "G1", "E1", "s", "n10", False, "10")]
    df = spark.createDataFrame(rows, "entity_type string, internal_id string, external_id string, external_source string, name string, is_primary boolean, seq string")
    r = registry.crosswalk([df]).first()
    assert (r["name"], r["is_primary"]) == ("n2", True)


def test_left_join_spread_keeps_null_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    right = spark.createDataFrame([("a", 10)], "k string, v int")
    got = {r["id"]: r["v"] for r in ordering.left_join_spread(left, right, "k", "id").collect()}
    assert got == {1: 10, 2: None, 3: None}


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    top = ordering.top_per_group(df, ["g"], [F.col("id").desc()], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(r["id"] for r in top.collect()) == [94, 95, 96, 97, 98, 99]


def test_split_join_spreads_a_hot_key(spark):
    left = spark.range(300).select(F.when(F.col("id") < 200, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("a"))
    right = spark.range(400).select(F.when(F.col("id") < 250, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("b"))
    got = ordering.split_join(left, right, "k", pairs_per_part=1000)
    parts = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 200 * 250 + 50 == got.distinct().count()
    assert len(parts) >= 6 and max(r["count"] for r in parts) < 20_000
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in left.join(right, "k").collect()}
