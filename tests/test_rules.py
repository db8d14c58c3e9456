"""Scalar rules on single values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import ids, numbers, texts


def values(spark, rule, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", rule(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("rule", "given", "want"),
    [
        (ids.name_key, ["  Acetyl   Salicylic\tAcid ", "  ", None, "a b c"], ["acetyl salicylic acid", None, None, "a b c"]),
        (ids.compound_key, ["CID100000085", "cid000010917", "2244", "000", "CID2", "x", None], ["85", "10917", "2244", "0", None, None, None]),
        (ids.ontology_key, ["EFO:0000305", " mondo_0018177 ", "", None], ["EFO_0000305", "MONDO_0018177", None, None]),
        (ids.gene_key, ["ENSG00000146648.12", "ensg1", "LRG_1", None], ["ENSG00000146648", "ENSG1", None, None]),
        (ids.chembl_key, ["chembl25", "X25"], ["CHEMBL25", None]),
        (ids.reactome_key, [" r-hsa-1", "HSA-1"], ["R-HSA-1", None]),
        (ids.concept_key, ["c0000737", "C12345", "C000073X", "C0000737\n"], ["C0000737", None, None, "C0000737"]),
        (ids.protein_key, ["p00533", "A0A024R161", "B4XY1A", "P0053", "xP00533"], ["P00533", "A0A024R161", None, None, None]),
        (ids.query_text, ['  "(Breast Cancer)". ', "[x]!", None, "(a) b", "\"'`"], ["breast cancer", "x", "", "a) b", ""]),
        (ids.disease_query_kind, ["DIS:000001", "dis:1234567890", "MONDO_1", "EFO:", "flu", "  ", None], ["internal_id", "name", "ontology_id", "name", "name", "empty", "empty"]),
        (ids.drug_query_kind, ["drug:7", "CHEMBL25", "cid:9", "CID_9", "9", "aspirin", ""], ["internal_id", "external_id", "external_id", "external_id", "external_id", "name", "empty"]),
        (ids.cid_in_query, ["CID:02244", "2244", "CIDX1"], ["2244", "2244", None]),
    ],
)
def test_id_rules(spark, rule, given, want):
    assert values(spark, rule, given) == want


def test_ratio_and_clip(spark):
    df = spark.createDataFrame([(1, 3), (0, 5), (4, 0)], "n int, d int")
    assert [r[0] for r in df.select(numbers.ratio(F.col("n"), F.col("d"))).collect()] == [0.333333, 0.0, None]
    nan, inf = float("nan"), float("inf")
    assert values(spark, numbers.clip01, [0.5, -1.0, 2.0, nan, inf, -inf, None], "double") == [0.5, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    assert values(spark, numbers.direction, [1e-5, -1e-5, 1e-7], "double") == ["increases", "decreases", "neutral"]


def test_phrases(spark):
    df = spark.createDataFrame([("INHIBITOR ", "EGFR", "T1"), (None, "EGFR", "T1"), ("  ", "", "T1")], "a string, n string, t string")
    got = [r[0] for r in df.select(texts.mechanism_phrase(F.col("a"), F.col("n"), F.col("t"))).collect()]
    assert got == ["inhibitor of EGFR", "acts on EGFR", "acts on T1"]


def test_banned_language(spark):
    given = ["it cures", "secure", "Will\n treat", "unsafe", "SAFELY done", "clinically  proven", "proven", "éfficace", "cure, effective", "ﬁne safe", "ſafe", "safeé"]
    want = ["cures", None, "will treat", None, "safely", "clinically proven", "proven", None, "effective", "safe", "safe", None]
    assert values(spark, texts.banned_phrase, given) == want


def test_mentions(spark):
    got = values(spark, texts.mentions, ["HGNC:12, R-HSA-3.", "xHGNC:1 GENE:7b DRUG:5", "none"])
    assert got == [["HGNC:12", "R-HSA-3"], ["DRUG:5"], []]


def test_number_texts(spark):
    halves = [84.25, 84.35, 0.05, 84.15, 84.75, 1234.56]
    assert values(spark, lambda c: texts.fixed(c, 1), halves, "double") == [f"{x:.1f}" for x in halves]
    assert values(spark, texts.shown_score, [84.25, 84.75, 84.35, 0.25], "double") == ["84.3", "84.8", "84.3", "0.3"]
    assert values(spark, texts.shown_percent, [0.125, 0.5, None], "double") == ["13%", "50%", "—"]
    assert values(spark, texts.title_case, ["gene_target", "ml"]) == ["Gene Target", "Ml"]


def test_clean_missing(spark):
    df = spark.createDataFrame([(1.0, " a "), (float("nan"), " \t"), (None, None)], "x double, s string")
    assert [tuple(r) for r in ids.clean_missing(df).collect()] == [(1.0, "a"), (None, None), (None, None)]
