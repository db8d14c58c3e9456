"""Every text query with an SQL twin returns the same rows, on the two smaller folders."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import jaccard, warc
from tessera.llm.queries import QUERIES
from tessera.llm.sql import TWINS

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
GIVEN = pytest.mark.skipif(not Path(LARGER).exists(), reason="given tables not present")


def same_rows(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, cur = QUERIES[name](spark, folder), con.execute(TWINS[name])
    want = [d[0] for d in cur.description]
    order = sorted(want)
    assert sorted(got.columns) == order
    rows = lambda records, names: sorted((tuple(r[names.index(c)] for c in order) for r in records), key=repr)
    assert rows(got.collect(), got.columns) == rows(cur.fetchall(), want)


@GIVEN
@pytest.mark.parametrize("name", sorted(TWINS))
def test_same_rows(spark, name):
    same_rows(spark, name, FOLDER)


@GIVEN
@pytest.mark.parametrize("name", ["op10_warc", "op11_centroid_clustering", "op12_prefix_trie"])
def test_same_rows_on_the_larger_folder(spark, name):
    same_rows(spark, name, LARGER)


def test_names():
    numbers = [int(n[2:].split("_")[0]) for n in QUERIES]
    assert numbers == list(range(1, 14)) and len(corpus_pipeline.STAGES) == 5


def test_jaccard_ties_every_text_of_a_repeated_id(spark, ws):
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcd"}
    rows = [(1, text["a"]), (3, text["b"]), (4, text["b"]), (5, text["c"]), (8, text["d"])] + [(9, text[k]) for k in "abc"]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.classes(docs, ws).collect()}
    assert got == {(1, 1), (3, 1), (4, 1), (5, 1), (9, 1), (8, 8)}


def test_warc_keeps_what_follows_an_open_head(spark):
    pages = {
        "<html><head><title>T</title><body><p>one</p><script>x</script>two</body>": "one\ntwo",
        "<head><meta a=b><title>a <p> b</title><link><p>one<nav>n</nav>two": "one two",
        "<head><title>T</title><a href=x>one</a>": "one",
        "<head><script>'<p>hid'</script><style>a{}</style><title>T</title></head><body>one": "one",
        "one<nav>a<script>b</script>c</nav>two": "one two",
        "<noscript><style>a</style>hid</noscript>one<header>two</header>": "one\ntwo",
        "<head><title>T": "",
        "one<script>hid": "one",
        "one<!-- <nav> -->two": "one two",
        "<HEAD>" + "<meta x>" * 20000 + "<Body>one": "one",
        None: None,
    }
    rows = spark.createDataFrame([(h,) for h in pages], "html string")
    got = {r["html"]: r["text"] for r in rows.select("html", warc.plain_text(rows["html"]).alias("text")).collect()}
    assert got == pages
