"""Every pipeline stage on small odd documents, against SQL or the library over its own input."""

from __future__ import annotations

import hashlib
import random

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tessera.llm.queries import word_bpe_path
from tessera.llm.sql import TWINS

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int, weight double, `_rest` string"


def documents():
    rnd = random.Random(12)
    stops = ["the", "of", "and", "to", "in", "a", "is", "that"]
    vocab = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha") for b in ("lan", "mir", "nos", "per", "tul")]
    prose = lambda n: " ".join(rnd.choice(stops if rnd.random() < 0.4 else vocab) for _ in range(n))
    shared = "A line that many of the documents share, longer than forty characters."
    texts = [prose(rnd.randint(30, 200)) for _ in range(60)]
    texts += [f"{prose(40)}\n  {shared.upper() if i % 2 else shared} \n{prose(30)}" for i in range(8)]
    texts += [texts[3]] * 3 + [" ".join(["odd", *texts[4].split()]), " ".join([*texts[4].split(), "end"])]
    texts += [None, "", " \n\t", "one", "# $ % & " * 30, "again and again " * 40, prose(6000), "é😀 " + prose(50)]
    rows = [(i, t, "en" if i % 3 else None, ["a", "a", "a", "b", None][i % 5], len(t or ""), "x", 1, 0.5, "r") for i, t in enumerate(texts)]
    return [*rows, rows[30], (None, texts[31], "de", "c", 9, None, None, None, None)]


@pytest.fixture(scope="module")
def stages(spark):
    """name -> (input, output) of every stage over all that the one before kept."""
    docs = spark.createDataFrame(documents(), SCHEMA).repartition(3)
    ws, done = corpus_pipeline._workspace(spark, "test"), {}
    docs = ws.store("documents", docs)
    for name, stage in corpus_pipeline.STAGES:
        out = ws.store(name, stage(spark, docs, "none"))
        done[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()])
        if name != "bpe":
            assert out.schema == docs.schema
        docs = out
    return done


def by_sql(rows, name):
    """The stage's operator in SQL, over the rows with an id, each id once."""
    named = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(list(named.values())).astype({"doc_id": "int64"}))
    return {r[0]: r for r in con.execute(f"select doc_id, * exclude (doc_id) from ({TWINS[name]})").fetchall()}


def columns(name):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    cur = con.execute(f"select doc_id, * exclude (doc_id) from ({TWINS[name]})")
    return [d[0] for d in cur.description]


def judged(rows, name, column):
    at = columns(name).index(column)
    return {k: r[at] for k, r in by_sql(rows, name).items()}


def ids(rows):
    return sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)


def test_quality_keeps_what_the_rules_keep(stages):
    given, left = stages["quality_rules"]
    kept = judged(given, "op7_quality_rules", "kept")
    assert ids(left) == sorted(i for i in ids(given) if kept[i])
    assert {i for i, t in enumerate(d[1] for d in documents()[:-2]) if len((t or "").split()) < 20}.isdisjoint(ids(left))
    assert len(ids(left)) > 60 and sum(r["doc_id"] is None for r in left) == 1


def test_line_dedup_changes_texts_only(stages):
    given, left = stages["line_dedup"]
    assert ids(left) == ids(given) and sum(r["doc_id"] is None for r in left) == 1
    want = judged(given, "op6_line_dedup", "kept_sha256")
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in left if r["doc_id"] is not None} == want
    assert all(r["n_chars"] == len(r["text"]) for r in left)
    assert sum("many of the documents share" in r["text"].lower() for r in left) == 1


def test_one_document_of_each_group_stays(stages):
    given, left = stages["near_duplicates"]
    group = judged(given, "op9_ngram_jaccard_join", "component_id")
    assert ids(left) == sorted(i for i, c in group.items() if i == c)
    assert 3 in ids(left) and not {68, 69, 70, 71, 72} & set(ids(left))
    text = {r["doc_id"]: r["text"] for r in given}
    assert all(text[r["doc_id"]] == r["text"] for r in left)


def test_mixing_keeps_the_documents_it_draws(stages):
    given, left = stages["mixing"]
    assert 0 < len(left) < len(given)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(given).astype({"doc_id": "Int64"}))
    at = columns("op8_mixing").index("kept")
    rows = con.execute(f"select doc_id, * exclude (doc_id) from ({TWINS['op8_mixing']})").fetchall()
    assert len(rows) == len(given)
    assert sorted((r["doc_id"] for r in left), key=str) == sorted((r[0] for r in rows if r[at]), key=str)


def test_encoding_is_the_library_s(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_bpe_path())
    given, out = stages["bpe"]
    want = {}
    for r in given:
        found = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        told = hashlib.sha256(tokenizer.decode(found, skip_special_tokens=False).encode()).hexdigest()
        want[r["doc_id"]] = (found, len(found), hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest(), told)
    assert {r["doc_id"]: (r["ids"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out} == want


def test_stages_of_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, "none")
        assert out.isEmpty() and (name == "bpe" or out.columns == none.columns)
