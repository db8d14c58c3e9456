"""Centroid clustering, prefix trie and token files against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib
from pathlib import Path

import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F

from tessera.llm import lloyd, token_orc, trie
from tessera.llm.components import components
from tessera.llm.queries import byte_bpe_path

# --- components --------------------------------------------------------------------
@pytest.mark.parametrize("seed", [0, 1])
def test_components_against_union_find(spark, ws, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(30)] + [(5, 5)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"), ws)
    assert {r["node"]: r["comp"] for r in got.collect()} == {x: find(x) for x in top}
    assert components(spark.createDataFrame([], "a long, b long"), ws).isEmpty()


# --- 11 ----------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<double>, cluster string, id int, v int, distance string"


def plain_lloyd(rows, k, rounds, dim, scale=256, salt="2:"):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            held = [max(-(1 << 27), min(1 << 27, x * scale)) for x in v]
            kept.append((key, [math.floor(x) for x in held]))
    digest = lambda key: hashlib.sha256(f"{salt}{key}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else digest(r[0]), r[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((apart(v, c), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for c, members in groups.items():
            centres[c] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    found = [(key, nearest(v)[1], nearest(v)[0]) for key, v in kept]
    return sorted(found, key=repr), dict(enumerate(centres))


def vectors(seed, dim):
    rnd = random.Random(seed)
    rows = [(i, [rnd.uniform(-1, 1) + i % 3 for _ in range(dim)]) for i in range(120)]
    rows += [rows[5], rows[5], (None, rows[7][1]), (None, rows[8][1]), (500, None), (501, []), (502, [1.0] * (dim + 1))]
    rows += [(503, [None] + [0.0] * (dim - 1)), (504, [math.nan] * dim), (505, [math.inf] * dim)]
    rows += [(506, [1e30] + [0.0] * (dim - 1)), (507, [-1e-9] * dim), (508, [0.25] * dim), (509, [0.25] * dim)]
    return rows


@pytest.mark.parametrize(("dim", "k", "shards"), [(8, 7, 4), (5, 200, 3), (3, 4, 9), (6, 1, 1)])
def test_lloyd_against_plain_python(spark, ws, monkeypatch, dim, k, shards):
    monkeypatch.setattr(lloyd, "BLOCK_ROWS", 16)
    rows = vectors(dim, dim)
    df = spark.createDataFrame([(a, b, "x", 1, 2, "y") for a, b in rows], VECTORS).repartition(5)
    got, centres = lloyd.clustered(df, ws, k=k, rounds=3, dim=dim, shards=shards)
    want, plain = plain_lloyd(rows, k, 3, dim)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()), key=repr) == want
    assert {r["cluster"]: r["centroid"] for r in centres.collect()} == plain


def test_lloyd_without_vectors(spark, ws):
    df = spark.createDataFrame([(1, None, "x", 1, 2, "y")], VECTORS)
    for rows in (df, df.filter("false")):
        got, centres = lloyd.clustered(rows, ws, k=3, rounds=2, dim=4)
        assert got.columns == ["vec_id", "cluster", "distance"] and got.isEmpty() and centres.isEmpty()


# --- 12 ----------------------------------------------------------------------------
TURNS = "conv_id long, turn long, role string, text string, depth int, conv string, i int"


def plain_trie(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], order(r))):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - int(math.fmod(c, 100))
        built[c] = own.get(donor, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        under = [n for n in members if n[: len(node)] == node]
        inner = {n[:-1] for n in members if n}
        ends = sorted(c for c in convs if len(built[c]) == len(node))
        out.append(
            (
                min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                sum(n[:-1] == node for n in members if n), sum(n not in inner for n in under),
                sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def grown(spark, ws, rows):
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], TURNS).repartition(4)
    turns, sizes = trie.with_shared_openings(trie.ordered_turns(df, ws), ws)
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    got = trie.rolled_up(turns, sizes, ws)
    assert tuple(got.columns) == names
    return sorted((tuple(r) for r in got.collect()), key=repr)


def conversations():
    rnd = random.Random(4)
    texts = ["a", "bb", "", None, "é😀", "x" * 5000]
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 206, 999, -3, -100, -101]:
        for t in range(rnd.choice([1, 1, 2, 3, 4, 6, 9])):
            rows.append((c, rnd.choice([t, t, t, None]) if c % 4 == 0 else t, rnd.choice(["u", "u", None]), rnd.choice(texts[:3] if t < 2 else texts)))
    rows += [(300, t, "u", f"t{t}") for t in range(60)]  # one long chain
    rows += [(c, t, "u", f"t{t}") for c in range(301, 320) for t in range(8)]  # copies and a fork from it
    rows += [(7, 1, "u", "a"), (7, 1, "u", "a"), (7, 1, "b", "a"), (None, 1, "u", "a"), (None, None, None, None)]
    return rows


def test_trie_against_plain_python(spark, ws):
    assert grown(spark, ws, conversations()) == plain_trie(conversations())


def test_trie_of_one_conversation_and_of_none(spark, ws, monkeypatch):
    monkeypatch.setattr(trie, "IDS_AT_ONCE", 2)
    for rows in ([(42, None, None, None)], [(c, 0, "u", "t") for c in range(9)], [(None, 1, "u", "t")], []):
        assert grown(spark, ws, rows) == plain_trie(rows)


def test_subtree_sums_of_a_chain_take_few_rounds(spark, ws, monkeypatch):
    n, rounds = 300, []
    monkeypatch.setattr(type(ws), "store", lambda self, name, df, plain=type(ws).store: (rounds.append(name), plain(self, name, df))[1])
    turns = spark.range(1, n + 1).select(F.lit(5).cast("long").alias("conv"), F.col("id").alias("i"), F.col("id").cast("string").alias("digest"), F.lit(2).cast("long").alias("chars"))
    tree, paths = trie.trie(turns, trie.lengths(turns), ws)
    sums = trie.subtree_sums(tree.withColumn("one", F.lit(1)), paths, ["one"], ws)
    assert {r["depth"]: r["one"] for r in sums.collect()} == {d: n + 1 - d for d in range(n + 1)}
    assert rounds.count("marked") <= math.log2(n + 1) + 2


# --- 13 ----------------------------------------------------------------------------
DOCS = "doc_id long, text string, slice string, at string, ids int, n_tokens int"


def texts():
    odd = [None, "", " ", "\n\n", "one <|endoftext|> two", "a" * 20_000, "word " * 30_000, "\U0001f600 é\x00", "x"]
    return [(i * 3 % 101, t) for i, t in enumerate(odd * 4)] + [(None, "no id"), (None, None), (50, "x"), (50, "x"), (50, "y"), (-4, "z")]


def plain_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(byte_bpe_path()).encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_have_the_ids_of_their_text(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(byte_bpe_path())
    plain = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    rnd = random.Random(9)
    signs = ["a", "Bc", "don't", "'s", "12", "é", "\u00df\u4e2d", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\u3000", "\x1c", "\x85", "\u200b", ".", "!?", "<|endoftext|>", "\U0001f600", "e\u0301", "\x00", "\u0660", "\u00d7", "\u024f", "\u01c5", "\u02b0", "'Ll", "_"]
    texts = ["", " ", "  a", "a  ", " a b ", "a <|endoftext|> b", "a\n b", "a \nb", " \n ", "x" * 300 + " y"]
    texts += ["".join(rnd.choice(signs) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(1, 30))) for _ in range(4000)]
    monkeypatch.setattr(token_orc, "REMEMBERED", 500)
    encoder = token_orc.Encoder(tokenizer)
    for t in texts:
        assert memoryview(encoder.encode(t)).cast("i").tolist() == plain(t), t


def written(spark, ws, rows):
    path = ws.path("ids")
    df = spark.createDataFrame([(*r, "s", "a", 1, 2) for r in rows], DOCS).repartition(6)
    token_orc.write(df, path, byte_bpe_path())
    return path


def test_token_files_against_the_library(spark, ws):
    path = written(spark, ws, texts())
    files = token_orc.read(spark, path)
    got = token_orc.starts(token_orc.checksums(files), files).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in texts()), key=lambda d: (d is not None, d or 0))
    place = 0
    for r in got:
        assert r["start"] == place
        place += r["n_tokens"]
    want = {}
    for d, t in texts():
        ids = plain_ids(t)
        want.setdefault(d, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {d: sorted(x) for d, x in have.items()} == {d: sorted(x) for d, x in want.items()}
    back = sorted(((r["doc_id"], r["text"]) for r in token_orc.decoded(files, byte_bpe_path()).collect()), key=repr)
    assert back == sorted(((d, t or "") for d, t in texts()), key=repr)


def test_token_files_without_documents(spark, ws):
    path = ws.path("ids")
    token_orc.write(spark.createDataFrame([], DOCS), path, byte_bpe_path())
    files = token_orc.read(spark, path)
    assert token_orc.starts(token_orc.checksums(files), files).collect() == []


def rows_read(found):
    found.collect()
    todo, total = [found._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_token_files_are_pruned_by_strides_and_bloom_filters(spark, ws):
    path = ws.path("ids")
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    token_orc.write(docs.coalesce(1), path, byte_bpe_path())
    facts = [orc.ORCFile(f) for f in Path(path).glob("*.orc")]
    assert sum(f.nrows for f in facts) == 20_000 and all(f.row_index_stride == token_orc.STRIDE for f in facts)
    assert all(f.file_version == "0.12" and f.compression == "ZSTD" for f in facts)  # run-length encoding 2
    one = token_orc.find(spark, path, [12_344])
    assert [r["doc_id"] for r in one.collect()] == [12_344] and rows_read(one) <= 2 * token_orc.STRIDE
    none = token_orc.find(spark, path, [12_345])  # within the range of a stride; only its Bloom filter can tell
    assert rows_read(none) == 0
