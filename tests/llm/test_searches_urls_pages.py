"""Top-k search, URL filter and page derivatives on odd rows, against plain Python or SQL."""

from __future__ import annotations

import math
import random

import duckdb
import pandas as pd

from tessera.llm import covertree, urls, warc
from tessera.llm.sql import TWINS


def by_sql(name, table, rows, columns):
    con = duckdb.connect()
    con.register(table, pd.DataFrame(rows, columns=columns).astype({columns[0]: "Int64"}))
    cur = con.execute(TWINS[name])
    names = [d[0] for d in cur.description]
    return names, sorted((tuple(None if pd.isna(v) else v for v in r) for r in cur.fetchall()), key=repr)


def as_rows(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# --- 4 -----------------------------------------------------------------------------
def plain_top(rows, k, every):
    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in sound:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in sound if i != q and len(w) == len(v))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_of_odd_rows(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(i, list(rows[7][1])) for i in range(300, 330)] + [rows[100], rows[40], (100, [0.5] * 6)]  # ties and repeats
    rows += [(400, None), (None, [0.1] * 6), (401, [None] * 6), (402, [math.nan] * 6), (403, [math.inf] + [0.0] * 5), (500, []), (501, [])]
    rows += [(600, [1.0, 2.0]), (601, [1.0, -2.0]), (700, [0.25] * 3)]
    schema = "vec_id long, embedding array<double>, score string, rank string, query_id string, id int, v string"
    df = spark.createDataFrame([(*r, "a", "b", "c", 1, "d") for r in rows], schema).repartition(4)
    got = covertree.top_k(df, k=10, every=100)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == plain_top(rows, 10, 100)
    assert covertree.top_k(df.filter("false"), k=10, every=100).isEmpty()


# --- 5 -----------------------------------------------------------------------------
URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/de/x", "http://a.b.example.com/de", "http://example.com/de/?q#f", "ftp://x.NET",
    "http://net/", "http://example.net/en/a", "http://sub.example.net/en/", "http://example.net/EN/", "http://wiki.org/fr/page?x", "http://org/fr/",
    "http://notexample.com/de/", "http://example.com./de/", "http://.net/", "http://a..net/x", "http://x.net?y", "http://x.org/fr#z", "http://é.org/fr/ü",
    "a://b://c.net/", "http://" + "a." * 400 + "net/", "http://x.net/" + "p" * 50_000, "://net/", "http://user@x.net:80/",
]


def test_url_verdicts_of_odd_rows(spark):
    rows = [(i if i % 7 else None, u, "h", "p", "r", 3) for i, u in enumerate(URLS + URLS[3:9])]
    schema = "page_id long, url string, host string, path string, rule string, row int"
    df = spark.createDataFrame(rows, schema).repartition(3)
    named = [r for r in rows if r[0] is not None]
    columns = ["page_id", "url", "host", "path", "rule", "row"]
    names, want = by_sql("op5_url_filters", "pages", named, columns)
    assert as_rows(urls.judge(df).filter("page_id is not null"), names) == want
    assert urls.judge(df).count() == len(rows) and urls.judge(df.filter("false")).isEmpty()


# --- 10 ----------------------------------------------------------------------------
PAGES = [
    None, "", " ", "plain", "<html><head><title>T</title></head><body><p>one</p>two</body></html>", "<p>a</p>" * 20_000, "a &amp; b &lt;c&gt; &nbsp;",
    "<script>hid</script>seen<style>p{}</style>", "é😀<br>x", "line\nbreak\r\nend", "<div>1</div><div>2</div>", "<b>bold</b>text", "x" * 100_000,
]


def test_derivatives_of_odd_pages(spark):
    rows = [(i, f"http://x.org/{i}", h, "m", "c", "d", 1) for i, h in enumerate(PAGES)]
    rows += [(3, "http://x.org/3", "plain", "m", "c", "d", 1), (50, "", "t", "m", "c", "d", 1)]
    rows += [(51, "u\r\n\r\nx", "<p>t", "m", "c", "d", 1), (52, "a\nb", "t", "m", "c", "d", 1), (53, None, "t", "m", "c", "d", 1)]
    schema = "page_id long, url string, html string, record_type string, block string, date string, body int"
    columns = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame(rows, schema).repartition(3)
    names, want = by_sql("op10_warc", "pages", rows, columns)
    got = warc.derive(warc.as_responses(df))
    assert as_rows(got, names) == want
    assert warc.derive(warc.as_responses(df.filter("false"))).isEmpty()
