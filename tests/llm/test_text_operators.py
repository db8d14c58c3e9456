"""Text operators against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, jaccard, line_dedup, mixing, pii, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept string, n_lines int, key int, row int"
SPACE = " \t\n\x0b\x0c\r"


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def words(t):
    return [w for w in re.split("[ \t-\r]+", t or "") if w]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def odd_texts():
    rnd = random.Random(3)
    vocab = ["the", "of", "Über", "naïve", "ab", "cd", "ef", "x1", " ", "idiot", "end.", "A"]
    shared = "A line that many documents share, longer than forty characters."
    texts = [None, "", " ", "\n\n", "one", "one two", "\t\x0b a \r\n", "a" * 50_000, "word " * 30_000, "\U0001f600 é"]
    for i in range(60):
        t = " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 80)))
        if i % 4 == 0:
            t += "\n  " + (shared.upper() if i % 8 else shared) + " \n" + shared
        texts.append(t)
    base = [rnd.choice("abcdefgh") + str(rnd.randint(0, 999)) for _ in range(60)]
    for i in range(12):  # near copies, some of them linked only through others
        copy = list(base)
        for _ in range(i):
            copy[rnd.randrange(60)] = f"edit{rnd.randint(0, 10**6)}"
        texts.append(" ".join(copy))
    return texts + texts[20:24]


@pytest.fixture(scope="module")
def docs(spark):
    texts = odd_texts()
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, "x", "y", 7, 8, 9) for i, t in enumerate(texts)]
    rows += [rows[30], rows[30], (None, texts[31], None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 7 -----------------------------------------------------------------------------


def measures(t):
    t = t or ""
    w = words(t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_quality_measures(docs):
    got = quality.judge(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        m = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert m == measures(r.text)
        assert r.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0])
        assert not (r.base_failed and r.kept)


def test_quality_rules_are_data(spark):
    df = spark.createDataFrame([(1, "the cat " * 2 + " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    strict = quality.judge(df, rules=[quality.Rule("long words", "mean_word_chars", least=50)]).first()
    assert strict.failed == ["long words"] and not strict.kept
    assert quality.judge(df, rules=[]).first().kept


# --- 6 -----------------------------------------------------------------------------


def test_line_dedup(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    hold = defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            k = low(x.strip(SPACE))
            if len(k) >= 40 and i is not None:
                hold[k].add(i)

    def stays(i, x):
        k = low(x.strip(SPACE))
        return i is None or len(k) < 40 or len(hold[k]) < 5 or max(hold[k]) == i

    want = []
    for i, t in rows:
        left = [x for x in t.split("\n") if stays(i, x)]
        want.append((i, len(t.split("\n")), len(t.split("\n")) - len(left), "\n".join(left)))
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.deduped(docs).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] for r in got) > 10


def test_line_bitmaps_hold_runs(spark):
    line = "x" * 45
    df = spark.createDataFrame([(i, f"{line}\na\n{line}\nb") for i in range(6)], "doc_id long, text string")
    maps = {r.doc: [tuple(k) for k in r.keep] for r in line_dedup.keep_bitmaps(df).collect()}
    assert maps == {i: [(0, 0), (1, 1), (3, None)] for i in range(5)}


# --- 3 -----------------------------------------------------------------------------

PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def spans(t):
    out = []
    for rank, (kind, pattern) in enumerate(PII):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def test_pii_spans(spark):
    rnd = random.Random(8)
    parts = ["1", "34", ".", " ", "-", "+", "@", "a", "b.c", "é", "\n", "\U0001f600", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "x@y.z", "(", ")", "+1 (017) 555-7713"]
    texts = [None, "", "a" * 20_000 + "@", "1" * 20_000, "x@y.z " * 2000, "a@" + "b." * 5000 + "c"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df).collect():
        t = texts[r.doc_id]
        if t and len(t) == 20_000 + (t[-1] == "@"):
            assert not r.spans
            continue
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE] == spans(t)


def test_pii_checksums_and_context(spark):
    texts = [
        "IBAN DE89 3704 0044 0532 0130 00 here", "IBAN DE88 3704 0044 0532 0130 00 here",
        "my ssn is 123-45-6789", "number 123-45-6789", "ssn 666-45-6789", "xGB82WEST12345698765432",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in pii.find(df).collect()}
    assert kinds == {0: ["iban"], 1: [], 2: ["ssn"], 3: [], 4: [], 5: []}


def test_secrets_are_found_by_shape_and_context(spark):
    rnd = random.Random(4)
    hexed = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    planted = [f'x token = "{hexed(40)}" y' for _ in range(30)] + [f"password: {hexed(24)}," for _ in range(10)]
    planted += ["id AKIA" + "ABCD1234EFGH5678", "use ghp_" + "a1B2c3D4e5" * 3 + "abcdef now", "-----BEGIN RSA PRIVATE KEY-----\nMII", "-----BEGIN PRIVATE KEY-----"]
    clean = [f"commit {hexed(40)}", "token abcdefghijklmnopqrstuvwxyz", "token " + "1" * 40, "key " + "a1" * 20, "my key is lost", "tokenised 12345678901234567890x",
             "token " + "a1b2c3d4e5" * 3000, "-----BEGIN CERTIFICATE-----", "xAKIA" + "ABCD1234EFGH5678", ""]
    df = spark.createDataFrame(list(enumerate(planted + clean)), "doc_id long, text string")
    hits = {r.doc_id for r in pii.find(df).collect() if any(s.kind in pii.SECRETS for s in r.spans)}
    assert hits == set(range(len(planted)))
    score = {r.doc_id: max(s.score for s in r.spans) for r in pii.find(df.limit(1)).collect()}
    assert abs(score[0] - 0.6) < 1e-9


# --- 1 -----------------------------------------------------------------------------

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_bpe_is_the_library_s(docs):
    library = Tokenizer.from_file(PATH)
    got = bpe.encode(docs, PATH, decoded=True).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_bpe_odd_text():
    library, own = Tokenizer.from_file(PATH), bpe.Encoder(PATH)
    rnd = random.Random(4)
    signs = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x1F600, 0x4E2D, 0x130, 0x3A3]]
    signs += ["<|endoftext|>", "<|startoftext|>", "<|", "it's", "we'll", "ab" * 30, "aaa"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    ids, counts = own.encode(texts)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == library.encode(t, add_special_tokens=False).ids
        at += n


def test_bpe_decodes_id_lists(spark):
    df = spark.createDataFrame([(1, [0, 49407, 10**6, -1]), (2, []), (3, None)], "i int, ids array<int>")
    got = {r.i: r.t for r in df.select("i", bpe.decode(df.ids, PATH).alias("t")).collect()}
    assert got == {1: "! <|endoftext|>", 2: "", 3: ""}


# --- 9 -----------------------------------------------------------------------------


def shingles(t):
    w = low(t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(rows):
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for a, s in sets:
        for b, t in sets:
            if a < b and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), top(i)) for i, s in sets}


@pytest.mark.parametrize("seed", [1])
def test_jaccard_classes(spark, ws, seed):
    rnd = random.Random(seed)
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    passage = " ".join(f"p{i}" for i in range(30))
    base = [f"b{rnd.randint(0, 10**6)}" for _ in range(120)]
    short = [f"s{i}" for i in range(24)]
    for _ in range(60):  # one large group of near copies
        copy = list(base)
        for _ in range(rnd.randint(0, 6)):
            copy[rnd.randrange(120)] = f"e{rnd.randint(0, 10**6)}"
        rows.append((len(rows), " ".join(copy)))
    for _ in range(60):  # small sets
        copy = short[: rnd.randint(5, 24)]
        if rnd.random() < 0.5:
            copy[rnd.choice([0, -1])] = f"e{rnd.randint(0, 3)}"
        rows.append((len(rows), " ".join(copy).upper()))
    for _ in range(20):  # unlike documents with a passage in common
        rows.append((len(rows), " ".join(f"u{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(5, 40))) + " " + passage))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in jaccard.classes(df, ws).collect()}
    assert got == linked(rows)


def test_jaccard_odd_rows(docs, ws):
    got = jaccard.classes(docs, ws).collect()
    assert len(got) == docs.count()
    want = {(i, n, c) for i, n, c in linked([(r.doc_id, r.text) for r in docs.dropna(subset=["doc_id"]).distinct().collect()])}
    assert {tuple(r) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_jaccard_boundary_follows_cost():
    import numpy as np

    sizes = np.zeros(jaccard.MOST_LIGHT + 1, np.int64)
    sizes[5:20] = 1000
    assert jaccard.cheapest_boundary(sizes, 1.0) <= jaccard.cheapest_boundary(sizes, 1000.0) == jaccard.MOST_LIGHT


# --- 8 -----------------------------------------------------------------------------


def test_mixing_meets_margins(spark, ws, monkeypatch):
    rnd = random.Random(2)
    rows = [
        (i, "w " * rnd.randint(1, 400), rnd.choice(["en", "de"]), rnd.choice(["a", "a", "a", "b", None]))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {
        "source": {"a": 0.3, "b": 0.5, "unknown": 0.2},
        "lang": {"en": 0.5, "de": 0.5},
    }
    cells = mixing.cells_of(mixing._placed(df, "doc_id", "text"), ("source", "lang", "topic"))
    targets = {d: spark.createDataFrame(list(x.items()), "value string, share double") for d, x in want.items()}
    fitted = mixing.raked(cells, targets, ws).collect()
    for d, shares in want.items():
        for v, share in shares.items():
            assert sum(r.weight for r in fitted if r[d] == v) == pytest.approx(share, abs=1e-6)
    mixing_cells = {(r.source, r.lang, r.topic): r.weight for r in fitted}
    monkeypatch.setattr(mixing, "CELLS_PER_TASK", 3)
    for r in mixing.raked(cells, targets, ws).collect():
        assert r.weight == pytest.approx(mixing_cells[r.source, r.lang, r.topic], abs=1e-9)
    drawn = mixing.mixed(df, ws, targets).collect()
    assert max(r.probability for r in drawn) == pytest.approx(1.0)
    expected = sum(r.probability for r in drawn)
    assert abs(sum(r.kept for r in drawn) - expected) < 5 * expected**0.5


def test_raking_says_when_targets_contradict_each_other(spark, ws):
    cells = spark.createDataFrame([("a", "x", 10), ("b", "y", 10)], "source string, lang string, tokens long")
    share = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    targets = {"source": share({"a": 0.9, "b": 0.1}), "lang": share({"x": 0.2, "y": 0.8})}
    assert all(r.deviation > 0.1 for r in mixing.raked(cells, targets, ws, rounds=3).collect())
    targets["lang"] = share({"x": 0.9, "y": 0.1})
    got = {r.source: r for r in mixing.raked(cells, targets, ws).collect()}
    assert got["a"].weight == pytest.approx(0.9) and got["a"].deviation <= mixing.TOLERANCE


def test_mixing_odd_rows(docs, empty, ws):
    got = mixing.mixed(docs, ws).collect()
    assert len(got) == docs.count()
    assert all(r.n_tokens == len(words(next(d.text for d in docs.collect() if d.doc_id == r.doc_id))) for r in got[:10])
    assert not any(r.kept for r in got if not r.n_tokens)
    assert mixing.mixed(empty, ws).count() == 0
    assert set(mixing.sampled(docs, ws).columns) == set(docs.columns)


# --- 2 -----------------------------------------------------------------------------


def test_toxicity_learns_and_generalises(spark, ws):
    rnd = random.Random(6)
    vocab = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu") for b in ("lan", "mir", "nos", "per")]
    rows, labels = [], []
    for i in range(600):
        t = [rnd.choice(vocab) for _ in range(rnd.randint(5, 80))]
        if i % 4 == 0:
            for _ in range(1 + len(t) // 20):
                t.insert(rnd.randrange(len(t)), rnd.choice(["vilemuck", "Vilemucks"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(9000, None), (9001, ""), (None, "vilemuck")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if x[0] < 400] + [(None, 1), (5, None), (7, 3)], "doc_id long, label int")
    model = toxicity.fit(docs, known, ws)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= 0.5, r.doc_id % 4 == 0) for r in got if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)


def test_toxicity_without_labels(spark, ws):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert toxicity.score(docs, toxicity.fit(docs, none, ws)).first().score < 0.5


# --- all ---------------------------------------------------------------------------


def test_empty_tables(empty, ws):
    assert quality.judge(empty).count() == 0
    assert line_dedup.deduped(empty).count() == 0
    assert pii.find(empty).count() == 0
    assert bpe.encode(empty, PATH, decoded=True).count() == 0
    assert jaccard.classes(empty, ws).count() == 0
