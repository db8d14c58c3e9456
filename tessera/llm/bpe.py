"""Byte-pair encoding and decoding with a given merge table.

The words of a batch are laid out one after the other. An index maps each pair of
neighbouring symbols that has a rank to all its places; active ranks are applied in
ascending order, all places of a pair at once, and the lists of the pairs beside them
are updated. A worker remembers encoded words, within a bound.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shipping import ship

#: Words that a worker remembers; beyond it the older half is forgotten.
REMEMBERED = 300_000
#: Text handed to the index at once.
BATCH_BYTES = 3_000_000
# fixed values: words of the vocabulary's own splitting rule
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"
_WORD = re.compile(_CONTRACTED + r"|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_ASCII_WORD = re.compile(_CONTRACTED + r"|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: Texts of these letters and signs are split alike by the rules above and the file's own
#: splitter; any other text goes through the file's.
_KNOWN = re.compile("[\t\n\r -~\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u0200\u2010-\u2027]*+")
_NO_RANK = 1 << 60


def _byte_letters() -> list[str]:
    """The printable stand-in of every byte value in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Symbols, merge ranks and special tokens of one file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        letters = _byte_letters()
        self.inner = np.array([ids.get(c, -1) for c in letters], dtype=np.int64)
        self.last = np.array([ids.get(c + self.suffix, -1) for c in letters], dtype=np.int64)
        self.pairs = [(ids[a], ids[b]) for a, b in model["merges"]]
        self.merged = np.array([ids[a + b] for a, b in model["merges"]], dtype=np.int64)
        self.ranks = {pair: rank for rank, pair in reversed(list(enumerate(self.pairs)))}
        self.width = max(ids.values()) + 1
        keys = np.array([a * self.width + b for a, b in self.ranks], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_of_key = keys[order], np.array(list(self.ranks.values()))[order]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = np.array(_by_id({**ids, **self.special}), dtype=object)
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        own = Tokenizer.from_file(path)
        self.own_normal, self.own_split = own.normalizer, own.pre_tokenizer
        self.byte_of = {c: b for b, c in enumerate(letters)}

    def words(self, text: str) -> list[str]:
        """The words of a text in order. A special token is one word; no other word is like it."""
        if self.marks is None or "<|" not in text:
            return self._plain(text)
        parts = self.marks.split(text)
        return list(
            chain.from_iterable([p] if i % 2 else self._plain(p) for i, p in enumerate(parts))
        )

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII_WORD.findall(text.lower())
        if _KNOWN.fullmatch(text):
            return _WORD.findall(unicodedata.normalize("NFC", text).lower())
        split = self.own_split.pre_tokenize_str(self.own_normal.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in split]


def _by_id(ids: dict[str, int]) -> list[str | None]:
    out: list[str | None] = [None] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = token
    return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and how many each word has, by one pair index over them."""
    symbols, lengths = _laid_out(words, v)
    word_of = np.repeat(np.arange(len(words)), lengths)
    here = np.arange(len(symbols))
    ends = np.cumsum(lengths)
    after, before = here + 1, here - 1
    after[ends[lengths > 0] - 1] = -1
    before[(ends - lengths)[lengths > 0]] = -1
    index = _PairIndex(v)
    index.add(here[after >= 0], symbols, after)
    again: list[np.ndarray] = []
    while index.active:
        rank, place = index.lowest()
        a, b = v.pairs[rank]
        place = _fitting(place, a, b, symbols, after)
        if not len(place):
            continue
        gone = after[place]
        beyond = after[gone]
        symbols[place], symbols[gone] = v.merged[rank], -1
        after[place] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = place[inner]
        left = before[place]
        beside = np.concatenate([place[inner], left[left >= 0]])
        sooner = beside[index.add(beside, symbols, after) < rank]
        if len(sooner):
            again.append(word_of[sooner])
    left_over = symbols >= 0
    ids, counts = symbols[left_over], np.bincount(word_of[left_over], minlength=len(words))
    if again:  # a pair that ranks before the one that made it: these words go one merge at a time
        ids, counts = _replaced(ids, counts, np.unique(np.concatenate(again)), words, v)
    return ids, counts


class _PairIndex:
    """The places of every pair that has a rank, by rank, and a heap of active ranks."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, place: np.ndarray, symbols: np.ndarray, after: np.ndarray) -> np.ndarray:
        """List places under the pair that stands there now; returns each one's rank."""
        if not len(place):
            return place
        keys = symbols[place] * self.v.width + symbols[after[place]]
        at = np.minimum(np.searchsorted(self.v.keys, keys), len(self.v.keys) - 1)
        ranks = np.where(self.v.keys[at] == keys, self.v.rank_of_key[at], _NO_RANK)
        order = np.argsort(ranks, kind="stable")
        sorted_ranks, sorted_places = ranks[order], place[order]
        cuts = np.flatnonzero(np.diff(sorted_ranks, prepend=-1))
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            rank = int(sorted_ranks[i])
            if rank == _NO_RANK:
                break
            if rank in self.places:
                self.places[rank].append(sorted_places[i:j])
            else:
                self.places[rank] = [sorted_places[i:j]]
                heapq.heappush(self.active, rank)
        return ranks

    def lowest(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.active)
        return rank, np.unique(np.concatenate(self.places.pop(rank)))


def _fitting(place: np.ndarray, a: int, b: int, symbols: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The places where the pair still stands; of overlapping ones, each second is left out."""
    place = place[symbols[place] == a]
    place = place[after[place] >= 0]
    place = place[symbols[after[place]] == b]
    if a != b:
        return place
    taken: list[int] = []
    last = -1
    for p in place.tolist():
        if p != last:
            taken.append(p)
            last = int(after[p])
    return np.array(taken, dtype=place.dtype)


def _laid_out(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """First symbols of all words in a row, and their number per word."""
    coded = [w.encode() for w in words]
    sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    data = np.frombuffer(b"".join(coded), dtype=np.uint8)
    symbols = v.inner[data]
    ends = np.cumsum(sizes)[sizes > 0] - 1
    symbols[ends] = v.last[data[ends]]
    known = symbols >= 0
    owner = np.repeat(np.arange(len(words)), sizes)
    return symbols[known], np.bincount(owner[known], minlength=len(words))


def _replaced(ids, counts, which, words, v) -> tuple[np.ndarray, np.ndarray]:
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for i in which.tolist():
        parts[i] = np.array(_one_by_one(words[i], v), dtype=ids.dtype)
    return np.concatenate(parts), np.array([len(x) for x in parts])


def _one_by_one(word: str, v: Vocabulary) -> list[int]:
    """The lowest rank first, leftmost first, until no pair has a rank."""
    symbols = _laid_out([word], v)[0].tolist()
    while True:
        pairs = [(v.ranks.get(x, _NO_RANK), i) for i, x in enumerate(zip(symbols, symbols[1:], strict=False))]
        rank, i = min(pairs, default=(_NO_RANK, 0))
        if rank == _NO_RANK:
            return symbols
        symbols[i : i + 2] = [int(v.merged[rank])]


class Encoder:
    """Encodes texts; remembers words between batches and tasks of one worker."""

    def __init__(self, path: str) -> None:
        self.v = vocabulary(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        numbers = _Numbers()
        rows = [
            np.fromiter(map(numbers.__getitem__, self.v.words(t)), dtype=np.int64) for t in texts
        ]
        ids, counts = self._learned(list(numbers))
        starts = np.cumsum(counts) - counts
        used = np.concatenate(rows) if rows else np.empty(0, np.int64)
        per_text = [int(counts[r].sum()) for r in rows]
        each = counts[used]
        at = np.repeat(starts[used] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        return ids[at], np.array(per_text, dtype=np.int64)

    def _learned(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts: list[bytes | None] = []
        unknown = []
        for w in words:
            ids = self.young.get(w)
            if ids is None and (ids := self.old.get(w)) is not None:
                self.young[w] = ids
            if ids is None and w in self.v.special:
                ids = np.int32(self.v.special[w]).tobytes()
            if ids is None:
                unknown.append(w)
            parts.append(ids)
        if unknown:
            fresh, counts = encode_words(unknown, self.v)
            data, ends = fresh.astype(np.int32).tobytes(), (np.cumsum(counts) * 4).tolist()
            found = dict(
                zip(unknown, (data[i:j] for i, j in zip([0, *ends], ends, strict=False)), strict=True)
            )
            self.young.update(found)
            parts = [found[w] if p is None else p for w, p in zip(words, parts, strict=True)]
        if len(self.young) > REMEMBERED // 2:
            self.young, self.old = {}, self.young
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        return np.frombuffer(b"".join(parts), dtype=np.int32), sizes


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of a column of at most BATCH_BYTES each, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > BATCH_BYTES:
            yield at, i - at
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes) - at


def encode(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False
) -> DataFrame:
    """Key and ``ids`` (array of int) of every whole text; null counts as empty. With
    ``decoded`` also the text that the ids decode to, in the same pass.

    ``path`` names a vocabulary file that every executor has. Rows stay where they are, so
    there is no shuffle; repeated rows give repeated rows, an empty table an empty one, and
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for at, size in _pieces(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(at, size).to_pylist()]
                ids, counts = encoder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                columns = [batch.column(0).slice(at, size), listed]
                if decoded:
                    bounds = zip(offsets.tolist(), offsets[1:].tolist(), strict=False)
                    columns.append(pa.array([decode_ids(ids[i:j], encoder.v) for i, j in bounds], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, ids array<int>" + (", decoded string" if decoded else "")
    names = ["key", "ids", *(["decoded"] if decoded else [])]
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(ids: Column, path: str) -> Column:
    """The text of an id list, special tokens included: tokens joined by one space, as the
    file names no decoder. Null and empty lists give an empty text; an id that the
    vocabulary lacks gives nothing."""

    @F.pandas_udf("string")
    def joined(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path)
        for s in parts:
            yield s.map(lambda x: decode_ids(np.asarray([] if x is None else x, dtype=np.int64), v))

    return joined(ids)


def decode_ids(ids: np.ndarray, v: Vocabulary) -> str:
    named = v.tokens[ids[(ids >= 0) & (ids < len(v.tokens))]]
    return " ".join(t for t in named.tolist() if t is not None)
