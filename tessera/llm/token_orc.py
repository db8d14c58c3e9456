"""Token ids of documents as ORC files.

Documents are ranged by id, encoded where they lie and written in that order: one ORC file
for each range. A file's columns are

* ``slice``: the range, ascending with the ids; ``at``: ids of the slice before the document,
* ``doc_id``: with row indexes (least and greatest of every ``STRIDE`` rows) and a Bloom filter,
* ``n_tokens`` and ``ids``: the list of token ids.

ORC writes integers run-length encoded (version 2: repeats, deltas, bit-packed literals), and
stripes of ``STRIPE_BYTES`` that readers take apart in parallel. A position in the whole
sequence is the slice's base, a sum over earlier slices, plus ``at``; both come from the narrow
columns alone.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shipping import ship

END = 2
STRIDE = 1000
STRIPE_BYTES = 16 << 20
FALSE_POSITIVES = 0.01
#: Bytes of text whose ids are held at once; a longer text is held alone.
BYTES_AT_ONCE = 1 << 20
#: Pieces of text a worker remembers the ids of, and the longest of them.
REMEMBERED, LONGEST = 400_000, 48

# fixed values: the pre-tokens of a byte-level vocabulary, spelled out for plain characters
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_BLANK_BY_SPACE = ("  ", " \t", " \n", " \r", "\t ", "\n ", "\r ")
_PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{_LETTERS}]*")
_PRE_TOKENS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"
)

_LAYOUT = "slice int, at long, doc_id {key}, n_tokens long, ids array<int>"


def write(
    docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end: int | None = END
) -> None:
    """Encode the whole ``text`` of every row and write the files to ``path``.

    Order is that of ``key``, null keys first; rows with equal keys are ordered by a hash of
    their text, and only rows that are equal in both share a slice of necessity, so a key of
    any weight is dealt over many slices. A null text counts as empty. ``end`` is appended to
    each document; None appends nothing, and an empty text then has an empty list. An empty
    table gives files without rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    encoded = placed.mapInArrow(lambda batches: _encoded(batches, vocabulary, end), _LAYOUT.format(key=kind))
    (
        encoded.write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", FALSE_POSITIVES)
        .orc(path)
    )


def _encoded(batches: Iterable[pa.RecordBatch], vocabulary: str, end: int | None) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tail = b"" if end is None else end.to_bytes(4, "little")
    encoder, number, at = _encoder(vocabulary), TaskContext.get().partitionId(), 0
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        for first, n in _runs(texts):
            ids = [encoder.encode(t) + tail for t in texts.slice(first, n).to_pylist()]
            ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, number, "i4")),
                    pa.array(at + ends[:-1]),
                    keys.slice(first, n),
                    pa.array(np.diff(ends)),
                    pa.ListArray.from_arrays(ends.astype("i4"), np.frombuffer(b"".join(ids), "<i4")),
                ],
                ["slice", "at", "doc_id", "n_tokens", "ids"],
            )
            at += int(ends[-1])


class _Pieces(dict):
    """Ids of the pieces met before, as bytes of 32-bit integers; a new one goes to ``encode``.
    What is remembered is bounded, and forgotten as a whole when it is full."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self._encode(piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts as bytes of little-endian 32-bit integers.

    Under a byte-level vocabulary a blank that stands alone between two characters that are no
    white space belongs to the word after it, so a text can be cut before every such blank: the
    ids of the pieces, one after the other, are those of the text. Most pieces are words met
    before. A new piece of plain characters is cut into the pre-tokens that the vocabulary's
    pattern gives, and the library's model merges each new one of these once. All else goes to the library's
    tokenizer as it is: pieces with other characters, texts that hold an added token, and all
    texts where the vocabulary has other rules.
    """

    def __init__(self, tokenizer) -> None:
        self._tokenizer, self._model = tokenizer, tokenizer.model
        rules = json.loads(tokenizer.to_str())
        before = rules["pre_tokenizer"] or {}
        self._cuts = (
            rules["normalizer"] is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
        )
        self._added = [t["content"] for t in rules["added_tokens"]]
        self._signs = _byte_signs()
        self._tokens = _Pieces(self._merged)
        self._pieces = _Pieces(self._split)
        self._after_blank = _Pieces(lambda word: self._split(" " + word))

    def encode(self, text: str) -> bytes:
        if not self._cuts or any(t in text for t in self._added):
            return self._whole(text)
        if not _PLAIN.fullmatch(text):
            return b"".join([self._pieces[p] if _PLAIN.fullmatch(p) else self._whole(p) for p in _at_lone_blanks(text)])
        if text[:1] == " " or text[-1:] == " " or any(pair in text for pair in _BLANK_BY_SPACE):
            return b"".join(map(self._pieces.__getitem__, _at_lone_blanks(text)))
        first, *rest = text.split(" ")  # all blanks stand alone
        return self._pieces[first] + b"".join(map(self._after_blank.__getitem__, rest))

    def _whole(self, text: str) -> bytes:
        ids = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, "<i4").tobytes()

    def _split(self, piece: str) -> bytes:
        if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            return self._tokens[piece]
        return b"".join(map(self._tokens.__getitem__, _PRE_TOKENS.findall(piece)))

    def _merged(self, token: str) -> bytes:
        signs = token.encode().decode("latin-1").translate(self._signs)
        return b"".join([t.id.to_bytes(4, "little") for t in self._model.tokenize(signs)])


def _at_lone_blanks(text: str) -> list[str]:
    """``text`` cut before every blank that stands alone between characters that are no white space."""
    first, *rest = text.split(" ")
    out, held, last = [], [first], first[-1:]
    for word in rest:
        if last and word and not last.isspace() and not word[0].isspace():
            out.append(" ".join(held))
            held = [" " + word]
        else:
            held.append(word)
        last = word[-1:]
    return [*out, " ".join(held)]


def _byte_signs() -> dict[int, str]:
    """The sign of each byte in a byte-level vocabulary: itself where it prints, else the next
    one from 256 on."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(others)}


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    """The worker's encoder, which its later tasks find again."""
    if vocabulary not in _ENCODERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _ENCODERS[vocabulary] = Encoder(tokenizer)
    return _ENCODERS[vocabulary]


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, count) of neighbours that hold up to ``BYTES_AT_ONCE`` bytes together."""
    first, held = 0, 0
    for i in range(len(texts)):
        size = len(texts[i].as_buffer())
        if i > first and held + size > BYTES_AT_ONCE:
            yield first, i - first
            first, held = i, 0
        held += size
    if len(texts) > first:
        yield first, len(texts) - first


def read(spark: SparkSession, path: str) -> DataFrame:
    """(slice, at, doc_id, n_tokens, ids) of the files. Filters on ``doc_id`` and ``n_tokens``
    reach the reader, which skips files, stripes and strides by their statistics."""
    return spark.read.orc(path)


def bases(files: DataFrame) -> DataFrame:
    """(slice, base): ids in all earlier slices, from two narrow columns. There is a row for
    each file, as in any listing of them, so the list is worked out once."""
    rows, before = [], 0
    for r in sorted(files.groupBy("slice").agg(F.sum("n_tokens").alias("n")).collect()):
        rows.append((r["slice"], before))
        before += r["n"]
    return files.sparkSession.createDataFrame(rows, "slice int, base long")


def starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` (with ``slice`` and ``at``) with ``start``: the ids of all documents before them."""
    return rows.join(bases(files), "slice").withColumn("start", F.col("base") + F.col("at")).drop("base")


def checksums(files: DataFrame) -> DataFrame:
    """(slice, at, doc_id, n_tokens, ids_crc32): the CRC-32 of every document's ids as
    little-endian unsigned 32-bit integers."""
    ship(files.sparkSession)
    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("slice", "at", "doc_id", "n_tokens", "ids").mapInArrow(
        _checked, f"slice int, at long, doc_id {kind}, n_tokens long, ids_crc32 long"
    )


def _checked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        ends = lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        head = [batch.column(c) for c in ("slice", "at", "doc_id", "n_tokens")]
        yield pa.RecordBatch.from_arrays(
            [*head, pa.array(sums, pa.int64())], ["slice", "at", "doc_id", "n_tokens", "ids_crc32"]
        )


def find(spark: SparkSession, path: str, keys: Sequence) -> DataFrame:
    """The rows of the documents ``keys`` (a short list). The reader drops strides whose least
    and greatest id or Bloom filter rules all of them out, before it decodes any id list."""
    return read(spark, path).filter(F.col("doc_id").isin(list(keys)))


def decoded(files: DataFrame, vocabulary: str, end: int | None = END) -> DataFrame:
    """(doc_id, text): the text that the ids of each row stand for, without a last ``end``."""
    ship(files.sparkSession)
    kind = files.schema["doc_id"].dataType.simpleString()

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        for batch in batches:
            out = []
            for ids in batch.column("ids").to_pylist():
                bare = ids[:-1] if end is not None and ids and ids[-1] == end else ids
                out.append(tokenizer.decode(bare, skip_special_tokens=False))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return files.select("doc_id", "ids").mapInArrow(texts, f"doc_id {kind}, text string")
