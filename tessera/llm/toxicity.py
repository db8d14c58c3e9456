"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes ratios.

The log-count ratio of an n-gram says how much likelier it is in toxic text. The n-grams
that tell the classes apart beyond chance become features; a feature's value is the log of
its density in the text times its ratio, so that neither length nor one stray match decides.
A logistic regression weighs the features. It is fitted on a bounded sample of labelled
rows; every row of the table is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shipping import ship
from tessera.workspace import Workspace

#: At most this many labelled rows fit the classifier (those with the lowest hash of the key).
TRAINING_ROWS = 20_000
#: Lengths of n-grams, and the number of hash buckets that stand for them.
LENGTHS = (3, 4, 5, 6)
BUCKETS = 1 << 20
#: At most so many n-grams become features; each must be this far from chance.
FEATURES = 1024
LEAST_Z = 4.0
LEAST_DOCS = 5
#: Added to both counts of a ratio.
SMOOTHING = 1.0
#: Characters to which matches are related.
DENSE = 400.0
REGULARIZATION = 0.0005
_CHUNK_CHARS = 250_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- n-grams -------------------------------------------------------------------------


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, white space as one blank, a blank at both
    ends; and the number of points of each text."""
    plain = [f" {' '.join((t or '').lower().split())} " for t in texts]
    data = "".join(plain).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, np.uint32).astype(np.uint64), np.array([len(p) for p in plain])


def _buckets(points: np.ndarray, n: int) -> np.ndarray:
    """A bucket for the n-gram at each place where one fits."""
    if len(points) < n:
        return np.empty(0, np.int64)
    h = np.full(len(points) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * _STEP + points[k : len(points) - n + 1 + k]
    h = (h ^ (h >> np.uint64(32))) * _STEP
    return (h >> np.uint64(44)).astype(np.int64)


def _hits(texts: list[str | None], feature_of: np.ndarray | None, width: int) -> tuple:
    """(text, feature or bucket, count) of all n-grams in these texts, and their lengths."""
    points, sizes = _points(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    found = []
    for n in LENGTHS:
        b = _buckets(points, n)
        inside = owner[: len(b)] == owner[n - 1 : n - 1 + len(b)]
        f = b if feature_of is None else feature_of[b]
        good = np.flatnonzero(inside & (f >= 0))
        found.append(owner[good] * width + f[good])
    codes, counts = np.unique(np.concatenate(found), return_counts=True)
    return codes // width, codes % width, counts, sizes


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < _CHUNK_CHARS):
            chars += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def _values(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log of a feature's matches per DENSE characters; texts count as half that at least."""
    return np.log1p(counts * DENSE / np.maximum(sizes, DENSE / 2))


# --- training ------------------------------------------------------------------------


@dataclass
class Model:
    """Feature of each bucket (-1: none), weight of each feature with its ratio, and bias.
    Its size is bounded by BUCKETS and FEATURES."""

    feature_of: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for at, end in _pieces(texts):
            doc, feature, counts, sizes = _hits(texts[at:end], self.feature_of, max(1, len(self.weights)))
            if len(doc):
                x = _values(counts, sizes[doc]) * self.weights[feature]
                z[at:end] += np.bincount(doc, weights=x, minlength=end - at)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _document_counts(labelled: DataFrame) -> DataFrame:
    """Toxic and other documents per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.int64)
            for at, end in _pieces(texts):
                doc, bucket, _, _ = _hits(texts[at:end], None, BUCKETS)
                for y in (0, 1):
                    counts[y] += np.bincount(bucket[labels[at:end][doc] == y], minlength=BUCKETS)
        seen = np.flatnonzero(counts.sum(axis=0))
        for i in range(0, len(seen), 50_000):
            part = seen[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(counts[1][part]), pa.array(counts[0][part])], ["bucket", "p", "q"]
            )

    rows = labelled.select("text", "label").mapInArrow(run, "bucket long, p long, q long")
    return rows.groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def log_ratios(counts: DataFrame, n_toxic: int, n_other: int) -> DataFrame:
    """``ratio``: log of the smoothed share of toxic documents over that of the others;
    ``z``: the difference of the shares in standard errors."""
    p, q = F.col("p") / max(1, n_toxic), F.col("q") / max(1, n_other)
    both = (F.col("p") + F.col("q")) / max(1, n_toxic + n_other)
    error = F.sqrt(both * (1 - both) * (1 / max(1, n_toxic) + 1 / max(1, n_other)))
    ratio = F.log(
        (F.col("p") + SMOOTHING) / (n_toxic + 2 * SMOOTHING) / ((F.col("q") + SMOOTHING) / (n_other + 2 * SMOOTHING))
    )
    return counts.withColumns({"ratio": ratio, "z": F.when(error > 0, (p - q) / error).otherwise(0.0)})


def fit(docs: DataFrame, labels: DataFrame, ws: Workspace) -> Model:
    """Fits on rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, label 0 or 1) covers.

    At most TRAINING_ROWS labels take part, chosen by a hash of their key, so the table of
    chosen keys is small enough to be sent to every task and no text is shuffled. Rows with
    a null key, label or other values than 0 and 1 are left out. Without both classes
    the model has no features and every score is the share of toxic labels (0 if none).
    """
    ship(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    chosen = ws.store("chosen", chosen)
    rows = ws.store("training", docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"))
    by_label = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = by_label.get(1, 0), by_label.get(0, 0)
    nothing = np.full(BUCKETS, -1, np.int32)
    if not n_toxic or not n_other:
        share = float(n_toxic > 0)
        return Model(nothing, np.empty(0), 20.0 * (2 * share - 1))
    told = log_ratios(_document_counts(rows), n_toxic, n_other)
    best = (
        told.filter((F.abs("z") >= LEAST_Z) & (F.col("p") + F.col("q") >= LEAST_DOCS))
        .orderBy(F.desc(F.abs("z")), "bucket")
        .limit(FEATURES)
        .select("bucket", "ratio")
        .collect()
    )
    feature_of = nothing
    ratios = np.array([r["ratio"] for r in best])
    feature_of[np.array([r["bucket"] for r in best], dtype=np.int64)] = np.arange(len(best))
    if not len(best):
        return Model(feature_of, ratios, float(np.log(n_toxic / n_other)))
    weights, bias = _regression(rows, feature_of, ratios)
    return Model(feature_of, weights * ratios, bias)


def _regression(rows: DataFrame, feature_of: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    shared = rows.sparkSession.sparkContext.broadcast((feature_of, ratios))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, scale = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at, end in _pieces(texts):
                doc, feature, counts, sizes = _hits(texts[at:end], of, len(scale))
                x = np.zeros((end - at, len(scale)))
                x[doc, feature] = _values(counts, sizes[doc]) * scale[feature]
                values = pa.array(x.reshape(-1))
                offsets = pa.array(np.arange(end - at + 1, dtype=np.int32) * len(scale))
                listed = pa.ListArray.from_arrays(offsets, values)
                yield pa.RecordBatch.from_arrays([listed, batch.column(1).slice(at, end - at)], ["x", "label"])

    table = rows.select("text", F.col("label").cast("double").alias("label")).mapInArrow(
        run, "x array<double>, label double"
    )
    data = table.select(array_to_vector("x").alias("features"), "label")
    fitted = LogisticRegression(maxIter=100, regParam=REGULARIZATION, standardization=False).fit(data)
    return fitted.coefficients.toArray(), float(fitted.intercept)


# --- scoring -------------------------------------------------------------------------


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``score`` (0 to 1) of every whole text; null and empty texts get the score of
    a text without features. Rows stay where they are and repeat where they repeat."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)
