"""Fitting a random forest on binned rows: the algorithm and the model are Spark's.

Spark's own fit spends its time on walking every row through objects of every tree. Here rows are
binned once, one byte a value, and lie in blocks. All trees grow level by level: a task counts the
bins of its blocks per node, in arrays whose size does not depend on its rows, and the counts are
added per tree. Draws depend on (seed, tree, block) only, so that a task that runs again draws the same.
"""

from __future__ import annotations

import math
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.workspace import shared_folder

#: Rows in one block.
BLOCK = 65_536
#: The most values that a task keeps of a column to find its cut points. Up to as many distinct values
#: the cut points are exact; of more, neighbours are put together in equal shares of weight.
KEPT = 4096
#: The most bytes of counts that a task holds; the trees of a level are dealt over several passes beyond.
COUNT_BYTES = 128 << 20

_templates: dict[tuple, str] = {}
_lock = threading.Lock()


@dataclass
class Settings:
    trees: int
    depth: int
    leaf: int
    bins: int
    seed: int
    #: columns that a node chooses from; None: the square root of all
    columns: int | None = None
    #: draw rows with replacement, once for each tree
    bootstrap: bool = True


def cut_points(rows: DataFrame, values: list[Column], weight: Column, bins: int) -> list[np.ndarray]:
    """Thresholds between the bins of every column, by Spark's rule: all midpoints of neighbouring
    values if they are few, else those nearest to equal shares of the weight. All rows are read."""
    width, kept = len(values), KEPT

    # nested, so that workers need nothing but numpy and pyarrow
    def merged(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values in order with their weights, at most ``kept``."""
        v, at = np.unique(v, return_inverse=True)
        w = np.bincount(at.ravel(), weights=w, minlength=len(v))
        if len(v) <= kept:
            return v, w
        upto = np.cumsum(w)
        share = ((upto - w / 2) / upto[-1] * kept).astype(np.int64)
        first = np.flatnonzero(np.diff(share, prepend=-1))
        return v[np.append(first[1:], len(v)) - 1], np.add.reduceat(w, first)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0), np.zeros(0)) for _ in range(width)]
        for b in batches:
            w = b.column(width).to_numpy(zero_copy_only=False)
            for i, (v0, w0) in enumerate(found):
                v = b.column(i).to_numpy(zero_copy_only=False)
                found[i] = merged(np.concatenate([v0, v]), np.concatenate([w0, w]))
        if len(found[0][0]):
            yield from told((i, v, w) for i, (v, w) in enumerate(found))

    def told(rows) -> Iterator[pa.RecordBatch]:
        i, v, w = zip(*rows)
        lists = [pa.array([x.tolist() for x in c], pa.list_(pa.float64())) for c in (v, w)]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), *lists], ["i", "v", "w"])

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for r in b.to_pylist():
                v0, w0 = found.get(r["i"], (np.zeros(0), np.zeros(0)))
                v, at = np.unique(np.concatenate([v0, r["v"]]), return_inverse=True)
                w = np.bincount(at.ravel(), weights=np.concatenate([w0, r["w"]]))
                found[r["i"]] = (v, w) if len(v) <= 8 * kept else merged(v, w)
        cuts = []
        for i, (v, w) in found.items():
            mid = (v[:-1] + v[1:]) / 2
            if len(mid) > bins - 1:
                upto, stride, chosen = np.cumsum(w), w.sum() / bins, []
                target = stride
                for k in range(1, len(v)):
                    if abs(upto[k - 1] - target) < abs(upto[k] - target):
                        chosen.append(k - 1)
                        target += stride
                mid = mid[chosen[: bins - 1]]
            cuts.append((i, mid, np.zeros(0)))
        if cuts:
            yield from told(cuts)

    plain = rows.select(*[v.alias(f"c{i}") for i, v in enumerate(values)], weight.alias("w"))
    schema = "i int, v array<double>, w array<double>"
    parts = plain.mapInArrow(summaries, schema).repartition(min(width, 16), "i")
    found = {r["i"]: np.array(r["v"], dtype=float) for r in parts.mapInArrow(thresholds, schema).collect()}
    return [found[i] for i in range(width)]


def binned(rows: DataFrame, values: list[Column], cuts: list[np.ndarray], path: str) -> DataFrame:
    """(block, n, x, y): the bins of up to ``BLOCK`` rows, column by column, and their labels."""
    width, most = len(values), BLOCK

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            x = np.concatenate([h[0] for h in held], axis=1).tobytes()
            y = np.concatenate([h[1] for h in held]).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int32()), pa.array([x], pa.binary()), pa.array([y], pa.binary())], ["n", "x", "y"]
            )

        for whole in batches:
            for start in range(0, whole.num_rows, most):
                b = whole.slice(start, most)
                if held and n + b.num_rows > most:
                    yield block()
                    held, n = [], 0
                x = [np.searchsorted(c, b.column(i).to_numpy(zero_copy_only=False)) for i, c in enumerate(cuts)]
                held.append((np.array(x).astype(np.uint8), b.column(width).to_numpy(zero_copy_only=False).astype(np.uint8)))
                n += b.num_rows
        if held:
            yield block()

    plain = rows.select(*[v.alias(f"c{i}") for i, v in enumerate(values)], F.col("label").cast("int").alias("label"))
    out = plain.mapInArrow(blocks, "n int, x binary, y binary").withColumn("block", F.monotonically_increasing_id())
    out.write.parquet(path)
    return rows.sparkSession.read.schema(out.schema).parquet(path)


class _Trees:
    """All trees as heaps: node i has the children 2i+1 and 2i+2. Counts are rows drawn, by label."""

    def __init__(self, s: Settings) -> None:
        size = 2 ** (s.depth + 1) - 1
        self.feature = np.full((s.trees, size), -1, dtype=np.int64)
        self.bin = np.full((s.trees, size), 255, dtype=np.uint8)
        self.gain = np.full((s.trees, size), -1.0)
        self.counts = np.zeros((s.trees, size, 2), dtype=np.int64)


@dataclass
class _Asked:
    """Nodes of one tree on one level and what is counted there."""

    tree: int
    nodes: np.ndarray  # place in the heap
    columns: np.ndarray  # (nodes, places): chosen columns with more than one bin, -1 where there is none
    starts: np.ndarray  # (nodes, 2, places): where the bins of a column begin, by label
    size: int


def _ask(tree: int, nodes: np.ndarray, n_bins: np.ndarray, chosen: np.ndarray) -> _Asked:
    useful = n_bins[chosen] > 1
    order = np.argsort(~useful, axis=1, kind="stable")
    columns = np.take_along_axis(np.where(useful, chosen, -1), order, axis=1)
    width = np.where(columns >= 0, n_bins[columns], 0)
    per = np.broadcast_to(width[:, None, :], (len(nodes), 2, width.shape[1]))
    flat = per.ravel()
    starts = (np.cumsum(flat) - flat).reshape(per.shape)
    return _Asked(tree, nodes, columns, starts, int(flat.sum()))


def _count(blocks: DataFrame, trees: _Trees, level: int, asked: list[_Asked], s: Settings) -> DataFrame:
    """(tree, counts): the rows drawn for each asked node by label and bin, then by label alone."""
    feature, cut, seed, bootstrap, base = trees.feature, trees.bin, s.seed, s.bootstrap, 2**level - 1
    plain = [(a.tree, a.nodes, a.columns, a.starts, a.size) for a in asked]
    # how often a row is drawn follows Poisson(1): 16 random bits tell, and a further draw where they leave it open
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
    low, high = (np.searchsorted(upto, (np.arange(65536) + d) / 65536, side="right") for d in (0, 1))
    times_of = np.where(low == high, low, 255).astype(np.uint8)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(size + 2 * len(nodes), dtype=np.int32) for _, nodes, _, _, size in plain]
        for b in batches:
            for k in range(b.num_rows):
                n, block = b.column(0)[k].as_py(), b.column(3)[k].as_py()
                x = np.frombuffer(b.column(1)[k].as_buffer(), dtype=np.uint8)
                y = np.frombuffer(b.column(2)[k].as_buffer(), dtype=np.uint8)
                for into, ask in zip(sums, plain):
                    add(into, ask, n, block, x, y)
        for at in range(0, len(plain), 8):
            some = range(at, min(at + 8, len(plain)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([plain[i][0] for i in some], pa.int32()), pa.array([sums[i].tobytes() for i in some], pa.binary())],
                ["tree", "counts"],
            )

    def add(into: np.ndarray, ask: tuple, n: int, block: int, x: np.ndarray, y: np.ndarray) -> None:
        tree, nodes, columns, starts, size = ask
        if bootstrap:
            rng = np.random.Generator(np.random.SFC64([seed, tree, block]))
            bits = rng.integers(0, 65536, n, dtype=np.uint16)
            drawn = times_of.take(bits)
            left_open = np.flatnonzero(drawn == 255)
            drawn[left_open] = np.searchsorted(upto, (bits[left_open] + rng.random(len(left_open))) / 65536, side="right")
            rows = np.flatnonzero(drawn)
            times = drawn[rows].astype(np.float64)
        else:
            rows, times = np.arange(n), np.ones(n)
        # a node that is not split sends all rows left, to places where nothing is asked
        places, limit, at = np.maximum(feature[tree], 0) * n, cut[tree], np.zeros(len(rows), dtype=np.int64)
        for _ in range(level):
            right = x.take(places.take(at) + rows) > limit.take(at)
            at += at
            at += 1
            at += right
        place = np.full(base + 1, -1)
        place[nodes - base] = np.arange(len(nodes))
        node = place.take(at - base)
        if len(nodes) <= base:
            kept = np.flatnonzero(node >= 0)
            rows, times, node = rows[kept], times[kept], node[kept]
        both = node * 2 + y.take(rows)  # node and label
        into[size:] += np.bincount(both, weights=times, minlength=2 * len(nodes)).astype(np.int32)
        columns_of, starts_of = np.repeat(columns, 2, axis=0) * n, starts.reshape(2 * len(nodes), -1)
        for j in range(columns.shape[1]):
            used = columns_of[:, j] >= 0
            if not used.any():
                break
            if not used.all():
                kept = np.flatnonzero(used.take(both))
                rows, times, both = rows[kept], times[kept], both[kept]
            bins = x.take(columns_of[:, j].take(both) + rows) + starts_of[:, j].take(both)
            into[:size] += np.bincount(bins, weights=times, minlength=size).astype(np.int32)

    return blocks.select("n", "x", "y", "block").mapInArrow(counted, "tree int, counts binary")


def _best(counts: DataFrame, asked: list[_Asked], n_bins: np.ndarray, weights: tuple[float, float], s: Settings) -> DataFrame:
    """The best split of every asked node, or a gain of -1 where there is none."""
    by_tree = {a.tree: (a.nodes, a.columns, a.starts, a.size) for a in asked}
    leaf, w0, w1 = s.leaf, *weights

    def gini(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.maximum(a + b, 1e-300)
        return 1.0 - (a / total) ** 2 - (b / total) ** 2

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k in range(b.num_rows):
                tree, part = b.column(0)[k].as_py(), np.frombuffer(b.column(1)[k].as_buffer(), dtype=np.int32)
                if tree in sums:
                    sums[tree] += part
                else:
                    sums[tree] = part.astype(np.int64)
        out = []
        for tree, c in sums.items():
            nodes, columns, starts, size = by_tree[tree]
            for m, node in enumerate(nodes):
                all0, all1 = c[size + 2 * m], c[size + 2 * m + 1]
                best = (-1, 0, -1.0, 0, 0)
                total, whole = all0 * w0 + all1 * w1, gini(all0 * w0, all1 * w1)
                for j, f in enumerate(columns[m]):
                    if f < 0:
                        break
                    k = int(n_bins[f])
                    l0 = np.cumsum(c[starts[m, 0, j] : starts[m, 0, j] + k])[:-1]
                    l1 = np.cumsum(c[starts[m, 1, j] : starts[m, 1, j] + k])[:-1]
                    r0, r1 = all0 - l0, all1 - l1
                    left, right = l0 * w0 + l1 * w1, r0 * w0 + r1 * w1
                    gain = whole - left / total * gini(l0 * w0, l1 * w1) - right / total * gini(r0 * w0, r1 * w1)
                    gain = np.where((l0 + l1 >= leaf) & (r0 + r1 >= leaf), gain, -1.0)
                    at = int(np.argmax(gain))
                    if gain[at] > max(best[2], 0.0):
                        best = (int(f), at, float(gain[at]), int(l0[at]), int(l1[at]))
                out.append((tree, int(node), *best, int(all0), int(all1)))
        if out:
            columns_out = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int32()] * 4 + [pa.float64()] + [pa.int64()] * 4)]
            yield pa.RecordBatch.from_arrays(columns_out, ["tree", "node", "feature", "bin", "gain", "l0", "l1", "all0", "all1"])

    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartition(min(n, len(asked)), "tree")
    schema = "tree int, node int, feature int, bin int, gain double, l0 long, l1 long, all0 long, all1 long"
    return dealt.mapInArrow(chosen, schema)


def grow(blocks: DataFrame, cuts: list[np.ndarray], weights: tuple[float, float], s: Settings) -> _Trees:
    """The trees over all blocks, level by level. The driver holds the nodes, at most
    trees * 2^(depth+1), and no counts."""
    rng = np.random.default_rng(s.seed)
    n_bins = np.array([len(c) + 1 for c in cuts])
    width = len(cuts)
    few = min(width, s.columns or math.ceil(math.sqrt(width)))
    trees = _Trees(s)
    live = {t: [0] for t in range(s.trees)}
    for level in range(s.depth):
        asked = []
        for t, nodes in live.items():
            chosen = np.argsort(rng.random((len(nodes), width)), axis=1)[:, :few]
            asked.append(_ask(t, np.array(nodes), n_bins, chosen))
        live = {}
        for some in _passes(asked):
            found = _best(_count(blocks, trees, level, some, s), some, n_bins, weights, s).collect()
            for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
                t, i = r["tree"], r["node"]
                trees.counts[t, i] = r["all0"], r["all1"]
                if r["feature"] < 0:
                    continue
                trees.feature[t, i], trees.bin[t, i], trees.gain[t, i] = r["feature"], r["bin"], r["gain"]
                left = (r["l0"], r["l1"])
                for child, c in ((2 * i + 1, left), (2 * i + 2, (r["all0"] - left[0], r["all1"] - left[1]))):
                    trees.counts[t, child] = c
                    # a pure node, or one too small to be cut, is a leaf
                    if level + 1 < s.depth and min(c) > 0 and sum(c) >= 2 * s.leaf:
                        live.setdefault(t, []).append(child)
        live = dict(sorted(live.items()))
    return trees


def _passes(asked: list[_Asked]) -> Iterator[list[_Asked]]:
    some, held = [], 0
    for a in asked:
        if some and held + 4 * a.size > COUNT_BYTES:
            yield some
            some, held = [], 0
        some.append(a)
        held += 4 * a.size
    if some:
        yield some


def _node_rows(trees: _Trees, cuts: list[np.ndarray], weights: tuple[float, float]) -> list[tuple]:
    """Nodes as Spark stores them: numbered from the root, left before right. As in Spark's own fit,
    two leaves that predict the same class become one."""
    out = []
    for t in range(len(trees.feature)):
        split = trees.feature[t] >= 0
        stats = trees.counts[t] * np.array(weights)
        said = np.argmax(stats, axis=1)
        for i in range(len(split) // 2 - 1, -1, -1):
            left, right = 2 * i + 1, 2 * i + 2
            if split[i] and not split[left] and not split[right] and said[left] == said[right]:
                split[i] = False
        number, todo = {}, [0]
        while todo:
            i = todo.pop()
            number[i] = len(number)
            if split[i]:
                todo += [2 * i + 2, 2 * i + 1]
        for i, place in number.items():
            p = stats[i] / stats[i].sum()
            f = int(trees.feature[t, i]) if split[i] else -1
            out.append(
                (
                    t, place, float(said[i]), float(1.0 - (p * p).sum()), stats[i].tolist(), int(trees.counts[t, i].sum()),
                    float(trees.gain[t, i]) if split[i] else -1.0,
                    number[2 * i + 1] if split[i] else -1, number[2 * i + 2] if split[i] else -1,
                    f, [float(cuts[f][trees.bin[t, i]])] if split[i] else [],
                )
            )
    return out


def _template(est: RandomForestClassifier, width: int, spark: SparkSession, folder: str) -> str:
    """A stored forest with the estimator's settings, fitted on two rows; its nodes are not used."""
    told = tuple(sorted((p.name, str(v)) for p, v in est.extractParamMap().items() if p.name != "seed"))
    key = (spark.sparkContext.applicationId, folder, width, told)
    with _lock:
        if key not in _templates:
            rows = [(Vectors.dense([float(y)] * width), float(y), 1.0) for y in (0, 1)]
            path = f"{folder}/{uuid.uuid4().hex}"
            est.fit(spark.createDataFrame(rows, ["features", "label", "weight"]).coalesce(1)).write().save(path)
            _templates[key] = path
    return _templates[key]


def model_of(
    trees: _Trees, cuts: list[np.ndarray], weights: tuple[float, float], est: RandomForestClassifier, spark: SparkSession, folder: str
) -> RandomForestClassificationModel:
    """Spark's model with these trees, read from its files."""
    template, path = _template(est, len(cuts), spark, folder), f"{folder}/{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for part in ("metadata", "treesMetadata"):
        old, new = (jvm.org.apache.hadoop.fs.Path(f"{p}/{part}") for p in (template, path))
        jvm.org.apache.hadoop.fs.FileUtil.copy(old.getFileSystem(conf), old, new.getFileSystem(conf), new, False, conf)
    schema = (
        "t int, id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, "
        "leftChild int, rightChild int, featureIndex int, leftCategoriesOrThreshold array<double>"
    )
    nodes = spark.createDataFrame(_node_rows(trees, cuts, weights), schema, verifySchema=False)
    split = F.struct("featureIndex", "leftCategoriesOrThreshold", F.lit(-1).alias("numCategories")).alias("split")
    kept = ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild"]
    data = nodes.select(F.col("t").alias("treeID"), F.struct(*kept, split).alias("nodeData"))
    data.coalesce(1).write.parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def fit(
    rows: DataFrame, values: list[Column], weights: tuple[float, float], n_rows: int, s: Settings
) -> RandomForestClassificationModel:
    """A forest over ``rows(label)`` with the given columns; ``weights`` are those of the two labels."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/tessera/{spark.sparkContext.applicationId}-models"
    weight = F.when(F.col("label") == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    cuts = cut_points(rows, values, weight, min(s.bins, n_rows))
    blocks = binned(rows, values, cuts, f"{folder}/{uuid.uuid4().hex}-rows")
    trees = grow(blocks, cuts, weights, s)
    est = RandomForestClassifier(
        numTrees=s.trees, maxDepth=s.depth, minInstancesPerNode=s.leaf, featureSubsetStrategy=str(s.columns or "sqrt"),
        weightCol="weight", seed=s.seed, maxBins=s.bins, bootstrap=s.bootstrap,
    )
    return model_of(trees, cuts, weights, est, spark, folder)
