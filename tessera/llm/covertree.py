"""Exact top-k by inner product: dual-tree search over cover trees of queries and data.

Every task turns its rows into blocks with a cover tree each. A tree of queries and a tree
of data are walked together. A pair of nodes is left out when the largest inner product that
centres and covering radii allow is below the worst k-th score of all queries of the node.
Vectors are whole numbers, so scores are exact and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shipping import ship

SCALE = 1024
#: Rows of a data tree and of a query tree, and queries that are sent to all tasks at once.
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
QUERIES_AT_ONCE = 8192
#: Nodes of this many points are not divided further.
LEAF = 32
_CHUNK = 512
_NONE = -(1 << 62)


class Node:
    """Points ``lo:hi`` of a tree; ``own`` of them in front belong to no child."""

    __slots__ = ("centre", "radius", "norm", "lo", "own", "hi", "kids")

    def __init__(self, centre: np.ndarray, radius: float, lo: int) -> None:
        self.centre, self.radius, self.lo = centre, radius, lo
        self.norm = float(np.linalg.norm(centre))
        self.own = self.hi = lo
        self.kids: list[Node] = []


class Tree:
    """A cover tree: children lie within half their parent's radius of their centre, and
    the centres of children lie farther apart than that. Points are reordered so that
    every node is a range."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self._source = vectors
        self._order: list[np.ndarray] = []
        self._placed = 0
        self.root = self._node(np.arange(len(ids)), 0)
        order = np.concatenate(self._order)
        self.ids, self.vectors = ids[order], vectors[order]
        self.norms = np.linalg.norm(self.vectors, axis=1)
        del self._source, self._order

    def _node(self, at: np.ndarray, first: int) -> Node:
        centre = self._source[at[first]]
        far = np.linalg.norm(self._source[at] - centre, axis=1)
        node = Node(centre, float(far.max()), self._placed)
        if len(at) <= LEAF or node.radius == 0.0:
            self._place(at)
            node.own = node.hi = self._placed
            return node
        half, rest, single, groups = node.radius / 2, at, [], []
        here = first
        while len(rest):
            near = np.linalg.norm(self._source[rest] - self._source[rest[here]], axis=1) <= half
            if np.count_nonzero(near) == 1:
                single.append(rest[here])
            else:
                groups.append((rest[near], int(np.count_nonzero(near[:here]))))
            rest, here = rest[~near], 0
        self._place(np.array(single, dtype=np.int64))
        node.own = self._placed
        node.kids = [self._node(group, of) for group, of in groups]
        node.hi = self._placed
        return node

    def _place(self, at: np.ndarray) -> None:
        self._order.append(at)
        self._placed += len(at)


class Search:
    """The best ``k`` so far of every query of one tree."""

    def __init__(self, queries: Tree, k: int) -> None:
        self.q, self.k = queries, k
        n = len(queries.ids)
        self.scores = np.full((n, k), _NONE, np.int64)
        self.found = np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def walk(self, data: Tree) -> None:
        todo = [(self.q.root, data.root)]
        while todo:
            a, b = todo.pop()
            if self._above(a, b) < self._worst(a):
                continue
            if a.kids and a.radius >= b.radius:
                if a.own > a.lo:
                    todo.append((self._loose(a), b))
                todo += [(kid, b) for kid in a.kids]
                continue
            self._compare(a, data, b.lo, b.own)
            todo += sorted(((a, kid) for kid in b.kids), key=lambda p: self._above(*p))

    def _loose(self, a: Node) -> Node:
        """The points of a node that belong to no child, as a node without children."""
        node = Node(a.centre, a.radius, a.lo)
        node.own = node.hi = a.own
        return node

    @staticmethod
    def _above(a: Node, b: Node) -> float:
        """No query of ``a`` and point of ``b`` have a larger inner product."""
        top = a.centre @ b.centre + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
        return top + 1e-9 * abs(top) + 1e-3

    def _worst(self, a: Node) -> float:
        return float(self.scores[a.lo : a.hi, -1].min())

    def _compare(self, a: Node, data: Tree, lo: int, hi: int) -> None:
        for i in range(lo, hi, _CHUNK):
            j = min(hi, i + _CHUNK)
            top = data.vectors[i:j] @ a.centre + a.radius * data.norms[i:j]
            at = i + np.flatnonzero(top + 1e-9 * np.abs(top) + 1e-3 >= self._worst(a))
            if len(at):
                scores = _products(self.q.vectors[a.lo : a.hi], data.vectors[at])
                self._take(a.lo, scores, data.ids[at])

    def _take(self, lo: int, scores: np.ndarray, ids: np.ndarray) -> None:
        rows, cols = np.nonzero(scores >= self.scores[lo : lo + len(scores), -1:])
        new = ids[cols]
        other = new != self.q.ids[lo + rows]
        rows, cols, new = rows[other], cols[other], new[other]
        if not len(rows):
            return
        touched = np.unique(rows)
        old = np.repeat(touched, self.k)
        row = np.concatenate([old, rows])
        score = np.concatenate([self.scores[lo + touched].reshape(-1), scores[rows, cols]])
        name = np.concatenate([self.found[lo + touched].reshape(-1), new])
        order = np.lexsort((name, -score, row))
        row, score, name = row[order], score[order], name[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        self.scores[lo + row[best], place[best]] = score[best]
        self.found[lo + row[best], place[best]] = name[best]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers. Floating point is exact below 2^53."""
    largest = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, a.shape[1])
    if largest < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def whole_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows whose key is not null and whose components are all finite, scaled and
    rounded down to whole numbers."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.col(f"`{key}`").isNotNull() & x.isNotNull() & finite)
    return rows.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v")
    )


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a task as (dimension, ids, vectors) of at most BLOCK_ROWS rows."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    rows: dict[int, int] = {}
    for batch in batches:
        ids = np.asarray(batch.column(0))
        sizes = np.diff(np.asarray(batch.column(1).offsets))
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            for i in range(0, len(at), BLOCK_ROWS):
                part = at[i : i + BLOCK_ROWS]
                vectors = _matrix(batch.column(1).take(pa.array(part)), dim) if dim else np.zeros((len(part), 0))
                held.setdefault(dim, []).append((ids[part], vectors))
                rows[dim] = rows.get(dim, 0) + len(part)
                if rows[dim] >= BLOCK_ROWS:
                    yield dim, *map(np.concatenate, zip(*held.pop(dim), strict=True))
                    rows[dim] = 0
    for dim, parts in held.items():
        yield dim, *map(np.concatenate, zip(*parts, strict=True))


def _best_of(points: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches: dict[int, list[Search]] = {}
        for dim, ids, vectors in shared.value:
            searches.setdefault(dim, []).append(Search(Tree(ids, vectors), k))
        for dim, ids, vectors in _blocks(batches):
            if dim in searches:
                tree = Tree(ids, vectors)
                for s in searches[dim]:
                    s.walk(tree)
        for s in (s for group in searches.values() for s in group):
            good = s.scores > _NONE
            names = np.broadcast_to(s.q.ids[:, None], good.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[good]), pa.array(s.found[good]), pa.array(s.scores[good])],
                ["query_id", "vec_id", "score"],
            )

    return points.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int, every: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose key ``every`` divides, the ``k``
    highest integer inner products with other rows; ties to the smaller key.

    Rows with a null key, a null vector or a component that is null or not finite take no
    part; vectors only meet those of their length. A key never meets itself; a query key
    that is repeated asks once, with its smallest vector, and repeated candidates count each.
    Queries go to the tasks in groups of bounded size; data rows stay where they are. A
    task keeps ``k`` rows for each query of the group. Products beyond 64 bits are not defined.
    """
    ship(vectors.sparkSession)
    points = whole_vectors(vectors, key, vector)
    asked = points.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    groups = max(1, -(-asked.count() // QUERIES_AT_ONCE))
    found = None
    for g in range(groups):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).toArrow()
        parts = list(_blocks(iter(rows.to_batches())))
        pieces = [
            (dim, ids[i : i + QUERY_ROWS], v[i : i + QUERY_ROWS])
            for dim, ids, v in parts
            for i in range(0, len(ids), QUERY_ROWS)
        ]
        best = _best_of(points, pieces, k)
        found = best if found is None else found.union(best)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
