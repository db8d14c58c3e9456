"""Centroid clustering: Lloyd's rounds over vectors that are sharded by dimension.

Vectors are cut into column blocks: a block holds the components of one shard for up to
``BLOCK_ROWS`` vectors, and a shard's centroids are a slice of the same columns. In a round

1. each block's task computes exact partial squared distances to its shard's centroid slice,
2. the partial distances of a group of vectors are added over its blocks; the least sum names
   the nearest centroid,
3. each block's task adds its columns by nearest centroid, and each shard replaces its own slice
   by the means.

Components are whole numbers, so sums are exact in any order.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shipping import ship
from tessera.workspace import Workspace

#: Vectors of a group: its partial distances are ``BLOCK_ROWS`` x k x 8 bytes a shard.
BLOCK_ROWS = 1024
SHARDS = 4
#: Scaled components are held within this bound, so that squared distances fit 64 bits.
LARGEST = 1 << 27

_BLOCK = "part long, shard int, ids array<{key}>, cells binary"
_SLICE = "shard int, k int, slice binary"


def whole_vectors(vectors: DataFrame, dim: int, scale: int, key: str, vector: str) -> DataFrame:
    """(id, v): the vectors with ``dim`` components, none null or not finite, as whole numbers
    floor(scale * x), held within ``LARGEST``."""
    x = F.col(f"`{vector}`").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter((F.size(x) == dim) & sound)
    held = lambda c: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c))
    whole = F.transform(x, lambda c: F.floor(held(c * F.lit(float(scale)))).cast("long"))
    return rows.select(F.col(f"`{key}`").alias("id"), whole.alias("v"))


def start_order(key: Column, salt: str) -> Column:
    """The digest by which the first centroids are chosen."""
    return F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)


def _widths(dim: int, shards: int) -> list[tuple[int, int]]:
    """Columns [first, last) of each shard."""
    step = math.ceil(dim / max(1, min(shards, dim)))
    return [(a, min(dim, a + step)) for a in range(0, dim, step)]


def column_blocks(points: DataFrame, dim: int, shards: int) -> DataFrame:
    """(part, shard, ids, cells): the column blocks of ``points``. Every task cuts its own rows,
    so nothing moves; the first shard's block carries the ids."""
    widths = _widths(dim, shards)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                rows = batch.slice(first, BLOCK_ROWS)
                cells = np.asarray(rows.column(1).flatten()).reshape(rows.num_rows, dim)
                nothing = pa.nulls(1, pa.list_(rows.schema.field(0).type))
                for shard, (a, b) in enumerate(widths):
                    ids = nothing if shard else pa.ListArray.from_arrays([0, rows.num_rows], rows.column(0))
                    block = np.ascontiguousarray(cells[:, a:b]).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part]), pa.array([shard], pa.int32()), ids, pa.array([block], pa.binary())],
                        ["part", "shard", "ids", "cells"],
                    )
                part += 1

    kind = points.schema["id"].dataType.simpleString()
    return points.select("id", "v").mapInArrow(cut, _BLOCK.format(key=kind))


def first_slices(points: DataFrame, k: int, dim: int, shards: int, salt: str) -> DataFrame:
    """(shard, k, slice): the columns of the ``k`` points that come first by digest, ties by the
    components; points without id come last. Only ``k`` rows meet."""
    order = [F.asc_nulls_last("_h"), F.asc("v")]
    first = points.withColumn("_h", start_order(F.col("id"), salt)).orderBy(*order).limit(k)
    widths = _widths(dim, shards)
    rows = first.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("_h").isNull(), "_h", "v"))).alias("c"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chosen in batch.column(0).to_pylist():
                cells = np.array([c["v"] for c in chosen], np.int64).reshape(len(chosen), dim)
                slices = [np.ascontiguousarray(cells[:, a:b]).tobytes() for a, b in widths]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(len(widths)), pa.int32()),
                        pa.array([len(chosen)] * len(widths), pa.int32()),
                        pa.array(slices, pa.binary()),
                    ],
                    ["shard", "k", "slice"],
                )

    return rows.mapInArrow(cut, _SLICE)


def nearest(blocks: DataFrame, slices: DataFrame) -> DataFrame:
    """(part, ids, cluster, distance): for each group of vectors the nearest centroid of each
    and its squared distance; ties go to the smaller number.

    The slices are a row of k x columns numbers for each shard, whatever the input. A group
    brings one matrix of partial distances for each shard to the task that adds them.
    """
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                k = one.column("k")[0].as_py()
                centres = np.frombuffer(one.column("slice")[0].as_py(), np.int64).reshape(k, -1)
                cells = np.frombuffer(one.column("cells")[0].as_py(), np.int64).reshape(-1, centres.shape[1])
                out = np.empty((len(cells), k), np.int64)
                for c in range(k):
                    apart = cells - centres[c]
                    out[:, c] = np.einsum("ij,ij->i", apart, apart)
                yield pa.RecordBatch.from_arrays(
                    [one.column("part"), one.column("ids"), one.column("k"), pa.array([out.tobytes()], pa.binary())],
                    ["part", "ids", "k", "partial"],
                )

    def added(key: tuple, group: pa.Table) -> pa.Table:
        k = group.column("k")[0].as_py()
        total = sum(np.frombuffer(p.as_buffer(), np.int64) for p in group.column("partial")).reshape(-1, k)
        cluster = total.argmin(axis=1)
        least = total[np.arange(len(total)), cluster]
        ids = group.filter(group.column("ids").is_valid()).column("ids").combine_chunks()
        whole = lambda x: pa.ListArray.from_arrays([0, len(x)], pa.array(x))
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()]), ids, whole(cluster.astype(np.int32)), whole(least.astype(np.int64))],
            ["part", "ids", "cluster", "distance"],
        )

    met = blocks.join(F.broadcast(slices), "shard").select("part", "ids", "cells", "k", "slice")
    partials = met.mapInArrow(partial, f"part long, ids array<{kind}>, k int, partial binary")
    return partials.groupBy("part").applyInArrow(
        added, f"part long, ids array<{kind}>, cluster array<int>, distance array<long>"
    )


def next_slices(blocks: DataFrame, slices: DataFrame, assigned: DataFrame) -> DataFrame:
    """Slices whose centroids are the means, rounded down, of the vectors assigned to them;
    a centroid without vectors stays.

    A block adds its columns by centroid before anything moves: a task sends as many sums as
    there are centroids and columns, and sums meet by (shard, centroid, column).
    """

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                shard, k = batch.column("shard")[row].as_py(), batch.column("k")[row].as_py()
                at = np.asarray(batch.column("cluster")[row].values)
                cells = np.frombuffer(batch.column("cells")[row].as_py(), np.int64).reshape(len(at), -1)
                many, total = held.get(shard, (np.zeros(k, np.int64), np.zeros((k, cells.shape[1]), np.int64)))
                np.add.at(total, at, cells)
                held[shard] = many + np.bincount(at, minlength=k), total
                if many.max(initial=0) > (1 << 34):  # sums stay within 64 bits
                    yield _as_rows({shard: held.pop(shard)})
        if held:
            yield _as_rows(held)

    pairs = blocks.select("part", "shard", "cells").join(assigned.select("part", "cluster"), "part")
    pairs = pairs.join(F.broadcast(slices.select("shard", "k")), "shard").select("shard", "k", "cluster", "cells")
    rows = pairs.mapInArrow(sums, "shard int, cluster int, place int, n long, total long")
    large = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    means = rows.groupBy("shard", "cluster", "place").agg(large("n"), large("total"))
    # a sum less its remainder is a multiple of the count, so this division is exact
    mean = F.expr("(total - pmod(total, n)) div n").cast("long")
    fresh = means.groupBy("shard").agg(F.collect_list(F.struct("cluster", "place", mean.alias("mean"))).alias("means"))

    def replaced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cells = np.frombuffer(row["slice"], np.int64).reshape(max(1, row["k"]), -1).copy()
                for m in row["means"] or []:
                    cells[m["cluster"], m["place"]] = m["mean"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]], pa.int32()),
                        pa.array([row["k"]], pa.int32()),
                        pa.array([cells.tobytes()], pa.binary()),
                    ],
                    ["shard", "k", "slice"],
                )

    return slices.join(fresh, "shard", "left").mapInArrow(replaced, _SLICE)


def _as_rows(held: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    parts = []
    for shard, (many, total) in held.items():
        at = np.flatnonzero(many)
        width = total.shape[1]
        parts.append(
            (
                np.full(len(at) * width, shard, np.int32),
                np.repeat(at, width).astype(np.int32),
                np.tile(np.arange(width, dtype=np.int32), len(at)),
                np.repeat(many[at], width),
                total[at].reshape(-1),
            )
        )
    columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["shard", "cluster", "place", "n", "total"])


def centroids(slices: DataFrame) -> DataFrame:
    """(cluster, centroid): the whole centroids, put together from the shards' slices. There
    are as many as the caller asked for."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cells = np.frombuffer(row["slice"], np.int64).reshape(row["k"], -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * row["k"], pa.int32()),
                        pa.array(range(row["k"]), pa.int32()),
                        pa.array(cells.tolist(), pa.list_(pa.int64())),
                    ],
                    ["shard", "cluster", "cells"],
                )

    parts = slices.filter("k > 0").mapInArrow(rows, "shard int, cluster int, cells array<long>")
    whole = parts.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("shard", "cells"))).alias("c"))
    return whole.select("cluster", F.flatten(F.col("c.cells")).alias("centroid"))


def clustered(
    vectors: DataFrame,
    ws: Workspace,
    k: int = 40,
    rounds: int = 5,
    dim: int = 64,
    scale: int = 256,
    salt: str = "2:",
    key: str = "vec_id",
    vector: str = "embedding",
    shards: int = SHARDS,
) -> tuple[DataFrame, DataFrame]:
    """((key, cluster, distance) of every kept vector, (cluster, centroid)).

    The first centroids are the ``k`` kept vectors whose digest of salt and key is smallest
    (all, if there are fewer; ties by components, null keys last). Every round assigns all
    vectors and moves all centroids; vectors are assigned once more at the end. Vectors that
    are null, have another length, or a component that is null or not finite are left out.
    Repeated rows count each, null keys stay, other columns are not read, and an empty table
    gives empty ones. Scaled components are held within +-2^27.
    """
    ship(vectors.sparkSession)
    points = whole_vectors(vectors, dim, scale, key, vector)
    blocks = ws.store("blocks", column_blocks(points, dim, shards))
    slices = ws.store("slices", first_slices(points, k, dim, shards, salt))
    for _ in range(rounds):
        slices = ws.store("slices", next_slices(blocks, slices, nearest(blocks, slices)))
    found = nearest(blocks, slices)
    one = F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("one")
    rows = found.select(one).select(
        F.col("one.ids").alias(key), F.col("one.cluster").alias("cluster"), F.col("one.distance").alias("distance")
    )
    return ws.store("assigned", rows), centroids(slices)
