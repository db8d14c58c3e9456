"""N-gram Jaccard join: exact classes of documents that share most of their shingles.

Equal sets become one class first. Small sets meet in hash keys of their subsets of fixed
size; large sets meet in inverted lists of their first shingles in a global order
(unshared, shared, frequent; then by hash). The boundary between both is where the
estimated cost is least. A frequency sketch of fixed size gives the order, so a shingle of
one document alone is never listed, and one that many unlike documents share comes last.

Lists are not expanded into pairs. Each list is first tied to its smallest member; only
members that end in different components are then compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations
from math import comb
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shipping import ship
from tessera.workspace import Workspace

#: Two documents link when PERCENT of their union is shared; shingles have WORDS words.
PERCENT = 75
WORDS = 5
#: Sets up to this size may be handled by subsets.
MOST_LIGHT = 24
#: A shingle in this many documents is frequent.
FREQUENT = 8
#: Bits of the frequency sketch; more of them tell more shingles apart.
SKETCH_BITS = 27
#: Longs of a set's parity bits: two sets differ in as many members as in bits, or more.
PARITY = 8
#: Bits of a shingle that are counted, and how many shingles a range should hold at most.
COUNTED_BITS = 40
RANGE_SHINGLES = 2_000_000
_FLUSH = 4_000_000
_CHUNK_CHARS = 8_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_REMEMBERED = 500_000


def least_overlap(a: int, b: int) -> int:
    """Shared members that sets of these sizes need to link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    """Of so many first members, two linked sets share one at least."""
    return n - -(-n * PERCENT // 100) + 1


# --- shingles ------------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit shingles. Fewer words than WORDS make one shingle."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(WORDS, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _STEP + w[k : len(w) - size + 1 + k]
    return np.unique(_mixed(h))


def _sets(texts: list[str | None], hashes: dict[bytes, int]) -> list[np.ndarray]:
    if len(hashes) > _REMEMBERED:
        hashes.clear()
    return [shingle_set(t, hashes) for t in texts]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts of a batch in pieces of bounded length."""
    texts = batch.column(1).to_pylist()
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < _CHUNK_CHARS):
            chars += len(texts[end] or "")
            end += 1
        yield batch.column(0).slice(at, end - at), texts[at:end]
        at = end


# --- frequency sketch ----------------------------------------------------------------


def _counted(docs: DataFrame, range_bits: int) -> DataFrame:
    """Distinct shingles of each task with their counts, by range of the hash; and at
    range -1 the number of sets of each small size."""
    rest = COUNTED_BITS - range_bits
    mask = np.uint64((1 << rest) - 1)

    def blocks(tokens: np.ndarray) -> pa.RecordBatch:
        values, counts = np.unique(tokens, return_counts=True)
        ranges = (values >> np.uint64(rest)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(ranges, prepend=-1))
        ends = [*cuts[1:].tolist(), len(values)]
        low = (values & mask).astype(np.uint32)
        n = np.minimum(counts, 65535).astype(np.uint16)
        pieces = list(zip(cuts.tolist(), ends, strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ranges[cuts], pa.int32()),
                pa.array([low[i:j].tobytes() for i, j in pieces], pa.binary()),
                pa.array([n[i:j].tobytes() for i, j in pieces], pa.binary()),
            ],
            ["range", "tokens", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting = 0
        sizes = np.zeros(MOST_LIGHT + 1, np.int64)
        hashes = _WordHashes()
        for batch in batches:
            for _, texts in _chunks(batch):
                for s in _sets(texts, hashes):
                    if 0 < len(s) <= MOST_LIGHT:
                        sizes[len(s)] += 1
                    held.append(s >> np.uint64(64 - COUNTED_BITS))
                    waiting += len(s)
                if waiting > _FLUSH:
                    yield blocks(np.concatenate(held))
                    held, waiting = [], 0
        if waiting:
            yield blocks(np.concatenate(held))
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array([sizes.tobytes()]), pa.array([b""])],
            ["range", "tokens", "counts"],
        )

    return docs.mapInArrow(run, "range int, tokens binary, counts binary")


def _sketched(counted: DataFrame, range_bits: int) -> DataFrame:
    """One row per range: bits of shared and of frequent shingles, and sums of counts."""
    rest, bits = COUNTED_BITS - range_bits, SKETCH_BITS - range_bits

    def packed(values: np.ndarray) -> bytes:
        flags = np.zeros(1 << bits, np.uint8)
        flags[values >> (rest - bits)] = 1
        return np.packbits(flags).tobytes()

    def run(table: pa.Table) -> pa.Table:
        if table["range"][0].as_py() < 0:
            sizes = sum(np.frombuffer(x, np.int64) for x in table["tokens"].to_pylist())
            row = [-1, sizes.tobytes(), b"", 0, 0]
        else:
            values = np.concatenate([np.frombuffer(x, np.uint32) for x in table["tokens"].to_pylist()])
            counts = np.concatenate([np.frombuffer(x, np.uint16) for x in table["counts"].to_pylist()])
            order = np.argsort(values, kind="stable")
            values, counts = values[order], counts[order].astype(np.int64)
            first = np.flatnonzero(np.diff(values.astype(np.int64), prepend=-1))
            n = np.add.reduceat(counts, first)
            values = values[first]
            row = [
                table["range"][0].as_py(), packed(values[n > 1]), packed(values[n >= FREQUENT]),
                int(n.sum()), int((n * n).sum()),
            ]
        return pa.table(dict(zip(_SKETCH.names, ([x] for x in row), strict=True)), schema=_SKETCH)

    return counted.groupBy("range").applyInArrow(
        run, "range int, shared binary, frequent binary, n long, n2 long"
    )


_SKETCH = pa.schema(
    [("range", pa.int32()), ("shared", pa.binary()), ("frequent", pa.binary()), ("n", pa.int64()), ("n2", pa.int64())]
)


class Order:
    """The global order of shingles and the boundary between small and large sets.
    Its size is fixed by SKETCH_BITS, whatever the number of documents."""

    def __init__(self, shared: np.ndarray, frequent: np.ndarray, boundary: int) -> None:
        self.shared, self.frequent, self.boundary = shared, frequent, boundary

    @classmethod
    def of(cls, rows: Iterable, range_bits: int) -> "Order":
        size = 1 << (SKETCH_BITS - range_bits - 3)
        shared = np.zeros(1 << (SKETCH_BITS - 3), np.uint8)
        frequent = np.zeros_like(shared)
        sizes, n, n2 = np.zeros(MOST_LIGHT + 1, np.int64), 0, 0
        for r in rows:
            if r["range"] < 0:
                sizes = np.frombuffer(r["shared"], np.int64)
                continue
            at = r["range"] * size
            shared[at : at + size] = np.frombuffer(r["shared"], np.uint8)
            frequent[at : at + size] = np.frombuffer(r["frequent"], np.uint8)
            n, n2 = n + r["n"], n2 + r["n2"]
        return cls(shared, frequent, cheapest_boundary(sizes, n2 / max(1, n)))

    def ranked(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set in global order, and 0, 1 or 2 for unshared, shared, frequent."""
        at = s >> np.uint64(64 - SKETCH_BITS)
        byte, bit = (at >> np.uint64(3)).astype(np.int64), 7 - (at & np.uint64(7)).astype(np.int64)
        kind = ((self.shared[byte] >> bit) & 1) + ((self.frequent[byte] >> bit) & 1)
        order = np.argsort(kind, kind="stable")
        return s[order], kind[order]


def n_subsets(n: int, boundary: int) -> int:
    """Subsets that a set of this size has to offer to others up to the boundary."""
    return sum(comb(n, least_overlap(n, m)) for m in _partner_sizes(n, boundary))


def _partner_sizes(n: int, boundary: int) -> range:
    return range(-(-n * PERCENT // 100), min(boundary, n * 100 // PERCENT) + 1)


def cheapest_boundary(sizes: np.ndarray, list_length: float) -> int:
    """The size up to which subsets cost less than scanning lists of the mean length that a
    shingle meets. Sets just below the boundary do both, as they may link across it."""

    def cost(x: int) -> float:
        total = 0.0
        for n in range(1, len(sizes)):
            if n <= x:
                total += sizes[n] * n_subsets(n, x)
            if n > x or n >= (x + 1) * PERCENT / 100:
                total += sizes[n] * prefix_length(n) * list_length
        return total

    return min(range(len(sizes)), key=cost)


# --- keys ----------------------------------------------------------------------------


def subset_keys(ranked: np.ndarray, kind: np.ndarray, boundary: int) -> list[int]:
    """A hash for each subset of fixed size that a set of a partner's size could share."""
    n, out = len(ranked), []
    shared = sorted(ranked[kind > 0].tolist())
    for m in _partner_sizes(n, boundary):
        k = least_overlap(n, m)
        head = f"{min(n, m)}|{max(n, m)}|".encode()
        for chosen in combinations(shared, k):
            out.append(xxhash.xxh3_64_intdigest(head + np.array(chosen, np.uint64).tobytes()))
    return out


def _keyed(docs: DataFrame, order) -> DataFrame:
    """One row per document: size, 128-bit digest of its set, keys, and the members of
    sets that have a key. ``first`` is the place of the first listed shingle, and
    ``listed`` of the keys are shingles; the others are subsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: Order = order.value
        hashes = _WordHashes()
        for batch in batches:
            for ids, texts in _chunks(batch):
                cols: list[list] = [[] for _ in range(7 + PARITY)]
                for s in _sets(texts, hashes):
                    digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    keys, first, listed = _keys_of(s, by)
                    row = [len(s), int(digest[0]), int(digest[1]), keys, first, listed]
                    row += [s.tobytes(), *_parity(s)] if len(keys) else [None] * (1 + PARITY)
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                arrays = [pa.array(c, f.type) for c, f in zip(cols, list(_KEYED)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *arrays], schema=_KEYED)

    return docs.mapInArrow(
        run,
        "doc long, n int, sig1 long, sig2 long, keys array<long>, first int, listed int, members binary, "
        + ", ".join(f"{b} long" for b in _BITS),
    )


def _parity(s: np.ndarray) -> list[int]:
    """For each of the bits, whether an odd number of members falls on it."""
    odd = np.bincount((s % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


_BITS = [f"b{i}" for i in range(PARITY)]


_KEYED = pa.schema(
    [
        ("doc", pa.int64()), ("n", pa.int32()), ("sig1", pa.int64()), ("sig2", pa.int64()),
        ("keys", pa.list_(pa.int64())), ("first", pa.int32()), ("listed", pa.int32()), ("members", pa.binary()),
        *((f"b{i}", pa.int64()) for i in range(PARITY)),
    ]
)


def _keys_of(s: np.ndarray, by: Order) -> tuple[np.ndarray, int, int]:
    n = len(s)
    if not n:
        return np.empty(0, np.int64), 0, 0
    ranked, kind = by.ranked(s)
    if n > by.boundary or n >= (by.boundary + 1) * PERCENT / 100:
        p = prefix_length(n)
        first = int(np.searchsorted(kind[:p], 1))
        lists = ranked[first:p]
    else:
        first, lists = 0, ranked[:0]
    light = subset_keys(ranked, kind, by.boundary) if n <= by.boundary else []
    return np.concatenate([lists, np.array(light, np.uint64)]).view(np.int64), first, len(lists)


# --- links ---------------------------------------------------------------------------


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. A pair meets the set of ``b`` first, so that an ``a``
    in many pairs is joined last and its rows need not move again."""
    of = lambda x: sets.select(
        F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("members").alias(f"m_{x}")
    )
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    met = pairs.join(of("b"), "b").join(of("a"), "a").filter(small * 100 >= large * PERCENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch["m_a"], batch["m_b"], strict=True)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                kept[i] = both >= least_overlap(len(a), len(b))
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    return met.select("a", "b", "m_a", "m_b").mapInArrow(run, "a long, b long")


def _pairs_across(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of a list's members in different components that may link. The largest
    component of a list meets only the others, never itself. Parity bits tell how many
    members two sets differ in at least, so hardly a pair that does not link leaves the join."""
    sides = entries.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n_comp"))
    split = (
        sides.groupBy("key")
        .agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("n_comp", "comp")).alias("top"))
        .filter("comps > 1")
        .select("key", F.col("top.comp").alias("major"))
    )
    open_lists = entries.join(split, "key").join(sets.select("cls", *_BITS), "cls")
    side = lambda df, s: df.select(
        "key",
        F.col("cls").alias(s),
        *[F.col(c).alias(f"{c}_{s}") for c in ("n", "at", "comp", *_BITS)],
        *(["major"] if s == "y" else []),
    )
    x, y = side(open_lists.filter("comp <> major"), "x"), side(open_lists, "y")
    least = F.ceil((F.col("n_x") + F.col("n_y")) * PERCENT / (100 + PERCENT))
    left = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    differ = reduce(add, [F.bit_count(F.col(f"{b}_x").bitwiseXOR(F.col(f"{b}_y"))) for b in _BITS])
    near = (
        (F.col("comp_x") != F.col("comp_y"))
        & ((F.col("comp_y") == F.col("major")) | (F.col("x") < F.col("y")))
        & (F.coalesce(left, F.least("n_x", "n_y")) >= least)
        & (F.col("n_x") + F.col("n_y") - 2 * least >= differ)
    )
    both = x.join(y, "key").filter(near)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def classes(docs: DataFrame, ws: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``n_shingles``, ``component_id`` (smallest linked key).

    Null or blank texts have no shingles and link with nothing; rows with a null key take no
    part and get a null component. Rows that share a key count as one document. An empty
    table gives an empty one; other columns are not read. Keys must be whole numbers.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")
    )
    range_bits = max(12, int(np.ceil(np.log2(max(1, docs.count()) * 1000 / RANGE_SHINGLES))))
    told = ws.store("sketch", _sketched(_counted(rows, range_bits), range_bits))
    order = spark.sparkContext.broadcast(Order.of(told.toLocalIterator(), range_bits))
    keyed = ws.store("keyed", _keyed(rows, order))
    order.destroy()  # the written keys are all that later steps read

    valid = keyed.filter("doc is not null and n > 0")
    reps = valid.groupBy("sig1", "sig2").agg(F.min("doc").alias("cls"))
    ids = ws.store("ids", valid.select("doc", "sig1", "sig2").join(reps, ["sig1", "sig2"]).select("doc", "cls").distinct())
    with_keys = valid.filter(F.size("keys") > 0)
    firsts = ids.filter("doc = cls").select("doc").distinct()
    sets = ws.store(
        "sets",
        with_keys.join(firsts, "doc", "left_semi").select(
            F.col("doc").alias("cls"), "n", "keys", "first", "listed", "members", *_BITS
        ),
    )
    links = ws.store("links", _all_links(sets, ws))
    # rows that share a key tie the classes of their texts together
    tied = ids.groupBy("doc").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a < b")
    twins = ids.join(tied.select("doc", "a"), "doc").filter("cls <> a").select("a", F.col("cls").alias("b")).distinct()
    comps = components(links.union(twins), ws)
    of_doc = ids.groupBy("doc").agg(F.min("cls").alias("cls"))
    of_doc = of_doc.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select(
        "doc", F.coalesce("comp", "cls").alias("comp")
    )
    return (
        keyed.select("doc", "n")
        .join(of_doc, "doc", "left")
        .select(
            F.col("doc").alias(key),
            F.col("n").cast("long").alias("n_shingles"),
            F.coalesce("comp", "doc").alias("component_id"),
        )
    )


def _all_links(sets: DataFrame, ws: Workspace) -> DataFrame:
    listed = sets.select(
        "cls", "n", F.posexplode("keys").alias("at", "key"), "first", "listed"
    ).select(
        "key", "cls", "n", F.when(F.col("at") < F.col("listed"), F.col("at") + F.col("first")).alias("at")
    )
    lists = listed.groupBy("key").agg(F.min("cls").alias("lowest"), F.max("cls").alias("highest"))
    entries = ws.store("entries", listed.join(lists.filter("lowest < highest").select("key", "lowest"), "key"))
    stars = entries.filter("cls <> lowest").select(F.col("lowest").alias("a"), F.col("cls").alias("b")).distinct()
    stars = ws.store("stars", stars)
    near = ws.store("star_links", _verified(stars, sets))
    comps = components(near, ws)
    placed = entries.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select(
        "key", "cls", "n", "at", F.coalesce("comp", "cls").alias("comp")
    )
    placed = ws.store("placed", placed)
    across = _pairs_across(placed, sets).join(stars, ["a", "b"], "left_anti")
    across = ws.store("across", across)
    return near.union(_verified(across, sets))
