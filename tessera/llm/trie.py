"""Prefix trie of conversations, and sums over its subtrees by centroid decomposition.

A node is a distinct sequence of first turns; its name is (conv, depth): its smallest member and
the number of turns. Prefixes are told apart by 120 bits: the exclusive or, over the turns so
far, of a digest of each turn's place, role and text. Running values are worked out slice by slice
of the ordered rows, so a conversation of any length is spread over many tasks.

Subtree sums by plain propagation would take a round for each level of depth. Here the forest
of parent edges is split at centroids instead. A node weighs as many conversations as pass
through it, so the weight of its subtree is known from its members alone. In each component

* the nodes whose subtree holds more than half of the component's weight form the path from the
  component's top to its centroid, the lightest of them,
* the totals of the centroid's subtree are added to every node of that path,
* the centroid leaves; each child's subtree, and what is left above, are new components of at
  most half the weight.

So there are at most log2(all turns) + 1 rounds, whatever the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.llm.shipping import ship
from tessera.operators.ordering import number_rows
from tessera.workspace import Workspace

#: Ids that are written into one piece of text before pieces are digested in order.
IDS_AT_ONCE = 4096


def ordered_turns(
    conversations: DataFrame,
    ws: Workspace,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conv, i, digest, chars): every turn with its place, from 1, in its conversation.

    The order is that of ``turn``, null first; turns that share a number are ordered by the
    digest of role and text, and equal turns count each. Null roles and texts are empty. Rows
    without a conversation id belong to none and are left out; other columns are not read.
    """
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = conversations.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.sha2(F.concat(F.length(said(role)).cast("string"), F.lit(":"), said(role), said(text)), 256).alias("digest"),
        F.length(said(text)).cast("long").alias("chars"),
    )
    order = [F.asc_nulls_first("turn"), F.asc("digest")]
    numbered = number_rows(rows, order, ws, "turns", group=["conv"], out="i")
    return ws.store("positions", numbered.select("conv", "i", "digest", "chars"))


def lengths(turns: DataFrame) -> DataFrame:
    """(conv, n): turns of each conversation."""
    return turns.groupBy("conv").agg(F.max("i").alias("n"))


def with_shared_openings(turns: DataFrame, ws: Workspace, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the openings of others: (turns, lengths).

    Conversation c takes the first h turns of conversation c - c % every (all if fewer, none
    if absent) in place of its own first h; h is the CRC-32 of c in decimal, modulo ``most``.
    """
    own = ws.store("lengths", lengths(turns))
    donors = own.select(F.col("conv").alias("donor"), F.col("n").alias("given"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    built = own.withColumns({"h": h, "donor": F.col("conv") - F.col("conv") % every}).join(donors, "donor", "left")
    built = built.withColumn("taken", F.least("h", F.coalesce("given", F.lit(0))))
    left = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    built = ws.store("built", built.select("conv", "donor", "h", "taken", (F.col("taken") + left).alias("n")))
    kept = turns.join(built.select("conv", "h", "taken"), "conv").filter("i > h")
    kept = kept.select("conv", (F.col("i") - F.col("h") + F.col("taken")).alias("i"), "digest", "chars")
    openings = turns.filter(F.col("i") < most).withColumnRenamed("conv", "donor")
    given = built.filter("taken > 0").select("conv", "donor", "taken").join(openings, "donor").filter("i <= taken")
    return kept.unionByName(given.select("conv", "i", "digest", "chars")), built.select("conv", "n")


def _prefixes(turns: DataFrame, ws: Workspace) -> DataFrame:
    """(conv, depth, x, y, chars): the key of every prefix, by running exclusive or."""
    name = F.sha2(F.concat_ws("|", F.col("i").cast("string"), "digest"), 256)
    word = lambda at: F.conv(F.substring("_name", at, 15), 16, 10).cast("long")
    words = turns.withColumn("_name", name).select("conv", "i", "chars", word(1).alias("x"), word(16).alias("y"))
    placed = words.repartitionByRange("conv", "i").sortWithinPartitions("conv", "i")
    placed = ws.store("prefixes", placed.withColumn("_slice", F.spark_partition_id()))
    by = ["_slice", "conv"]
    sums = placed.groupBy(*by).agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    earlier = Window.partitionBy("conv").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"_{c}")
    before = ws.store("before", sums.select(*by, before("x"), before("y")))
    so_far = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select(*by, "i", "chars", *[F.bit_xor(c).over(so_far).alias(c) for c in "xy"])
    whole = lambda c: F.col(c).bitwiseXOR(F.col(f"_{c}")).alias(c)
    return local.join(before, by).select("conv", F.col("i").alias("depth"), whole("x"), whole("y"), "chars")


def trie(turns: DataFrame, sizes: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """The trie of (conv, i, digest, chars) and (conv, n): (nodes, paths).

    Nodes: conv, depth, parent (conv of the parent; null for the root), n_convs, n_children,
    chars (of the last turn), weight (turns that members have from here on). Paths: for every
    conversation and depth the ``node`` it passes (its conv), that node's ``parent``, and
    whether the conversation ends there. A conversation without turns ends at the root; without
    conversations there is no root.
    """
    root = sizes.select("conv", *[F.lit(0).cast("long").alias(c) for c in ("depth", "x", "y", "chars")])
    rows = _prefixes(turns, ws).unionByName(root).join(sizes, "conv")
    rows = ws.store("rows", rows)
    key = ["depth", "x", "y"]
    # grouped by one struct, so that the sums are dealt anew for the join below and hot keys can be split
    nodes = rows.groupBy(F.struct(*key).alias("key")).agg(
        F.min("conv").alias("node"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("chars").alias("chars"),
        F.sum(F.col("n") - F.col("depth") + 1).alias("weight"),
    )
    nodes = ws.store("nodes", nodes.select("key.*", "node", "n_convs", "chars", "weight"))
    passed = rows.join(nodes.select(*key, "node"), key)
    passed = ws.store("passed", passed.select("conv", "depth", "node", (F.col("depth") == F.col("n")).alias("ends")))
    above = passed.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    paths = ws.store("paths", passed.join(above, ["conv", "depth"], "left"))
    named = nodes.select(F.col("node").alias("conv"), "depth", "n_convs", "chars", "weight")
    parents = paths.filter("conv = node").select("conv", "depth", "parent")
    tree = ws.store("parents", named.join(parents, ["conv", "depth"]))
    children = tree.filter("depth > 0").groupBy(F.struct("parent", "depth").alias("key"))
    children = children.agg(F.count(F.lit(1)).alias("n_children")).select(
        F.col("key.parent").alias("conv"), (F.col("key.depth") - 1).alias("depth"), "n_children"
    )
    tree = tree.join(children, ["conv", "depth"], "left")
    return ws.store("tree", tree.withColumn("n_children", F.coalesce("n_children", F.lit(0)))), paths


def _per_top(rows: DataFrame, **sums: Column) -> DataFrame:
    """Aggregates of each component. Grouped by one struct, so that what joins them is dealt out
    anew and Spark can split a component that holds most rows."""
    grouped = rows.groupBy(F.struct("tc", "td").alias("_top")).agg(*[c.alias(name) for name, c in sums.items()])
    return grouped.select("_top.*", *sums)


def subtree_sums(tree: DataFrame, paths: DataFrame, values: Sequence[str], ws: Workspace) -> DataFrame:
    """(conv, depth, *values): every column of ``values`` summed over each node's subtree, the
    node included, by centroid decomposition. ``tree`` has conv, depth, weight and the values,
    ``paths`` are those of ``trie``. A round writes its components' state and additions."""
    value = [F.col(v) for v in values]
    first = tree.filter("depth = 0").select("conv").first()
    if first is None:
        return tree.select("conv", "depth", *value)
    state = tree.select("conv", "depth", "weight", F.lit(first["conv"]).alias("tc"), F.lit(0).cast("long").alias("td"), *value)
    steps = paths.select("conv", F.col("depth").alias("_next"), F.col("node").alias("_wc"), F.col("parent").alias("_pc"))
    added = []
    while True:
        totals = _per_top(state, total=F.max("weight"))
        heavy = state.join(totals, ["tc", "td"]).filter("2 * weight > total")
        cut = _per_top(heavy, _c=F.min(F.struct("weight", "depth", "conv")), total=F.max("total"))
        cut = cut.select("tc", "td", "total", F.col("_c.weight").alias("_cw"), F.col("_c.depth").alias("_cd"), F.col("_c.conv").alias("_cc"))
        met = state.join(cut, ["tc", "td"]).withColumn("_next", F.col("_cd") + 1).join(steps, ["conv", "_next"], "left")
        inside = F.coalesce((F.col("depth") >= F.col("_next")) & (F.col("_pc") == F.col("_cc")), F.lit(False))
        is_centre = (F.col("conv") == F.col("_cc")) & (F.col("depth") == F.col("_cd"))
        on_path = 2 * F.col("weight") > F.col("total")
        left = Observation()
        marked = met.observe(left, F.count(F.when(~is_centre, 1)).alias("n")).select(
            "conv",
            "depth",
            (F.col("weight") - F.when(on_path, F.col("_cw")).otherwise(0)).alias("weight"),
            "tc",
            "td",
            F.when(inside, F.col("_wc")).otherwise(F.col("tc")).alias("_tc"),
            F.when(inside, F.col("_next")).otherwise(F.col("td")).alias("_td"),
            on_path.alias("on_path"),
            (inside | is_centre).alias("lower"),
            is_centre.alias("is_centre"),
            *value,
        )
        marked = ws.store("marked", marked)
        lower = _per_top(marked.filter("lower"), **{v: F.sum(v) for v in values})
        path = marked.filter("on_path").select("conv", "depth", "tc", "td")
        added.append(ws.store("added", path.join(lower, ["tc", "td"]).select("conv", "depth", *value)))
        if not left.get["n"]:
            break
        rest = marked.filter("not is_centre")
        state = rest.select("conv", "depth", "weight", F.col("_tc").alias("tc"), F.col("_td").alias("td"), *value)
    rows = added[0]
    for more in added[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("conv", "depth").agg(*[F.sum(v).alias(v) for v in values])


def end_digests(paths: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256): for each node where conversations end the digest of their
    ids, ascending and joined by commas. Ids are written into pieces where they lie in order;
    a node's pieces are then digested one after the other, and none is held."""
    ship(paths.sparkSession)
    ends = paths.filter("ends").select("node", "depth", "conv")
    order = ["node", "depth", "conv"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = pieces.mapInArrow(_pieces, "node long, depth long, first long, ids string")
    pieces = pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "first")
    return pieces.mapInArrow(_digests, "conv long, depth long, ends_sha256 string")


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[int, int, int, list[str]]] = []
        for node, depth, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if not out or out[-1][:2] != (node, depth) or len(out[-1][3]) >= IDS_AT_ONCE:
                out.append((node, depth, conv, []))
            out[-1][3].append(str(conv))
        if out:
            node, depth, first, ids = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(depth, pa.int64()), pa.array(first, pa.int64()), pa.array(map(",".join, ids))],
                ["node", "depth", "first", "ids"],
            )


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, digest, done = None, None, []

    def rows() -> pa.RecordBatch:
        conv, depth, text = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(text)], ["conv", "depth", "ends_sha256"]
        )

    for batch in batches:
        for i in range(batch.num_rows):
            node = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            if node != name:
                if name is not None:
                    done.append((*name, digest.hexdigest()))
                name, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(batch.column(3)[i].as_buffer())
        if done:
            yield rows()
            done = []
    if name is not None:
        done.append((*name, digest.hexdigest()))
        yield rows()


def rolled_up(turns: DataFrame, sizes: DataFrame, ws: Workspace) -> DataFrame:
    """Nodes of the trie with their rollups: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, the characters
    that members after a node's first need not store again), ends_sha256. Empty turns and
    repeated conversations are nodes and members like others; an empty table gives no node."""
    tree, paths = trie(turns, sizes, ws)
    own = tree.withColumns(
        {
            "n_leaves": (F.col("n_children") == 0).cast("long"),
            "saved_tokens": (F.col("n_convs") - 1) * F.col("chars"),
        }
    )
    sums = subtree_sums(own, paths, ["n_leaves", "saved_tokens"], ws)
    rows = tree.join(sums, ["conv", "depth"]).join(end_digests(paths), ["conv", "depth"], "left")
    return rows.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
