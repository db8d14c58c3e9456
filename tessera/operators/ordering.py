"""Ordering operators that keep any one group out of a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.workspace import Workspace


def row_place(seq: Column) -> Column:
    """Where a row came, as one sortable value: numbers by size, texts (file, block, line) as
    they are. It is the order in which ids are minted from the same column."""
    text = seq.cast("string")
    # a text that starts with a letter is no number; a failed cast costs more than all else here
    number = F.when((text < ":") | (text >= "\x7f"), text.try_cast("bigint"))
    return F.struct(number.alias("number"), text.alias("text"))


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    ws: Workspace,
    name: str,
    group: Sequence[str] = (),
    out: str = "position",
    counted: Observation | None = None,
) -> DataFrame:
    """1..N per group in the given order, without one task per group.

    The rows are range-partitioned by (group, order), so a group that holds a
    large share of all rows is spread over many tasks. They are written once in
    that layout; each row remembers its slice and its place in it. The number of
    rows in the earlier slices of the same group is then added. The offset table
    has at most (slices + groups) rows. ``counted`` gets the number of rows as ``n``.
    """
    keys = [F.col(g) for g in group]
    placed = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_at", 33))
    )
    if counted is not None:
        placed = placed.observe(counted, F.count(F.lit(1)).alias("n"))
    placed = ws.store(name, placed)
    by = ["_slice", *group]
    slices = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    if not group:
        return _numbered(placed, _before_each_slice(slices), by, out)
    earlier = (
        Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = slices.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return _numbered(placed, ws.store(f"{name}_offsets", offsets), by, out)


def _before_each_slice(slices: DataFrame) -> DataFrame:
    """Rows before each slice when there is one group: one number per slice, so the
    list is as short as the partition list and is worked out once."""
    rows, before = [], 0
    for r in sorted(slices.collect(), key=lambda r: r["_slice"]):
        rows.append((r["_slice"], r["_first"], before))
        before += r["_n"]
    return slices.sparkSession.createDataFrame(rows, "_slice long, _first long, _before long")


def _numbered(placed: DataFrame, offsets: DataFrame, by: list[str], out: str) -> DataFrame:
    position = (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("long")
    return placed.join(offsets, by).withColumn(out, position).drop("_at", "_slice", "_first", "_before")


def left_join_spread(left: DataFrame, right: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join on a text key that is often null. Null keys match nothing; they get a
    key of their own row, so they do not meet in one task."""
    own = F.concat(F.lit("\x00"), F.col(spread_by).cast("string"))
    keyed = left.withColumn("_key", F.coalesce(F.col(key), own))
    return keyed.join(right.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str | None = None
) -> DataFrame:
    """The first ``k`` rows per group. Each task keeps at most ``k`` rows of a group
    before the shuffle, so a hot group costs ``k`` rows per task."""
    name = out or "_place"
    kept = df.withColumn(
        name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    ).filter(F.col(name) <= k)
    return kept if out else kept.drop(name)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of every key."""
    return top_per_group(df, key, order, 1)


def split_join(left: DataFrame, right: DataFrame, key: str, pairs_per_part: int = 1_000_000) -> DataFrame:
    """Inner join whose output per task is bounded, however often a key occurs.

    Keys with more than ``pairs_per_part`` pairs are hot. They are cut into parts: the side that
    has more rows of a key is dealt out over its parts row by row, the other one is copied to each;
    the number of partitions is fixed there, as small inputs with a large product would be
    put together again. All other keys meet in a plain join, which Spark may broadcast or
    coalesce. Without hot keys only the counts and that join are left of the plan.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    sizes = count(left, "_nl").join(count(right, "_nr"), key)
    parts = F.ceil(F.col("_nl") * F.col("_nr") / pairs_per_part).cast("int")
    hot = sizes.select(key, parts.alias("_parts"), (F.col("_nl") <= F.col("_nr")).alias("_copy_left"))
    hot = hot.filter("_parts > 1")
    cold = lambda df: df.join(hot.select(key), key, "left_anti")

    def dealt(df: DataFrame, copied: Column) -> DataFrame:
        # by place, not by content, so that equal rows are dealt out too
        own = F.pmod(F.col("_row"), F.col("_parts")).cast("int")
        places = F.when(copied, F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(own))
        cut = df.withColumn("_row", F.monotonically_increasing_id()).join(hot, key)
        cut = cut.withColumn("_part", F.explode(places)).drop("_row", "_parts", "_copy_left")
        return cut.repartition(n, key, "_part")

    met = dealt(left, F.col("_copy_left")).join(dealt(right, ~F.col("_copy_left")), [key, "_part"]).drop("_part")
    return cold(left).join(cold(right), key).unionByName(met)
