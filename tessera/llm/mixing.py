"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic. The cells' token weights are
raked: scaled so that each margin in turn meets its target shares, until all do. A
document stays with the probability of its cell, by a hash of its key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.llm.words import words
from tessera.workspace import Workspace

DIMENSIONS = ("source", "lang", "topic")
#: Raking ends when no margin is off by more than this share of all tokens. Where targets
#: contradict each other it ends once a round moves no weight by more than that, or after so many
#: rounds: one margin can stand still for good while the others still close in.
TOLERANCE = 1e-12
ROUNDS = 60
#: Power of the token shares that serves as target where the caller gives none: the
#: exponent in common use for sampling languages of unlike size.
FLATTENING = 0.7
UNKNOWN = "unknown"
CELLS_PER_TASK = 200_000


def topic(text: Column) -> Column:
    """A coarse register of a text, from marks in it and its length."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit(" | ")), "table")
        .when(F.contains(t, F.lit("icense")), "notice")
        .when(F.length(t) < 600, "short")
        .when(F.length(t) < 3000, "medium")
        .otherwise("long")
    )


def cells_of(docs: DataFrame, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Tokens per cell. Counted before they move, so a source of any size is a row per task."""
    return docs.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens"))


def flattened_targets(cells: DataFrame, dim: str, power: float = FLATTENING) -> DataFrame:
    """(value, share): token shares raised to ``power`` and scaled to one."""
    sums = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").cast("double").alias("t"))
    raised = sums.select("value", F.when(F.col("t") > 0, F.pow("t", F.lit(power))).otherwise(0.0).alias("s"))
    total = raised.agg(F.sum("s").alias("all"))
    return raised.join(F.broadcast(total)).select(  # one row
        "value", F.when(F.col("all") > 0, F.col("s") / F.col("all")).otherwise(0.0).alias("share")
    )


def raked(
    cells: DataFrame,
    targets: Mapping[str, DataFrame],
    ws: Workspace,
    tolerance: float = TOLERANCE,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``cells`` with ``weight``: shares of all tokens whose margins meet ``targets``, and
    ``deviation``: the largest share by which a margin missed its target in the last round.

    ``targets`` has a table (value, share) for each dimension. A value without target
    gets the share 0; a value whose cells have no tokens cannot get any, and targets that
    contradict each other leave a deviation above ``tolerance``.
    Every round is written, which cuts the lineage, and its deviation comes with the write,
    by ``observe``. Up to ``CELLS_PER_TASK`` cells a round is one task, a window for each
    dimension; more cells are summed by value first, so that those of a frequent value
    never meet in one task. Both give the same weights.
    """
    start = cells.agg(F.sum("tokens").cast("double").alias("_all"))
    share = F.when(F.col("_all") > 0, F.col("tokens") / F.col("_all")).otherwise(0.0)
    counted = Observation()
    table = cells.join(F.broadcast(start)).withColumn("weight", share).drop("_all")  # one row
    for dim, t in targets.items():
        named = t.select(F.col("value").alias(dim), F.col("share").cast("double").alias(f"_share_{dim}"))
        table = table.join(named, dim, "left").fillna(0.0, [f"_share_{dim}"])
    table = ws.store("cells", table.observe(counted, F.count(F.lit(1)).alias("n")))
    tasks = 1 + counted.get["n"] // CELLS_PER_TASK
    table = table.coalesce(tasks)
    worst = None
    for _ in range(rounds):
        off, table = [], table.withColumn("_was", F.col("weight"))
        for dim in targets:
            table = _with_sums(table, dim, tasks)
            to, have = F.col(f"_share_{dim}"), F.col("_sum")
            factor = F.when(have > 0, to / have).otherwise(0.0)
            table = table.withColumns({f"_off_{dim}": F.abs(to - have), "weight": F.col("weight") * factor}).drop("_sum")
            off.append(F.max(f"_off_{dim}").alias(dim))
        seen = Observation()
        moved = F.max(F.abs(F.col("weight") - F.col("_was"))).alias("_moved")
        table = table.observe(seen, *off, moved).drop("_was", *[f"_off_{d}" for d in targets])
        table = ws.store("raked", table).coalesce(tasks)
        told = dict(seen.get)
        moved = told.pop("_moved")
        worst = max((o for o in told.values() if o is not None), default=None)
        if worst is None or worst <= tolerance or moved <= tolerance:
            break
    return table.drop(*[f"_share_{d}" for d in targets]).withColumn("deviation", F.lit(worst).cast("double"))


def _with_sums(table: DataFrame, dim: str, tasks: int) -> DataFrame:
    """``table`` with ``_sum``: the weight of all cells that share the row's value of ``dim``."""
    if tasks == 1:
        return table.withColumn("_sum", F.sum("weight").over(Window.partitionBy(dim)))
    sums = table.groupBy(F.struct(dim).alias("_of")).agg(F.sum("weight").alias("_sum"))
    return table.join(sums.select("_of.*", "_sum").hint("merge"), dim)


def uniform(key: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on the key alone: 52 bits of a digest."""
    h = F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _placed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, cell, n_tokens): each document whole, with its cell."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{key}`").alias("key"),
        known("source").alias("source"),
        known("lang").alias("lang"),
        topic(F.col(f"`{text}`")).alias("topic"),
        F.size(words(F.col(f"`{text}`"))).cast("long").alias("n_tokens"),
    )


def chances(
    docs: DataFrame,
    ws: Workspace,
    targets: Mapping[str, DataFrame] | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(source, lang, topic, weight, probability): the raked share of every cell, and the
    chance of its documents: the ratio of raked to original share, scaled so that the
    largest is 1. No document is repeated, and as many as the targets allow stay."""
    cells = ws.store("tokens", cells_of(_placed(docs, key, text)))
    wanted = targets or {d: ws.store(f"target_{d}", flattened_targets(cells, d)) for d in DIMENSIONS}
    fitted = raked(cells, wanted, ws)
    original = cells.agg(F.sum("tokens").cast("double").alias("all"))
    change = F.when(F.col("tokens") > 0, F.col("weight") * F.col("all") / F.col("tokens"))
    ratio = fitted.join(F.broadcast(original)).select(  # one row
        *DIMENSIONS, "weight", change.alias("ratio")
    )
    ratio = ws.store("ratios", ratio)
    most = ratio.agg(F.max("ratio").alias("most"))
    chance = F.when(F.col("most") > 0, F.col("ratio") / F.col("most"))
    return ratio.join(F.broadcast(most)).select(  # one row
        *DIMENSIONS, "weight", F.coalesce(chance, F.lit(0.0)).alias("probability")
    )


def _drawn(docs: DataFrame, table: DataFrame, key: str, text: str) -> DataFrame:
    rows = _placed(docs, key, text).join(table, list(DIMENSIONS), "left")
    rows = rows.withColumn("probability", F.when(F.col("n_tokens") > 0, F.col("probability")).otherwise(0.0))
    named = F.coalesce(F.col("key").cast("string"), F.lit(""))
    return rows.withColumn("kept", uniform(named) < F.col("probability"))


def mixed(
    docs: DataFrame,
    ws: Workspace,
    targets: Mapping[str, DataFrame] | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: key, cell, ``n_tokens``, ``weight`` (its cell's raked share),
    ``probability`` and ``kept``.

    Null sources and languages form the value "unknown"; null and empty texts have no
    tokens, add nothing and have probability 0. Rows with equal keys share their fate
    within a cell, null keys count as one. Columns other than key, text, source and lang are
    not read. An empty table gives an empty one.
    """
    docs = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"), "source", "lang")
    drawn = _drawn(docs, chances(docs, ws, targets, key, text), key, text)
    names = (*DIMENSIONS, "n_tokens", "weight", "probability", "kept")
    return drawn.select(F.col("key").alias(key), *names)


def sampled(
    docs: DataFrame,
    ws: Workspace,
    targets: Mapping[str, DataFrame] | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that ``mixed`` keeps, with their own columns. The table of cells is
    joined to the rows, so their texts stay where they are while it is small."""
    return _drawn(docs, chances(docs, ws, targets, key, text), key, text).filter("kept").select("row.*")
