"""Table contracts: declared schema, row checks, key dedup, and the rejection ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.constants import (
    EXAMPLE_CHARS,
    EXAMPLES_PER_REASON,
    PRIMARY_KEY,
    TABLES,
    UNIT_RANGE,
)
from tessera.operators.ordering import first_per_key, row_place, top_per_group
from tessera.workspace import Workspace


def to_contract(df: DataFrame, table: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Schema columns in order; missing ones are null; empty text becomes null."""
    have = set(df.columns)
    out = []
    for name, kind, _ in TABLES[table]:
        c = F.col(name) if name in have else F.lit(None)
        c = F.nullif(c, F.lit("")) if kind == "string" and name in have else c
        out.append(c.cast(kind).alias(name))
    return df.select(*out, *[k for k in keep if k not in dict(df.select(*out).dtypes)])


def violation(table: str) -> Column:
    """Why a row breaks the contract, first reason wins; null when it is fine."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c, _, req in TABLES[table] if req])
    reason = F.when(missing, "missing_required_field")
    for c in UNIT_RANGE.get(table, []):
        bad = F.isnan(c) | ~F.col(c).between(0.0, 1.0)
        reason = reason.when(F.col(c).isNotNull() & bad, "schema_violation")
    return reason


def split_valid(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rejected rows with ``reason``)."""
    tagged = df.withColumn("reason", violation(table))
    return tagged.filter("reason is null").drop("reason"), tagged.filter("reason is not null")


def dedup_key(df: DataFrame, table: str, order: list[Column]) -> DataFrame:
    return first_per_key(df, PRIMARY_KEY[table], order)


def duplicate_keys(df: DataFrame, table: str) -> DataFrame:
    """Surplus rows per primary key, counted by a partial aggregate."""
    return df.groupBy(*PRIMARY_KEY[table]).agg((F.count(F.lit(1)) - 1).alias("surplus")).filter("surplus > 0")


def counted_rows(df: DataFrame, seen: Observation | None, n: Column | None = None) -> DataFrame:
    """``df``; whoever writes it first tells ``seen`` its rows (or the sum of ``n``), without a scan
    of their own. A lost executor can make a shuffle's input count twice, never its rows."""
    total = F.count(F.lit(1)) if n is None else F.coalesce(F.sum(n), F.lit(0))
    return df if seen is None else df.observe(seen, total.cast("long").alias("n"))


def conform(
    df: DataFrame, table: str, seq: str = "seq", seen: Observation | None = None
) -> tuple[DataFrame, DataFrame]:
    """Clean table and its rejections; ``seq`` decides which duplicate stays. Writing the clean
    table tells ``seen`` the rows that came in."""
    shaped = to_contract(df, table, keep=(seq,))
    good, bad = split_valid(shaped, table)
    keys = PRIMARY_KEY[table]
    sound = split_valid(counted_rows(shaped, seen), table)[0]
    clean = dedup_key(sound, table, [F.col(seq)]).drop(seq)
    stage = f"build:{table}"
    rejected = rejections(bad, stage, F.col("reason"), F.to_json(F.struct(*keys)), seq)
    surplus = (
        good.groupBy(*keys)
        .agg((F.count(F.lit(1)) - 1).alias("n"), F.min(seq).alias(seq))
        .filter("n > 0")
    )
    duplicates = rejections(
        surplus, stage, F.lit("duplicate_primary_key"), F.to_json(F.struct(*keys)), seq, F.col("n")
    )
    return clean, rejected.unionByName(duplicates)


# --- ledger -----------------------------------------------------------------------
def rejections(
    df: DataFrame,
    stage: str,
    reason: Column,
    example: Column,
    seq: str = "seq",
    n: Column | None = None,
) -> DataFrame:
    return df.select(
        F.lit(stage).alias("stage"),
        reason.alias("reason"),
        F.substring(F.coalesce(example.cast("string"), F.lit("")), 1, EXAMPLE_CHARS).alias("example"),
        (n if n is not None else F.lit(1)).cast("long").alias("n"),
        F.col(seq).cast("string").alias("seq"),
    )


def ledger(parts: list[DataFrame], ws: Workspace) -> DataFrame:
    """Count per (stage, reason) and the first five distinct examples by first sight.

    The examples are reduced and written once; counts and examples both read that."""
    seen = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("stage", "reason", "example")
        .agg(F.sum("n").alias("n"), F.min(row_place(F.col("seq"))).alias("at"))
    )
    seen = ws.store("rejections", seen)
    counts = seen.groupBy("stage", "reason").agg(F.sum("n").alias("n_rejected"))
    shown = top_per_group(
        seen, ["stage", "reason"], [F.col("at"), F.col("example")], EXAMPLES_PER_REASON
    )
    examples = shown.groupBy("stage", "reason").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "example"))), lambda s: s["example"]).alias(
            "examples"
        )
    )
    return counts.join(examples, ["stage", "reason"])
