"""Surrogate ids and the identifier crosswalk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.constants import ID_PREFIX, ID_WIDTH
from tessera.operators.ordering import left_join_spread, number_rows, row_place
from tessera.workspace import Workspace


def mint(seen: DataFrame, entity: str, ws: Workspace, counted: Observation | None = None) -> DataFrame:
    """``seen(key, seq)`` -> ``(key, seq, internal_id)``: ids follow first sight.

    The keys are reduced to one row each before they are ordered. An empty key
    is an error. ``counted`` gets the number of ids as ``n``. Where ``seen`` has a ``name``,
    the same pass finds the first one of every key, see ``names``. The ids are written as a
    stage table: Spark knows its size, and does not move rows by a key of few values to meet it.
    """
    empty = F.coalesce("key", F.lit("")) == ""
    checked = F.when(empty, F.raise_error(F.lit(f"empty {entity} key"))).otherwise(F.col("key"))
    named = ["named"] if "name" in seen.columns else []
    first = seen.groupBy(checked.alias("key")).agg(F.min("seq").alias("seq"), *[_first_name().alias(n) for n in named])
    numbered = number_rows(first, [F.col("seq"), F.col("key")], ws, f"mint_{entity}", counted=counted)
    text = F.format_string(f"{ID_PREFIX[entity]}:%0{ID_WIDTH}d", F.col("position"))
    return ws.store(f"{entity}_ids", numbered.select("key", "seq", text.alias("internal_id"), *named))


def _first_name() -> Column:
    """The first non-empty ``name`` by ``seq``, with its place."""
    place = F.struct(row_place(F.col("seq")).alias("at"), F.col("name"))
    return F.min(F.when(F.coalesce("name", F.lit("")) != "", place))


def names(minted: DataFrame) -> DataFrame:
    """(key, internal_id, name, seq): the first name of every minted key and where it was seen;
    all that a crosswalk keeps of the rows that the ids came from."""
    return minted.select("key", "internal_id", F.col("named.name").alias("name"), F.col("named.at.text").alias("seq"))


def xrefs(
    df: DataFrame,
    entity: str,
    internal_id: str,
    entries: list[tuple[Column, str, Column | None, bool]],
    seq: str = "seq",
) -> DataFrame:
    """Crosswalk observations ``(external id, source, name, primary)`` of every row, in
    one pass; entries without an external id drop out."""
    none = F.lit(None).cast("string")
    rows = F.array(
        *[
            F.struct(
                external.alias("external_id"),
                F.lit(source).alias("external_source"),
                (none if name is None else name).alias("name"),
                F.lit(primary).alias("is_primary"),
            )
            for external, source, name, primary in entries
        ]
    )
    return df.select(
        F.lit(entity).alias("entity_type"),
        F.col(internal_id).alias("internal_id"),
        F.col(seq).cast("string").alias("seq"),
        F.inline(rows),
    ).filter(F.coalesce("external_id", F.lit("")) != "")


def crosswalk(observations: list[DataFrame]) -> DataFrame:
    """One row per (internal, external, source): first non-empty name, OR of primary. The rows of
    many ids press into few bytes, so they are cut into a fixed number of parts: parts of a given
    size on disk would hold too many for the memory of a task."""
    seen = reduce(DataFrame.unionByName, observations)
    parts = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        seen.repartition(parts, "internal_id")
        .groupBy("entity_type", "internal_id", "external_id", "external_source")
        .agg(_first_name().alias("_named"), F.bool_or("is_primary").alias("is_primary"))
        .select(
            "internal_id",
            "entity_type",
            "external_id",
            "external_source",
            F.col("_named.name").alias("name"),
            "is_primary",
        )
    )


def lookup(keys: DataFrame, registry: DataFrame, key: str, out: str = "internal_id") -> DataFrame:
    """Internal id per key; null where the key was never minted."""
    ids = registry.select(F.col("key").alias(key), F.col("internal_id").alias(out))
    spread = keys.withColumn("_row", F.monotonically_increasing_id())
    return left_join_spread(spread, ids, key, "_row").drop("_row")


def entity_counts(registries: dict[str, DataFrame]) -> DataFrame:
    parts = [
        r.agg(F.count(F.lit(1)).alias("n_ids")).select(F.lit(e).alias("entity_type"), "n_ids")
        for e, r in registries.items()
    ]
    return reduce(DataFrame.unionByName, parts)
