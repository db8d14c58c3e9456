"""Cross-table checks, each as a small query of its own, and all of them in one pass per table."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.constants import CORE_TABLES, FOREIGN_KEY, NULL_WARN_FRACTION, PRIMARY_KEY, TABLES


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def required_ids(tables: dict[str, DataFrame]) -> DataFrame:
    """Null or empty key values per table and key column, one pass per table."""
    parts = []
    for name, df in tables.items():
        keys = [k for k in PRIMARY_KEY[name] if k in df.columns]
        bad = df.agg(*[F.count_if(F.coalesce(k, F.lit("")) == "").alias(k) for k in keys])
        parts.append(
            bad.unpivot([], keys, "column_name", "n_bad").withColumn("table_name", F.lit(name))
        )
    return _union(parts)


def duplicate_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Surplus rows per primary key."""
    parts = [
        df.groupBy(*PRIMARY_KEY[name])
        .agg((F.count(F.lit(1)) - 1).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_duplicate"))
        .withColumn("table_name", F.lit(name))
        for name, df in tables.items()
    ]
    return _union(parts)


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose foreign key is unknown; a null key is an orphan; a missing parent is null."""
    parts = []
    for name, (column, parent) in FOREIGN_KEY.items():
        if name not in tables:
            continue
        rel = tables[name]
        if parent in tables:
            known = tables[parent].select(F.col(PRIMARY_KEY[parent][0]).alias(column)).distinct()
            lost = rel.join(known, column, "left_anti").agg(F.count(F.lit(1)).alias("n_orphan"))
        else:
            lost = rel.limit(0).agg(F.lit(None).cast("long").alias("n_orphan"))
        parts.append(
            lost.select(
                F.lit(name).alias("table_name"),
                F.lit(column).alias("column_name"),
                F.lit(parent).alias("parent"),
                "n_orphan",
            )
        )
    return _union(parts)


def null_levels(tables: dict[str, DataFrame], threshold: float = NULL_WARN_FRACTION) -> DataFrame:
    """Null fraction of every non-key column at or above the threshold; empty tables are skipped."""
    parts = []
    for name, df in tables.items():
        columns = [c for c in df.columns if c not in PRIMARY_KEY[name]]
        levels = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
        parts.append(
            levels.unpivot([], columns, "column_name", "null_fraction").withColumn(
                "table_name", F.lit(name)
            )
        )
    return _union(parts).filter(F.col("null_fraction") >= threshold)


def core_tables(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        tables[name].limit(1).agg((F.count(F.lit(1)) > 0).alias("non_empty")).withColumn(
            "table_name", F.lit(name)
        )
        for name in CORE_TABLES
        if name in tables
    ]
    return _union(parts)


def table_facts(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """One row with all that the checks ask of a table, from one scan: rows, rows without each
    key, surplus rows of a key, orphan rows, and nulls of each other column.

    Rows are grouped by key first, so repeats are counted there; the groups are summed
    by parent, and only those sums meet the parent's keys. Orphans are null where the
    parent table is missing.
    """
    df, keys = tables[name], PRIMARY_KEY[name]
    columns = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in columns]
    )
    bad = {k: F.sum(F.when(F.coalesce(k, F.lit("")) == "", F.col("n")).otherwise(0)) for k in keys}
    sums = [
        F.sum("n").alias("n_rows"),
        F.sum(F.col("n") - 1).alias("n_duplicate"),
        *[c.alias(f"bad {k}") for k, c in bad.items()],
        *[F.sum(f"null {c}").alias(f"null {c}") for c in columns],
    ]
    column, parent = FOREIGN_KEY.get(name, (None, None))
    if column is None or parent not in tables:
        return grouped.agg(*sums).withColumn("n_orphan", F.lit(None).cast("long"))
    by_parent = grouped.groupBy(column).agg(*sums)
    known = tables[parent].select(F.col(PRIMARY_KEY[parent][0]).alias(column)).distinct()
    met = by_parent.join(known.withColumn("_known", F.lit(True)), column, "left")
    totals = [F.sum(c).alias(c) for c in by_parent.columns if c != column]
    lost = F.sum(F.when(F.col("_known").isNull(), F.col("n_rows")).otherwise(0))
    return met.agg(*totals, F.coalesce(lost, F.lit(0)).alias("n_orphan"))


def _check(name: Column, severity: str, passed: Column, detail: Column) -> Column:
    return F.struct(
        name.alias("check_name"), F.lit(severity).alias("severity"), passed.alias("passed"),
        F.when(passed, "").otherwise(detail).alias("detail"),
    )


def _checks_of(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The checks of one table, unfolded from its row of facts."""
    columns = [c for c in tables[name].columns if c not in PRIMARY_KEY[name]]
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    missing = reduce(add, [n(f"bad {k}") for k in PRIMARY_KEY[name]])
    # fixed values: names and details of the checks
    checks = [
        _check(F.lit(f"{name}: required ids populated"), "error", missing == 0, F.concat(F.lit("nulls/empties: "), missing)),
        _check(
            F.lit(f"{name}: unique primary key"), "error", n("n_duplicate") == 0,
            F.concat(n("n_duplicate"), F.lit(" duplicate rows")),
        ),
    ]
    if name in FOREIGN_KEY:
        column, parent = FOREIGN_KEY[name]
        lost = F.coalesce(F.concat(F.col("n_orphan"), F.lit(" orphan rows")), F.lit(f"{parent} table missing"))
        found = F.coalesce(F.col("n_orphan") == 0, F.lit(False))
        checks.append(_check(F.lit(f"{name}.{column} -> {parent}"), "error", found, lost))
    if name in CORE_TABLES:
        checks.append(_check(F.lit(f"{name}: non-empty"), "warning", n("n_rows") > 0, F.lit("0 rows")))
    for c in columns:
        share = F.col(f"null {c}") / F.nullif("n_rows", F.lit(0))
        told = F.concat(F.round(share * 100).cast("int"), F.lit("% null"))
        high = _check(F.lit(f"{name}.{c}: missing-value level"), "warning", F.lit(False), told)
        checks.append(F.when(share >= NULL_WARN_FRACTION, high))
    return table_facts(name, tables).select(F.inline(F.array_compact(F.array(*checks))))


def quality_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """(check_name, severity, passed, detail) for all five families, from one scan of each table."""
    return _union([_checks_of(name, tables) for name in tables])


def verdict(checks: DataFrame) -> DataFrame:
    """ok unless a check of severity error fails."""
    hard = ~F.col("passed") & (F.col("severity") == "error")
    return checks.agg(
        (F.count_if(hard) == 0).alias("ok"),
        F.count_if(hard).alias("n_hard_failures"),
        F.count_if(~F.col("passed")).alias("n_failed"),
        F.count(F.lit(1)).alias("n_checks"),
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return _union(
        [
            df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(name))
            for name, df in tables.items()
        ]
    )


# --- sanitising before use ---------------------------------------------------------------
# fixed values: columns that must be present when a stored table is used
IN_USE = {
    "diseases": ["disease_id", "disease_name"],
    "disease_genes": ["disease_id", "gene_id"],
    "disease_pathways": ["disease_id", "pathway_id", "pathway_name"],
    "drugs": ["drug_id", "drug_name"],
    "drug_side_effects": ["drug_id", "side_effect_id", "side_effect_name"],
    "drug_targets": ["drug_id", "target_id"],
}


def _usable(name: str):
    required = IN_USE[name]
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    return ~(missing | (F.trim(required[0]) == ""))


def sanitize(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Drop rows without ids, exact repeats and orphans; count each reason."""
    clean, issues = {}, []
    for name in IN_USE:
        if name not in tables:
            continue
        df = tables[name]
        usable = df.filter(_usable(name))
        distinct = usable.distinct()
        groups = usable.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("n"))
        issues.append(df.filter(~_usable(name)).agg(F.count(F.lit(1)).alias("n")).withColumns(
            {"table_name": F.lit(name), "reason": F.lit("missing required id/name")}))
        issues.append(groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumns(
            {"table_name": F.lit(name), "reason": F.lit("exact duplicate row")}))
        clean[name] = distinct
    for name, (column, parent) in FOREIGN_KEY.items():
        if name not in clean or parent not in clean:
            continue
        known = clean[parent].select(F.col(PRIMARY_KEY[parent][0]).alias(column)).distinct()
        lost = clean[name].join(known, column, "left_anti")
        issues.append(lost.agg(F.count(F.lit(1)).alias("n")).withColumns(
            {"table_name": F.lit(name), "reason": F.lit(f"{column} not in {parent}")}))
        clean[name] = clean[name].join(known, column, "left_semi").select(*TABLE_COLUMNS[name])
    return clean, _union(issues).filter("n > 0")


TABLE_COLUMNS = {name: [c for c, _, _ in cols] for name, cols in TABLES.items()}
