"""Document pipeline: quality rules, line dedup, near duplicates, mixing, encoding.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that its
predecessor kept. Stages but the last return the columns of ``docs``. Every stage is written
as parquet and read again, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, line_dedup, mixing, quality
from tessera.llm.queries import word_bpe_path
from tessera.workspace import Workspace

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _workspace(spark: SparkSession, name: str) -> Workspace:
    return Workspace(spark, f"{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:8]}")


def _packed(docs: DataFrame) -> DataFrame:
    """Id, text, and the other columns as one, so that no name of theirs meets a result's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    of = lambda c: F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c)
    return rows.select(*[of(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _unpacked(quality.judge(_packed(docs)).filter("kept"), docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the shared lines; ``n_chars``, where there is one, follows the text."""
    done = _unpacked(line_dedup.deduped(_packed(docs)), docs)
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id. Of rows that
    share an id one stays; rows with a null id are in no class and all stay."""
    found = jaccard.classes(docs.select("doc_id", "text"), _workspace(spark, "near"))
    named = _packed(docs).join(found.filter("doc_id = component_id").select("doc_id"), "doc_id", "left_semi")
    once = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    first = named.withColumn("_place", F.row_number().over(once)).filter("_place = 1")
    return _unpacked(first, docs).union(docs.filter("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled towards flattened shares of sources, languages and topics."""
    return mixing.sampled(docs, _workspace(spark, "mix"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of ids and decoded text."""
    encoded = bpe.encode(docs, word_bpe_path(), decoded=True)
    return encoded.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("bpe", encode),
]

#: SQL has neither the merges of the vocabulary nor raking to a tolerance.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    ws = _workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = ws.store(name, stage(spark, docs, sf_dir))
    return docs
