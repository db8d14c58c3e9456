"""The operators of this subpackage as named queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import (
    bpe, covertree, jaccard, line_dedup, lloyd, mixing, pii, quality, token_orc, toxicity, trie, urls, warc,
)
from tessera.workspace import Workspace


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def _workspace(spark: SparkSession, name: str) -> Workspace:
    """A folder of its own for each run, so that no run reads what another wrote."""
    return Workspace(spark, f"{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:8]}")


def word_bpe_path() -> str:
    """The vocabulary file of the encoding query; every executor has it with the library."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe.encode(_read(spark, folder, "documents"), word_bpe_path(), decoded=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    fold = lambda key: F.crc32(F.col(key).cast("string").cast("binary")) % 5
    labels = _read(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels.filter(fold("doc_id") != 0), _workspace(spark, "toxicity"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id") == 0, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(_read(spark, folder, "documents"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"].isin(list(pii.BASE)))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.written(base), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"].isin(list(pii.SECRETS)))).cast("long").alias("n_secret"),
        F.size("spans").cast("long").alias("n_spans"),
        F.round(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)), 1).alias("top_score"),
    )


def op4_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _read(spark, folder, "embeddings").select("vec_id", "embedding")
    return covertree.top_k(vectors, k=10, every=100)


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_read(spark, folder, "pages"))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = line_dedup.deduped(_read(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(_read(spark, folder, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    rows = mixing.mixed(docs, _workspace(spark, "mixing"))
    return rows.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


def op9_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    ws = _workspace(spark, "jaccard")
    return jaccard.classes(_read(spark, folder, "documents").select("doc_id", "text"), ws)


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derive(warc.as_responses(_read(spark, folder, "pages")))


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _read(spark, folder, "embeddings").select("vec_id", "embedding")
    rows, centroids = lloyd.clustered(vectors, _workspace(spark, "lloyd"), k=40, rounds=5)
    summed = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    # as many rows as there are clusters from here to the last join
    sums = rows.groupBy("cluster").agg(summed("distance").alias("own"))
    sums = sums.withColumn("all", F.sum("own").over(Window.partitionBy(F.lit(0))))
    held = lambda c: F.least(F.col(c), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    facts = sums.join(centroids, "cluster").select(
        "cluster",
        held("own").alias("cluster_inertia"),
        held("all").alias("inertia"),
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"),
    )
    return rows.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    ws = _workspace(spark, "trie")
    turns = trie.ordered_turns(_read(spark, folder, "conversations"), ws)
    rebuilt, sizes = trie.with_shared_openings(turns, ws)
    return trie.rolled_up(rebuilt, sizes, ws)


def op13_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    path = _workspace(spark, "orc").path("token_ids")
    token_orc.write(_read(spark, folder, "documents").select("doc_id", "text"), path, byte_bpe_path())
    files = token_orc.read(spark, path)
    rows = token_orc.starts(token_orc.checksums(files), files)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_exact_topk": op4_exact_topk,
    "op5_url_filters": op5_url_filters,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_warc": op10_warc,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_orc": op13_token_orc,
}
