"""Weak labels, grouped validation, two classifiers, scores and per-row attributions."""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.constants import (
    CV_FOLDS, LEAF_ROWS, MAX_DEPTH, MAX_ITERATIONS, MODEL_COLUMNS, SEED, TOP_FEATURES, TREES, ZERO_STD,
)
from tessera.functions.numbers import direction, logistic, tidy
from tessera.operators import forest
from tessera.operators.candidates import PAIR
from tessera.workspace import Workspace, shared_folder

MODELS = ["logistic_regression", "random_forest"]
METRICS = ["roc_auc", "pr_auc", "precision", "recall", "f1"]
MODEL_VERSION = "1.0.0"
#: Fits of the validation that run side by side.
FITS_AT_ONCE = 4


class NotTrained(RuntimeError):
    """No fitted model is stored where one was expected."""


# --- labels and training rows ---------------------------------------------------------
def labelled(features: DataFrame, diseases: DataFrame, known: DataFrame) -> DataFrame:
    """``label`` is 1 iff the pair's drug is a known clinical candidate of the disease.

    Only diseases with an ontology id take part; a drug without a ChEMBL id is 0."""
    onto = diseases.filter("ontology_id is not null").select("disease_id", "ontology_id")
    hits = known.select("ontology_id", "chembl_id").distinct().withColumn("_hit", F.lit(1))
    rows = features.join(onto, "disease_id")
    # drugs without a ChEMBL id match nothing; their own id keeps them apart
    rows = rows.withColumn("_mol", F.coalesce("chembl_id", F.concat(F.lit("\x00"), "drug_id")))
    joined = rows.join(hits.withColumnRenamed("chembl_id", "_mol"), ["ontology_id", "_mol"], "left")
    return joined.withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit", "_mol")


def training_summary(rows: DataFrame) -> DataFrame:
    n, pos = F.count(F.lit(1)), F.sum("label")
    return rows.agg(
        n.alias("n_rows"),
        F.coalesce(pos, F.lit(0)).alias("n_positive"),
        F.count_distinct("disease_id").alias("n_diseases"),
        tidy(pos / n, 6).alias("positive_prevalence"),
    )


# --- matrix ----------------------------------------------------------------------------
def number(c: str) -> Column:
    """The value as a double; null, NaN and infinity (none of them below infinity) are 0."""
    v = F.col(c).cast("double")
    return F.when(F.abs(v) < float("inf"), v).otherwise(0.0)


def matrix(rows: DataFrame) -> DataFrame:
    """The model columns in order as doubles: null and non-finite are 0, flags are 0/1."""
    return rows.withColumns({c: number(c) for c in MODEL_COLUMNS})


def _x() -> Column:
    return F.array(*[number(c) for c in MODEL_COLUMNS])


def column_stats(rows: DataFrame) -> DataFrame:
    """One row: means and population deviations of the model columns; flat columns scale by 1."""
    m = matrix(rows)
    mean = F.array(*[F.avg(c) for c in MODEL_COLUMNS]).alias("means")
    std = F.array(*[F.stddev_pop(c) for c in MODEL_COLUMNS])
    scale = F.transform(std, lambda s: F.when(s < ZERO_STD, 1.0).otherwise(s)).alias("scales")
    return m.agg(mean, scale)


@dataclass
class Stats:
    """Means and scales of the model columns: two short lists of numbers."""

    means: list[float]
    scales: list[float]

    @classmethod
    def of(cls, rows: DataFrame) -> "Stats":
        r = column_stats(rows).first()
        return cls(list(r["means"]), list(r["scales"]))


def standardized(i: int, stats: Stats) -> Column:
    return (number(MODEL_COLUMNS[i]) - stats.means[i]) / stats.scales[i]


def standardize(rows: DataFrame, stats: Stats) -> DataFrame:
    """Add ``z``, the standardised vector."""
    return rows.withColumn("z", F.array(*[standardized(i, stats) for i in range(len(MODEL_COLUMNS))]))


def class_weights(rows: DataFrame) -> DataFrame:
    """n / (2 * n_class) per label."""
    total = Window.partitionBy()
    per = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("weight", F.sum("n").over(total) / (F.col("n") * 2))

# fixed values: distinct cut points of a count column in the forest
MAX_BINS = 256


# --- grouped folds -------------------------------------------------------------------------
def folds(rows: DataFrame, k: int = CV_FOLDS) -> DataFrame:
    """Whole diseases to ``min(k, diseases)`` folds, largest first into the lightest fold.

    The driver reads one size per disease, a list as long as the disease catalogue, and
    keeps one load per fold."""
    sizes = rows.groupBy("disease_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.orderBy(F.desc("n"), "disease_id").collect()
    loads = [(0, fold) for fold in range(min(k, len(sizes)))]
    placed = []
    for r in sizes:
        load, fold = heapq.heappop(loads)
        placed.append((r["disease_id"], fold))
        heapq.heappush(loads, (load + r["n"], fold))
    return rows.sparkSession.createDataFrame(placed, "disease_id string, fold int")


# --- metrics -------------------------------------------------------------------------------
def _tie_groups(scored: DataFrame, by: list[str]) -> DataFrame:
    """Counts per distinct score. Scores carry six decimals, so a group has at most
    a million and one of them however many rows it scores."""
    return scored.groupBy(*by, "score").agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")
    )


def fold_metrics(scored: DataFrame, by: list[str] = ["model", "fold"]) -> DataFrame:
    """``scored(model, fold, label, score)`` -> ROC-AUC, average precision, and the
    0.5-threshold metrics; the areas are null when a fold has one class only."""
    ties = _tie_groups(scored, by)
    upto = Window.partitionBy(*by).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cum = ties.withColumns({"tp": F.sum("pos").over(upto), "fp": F.sum("neg").over(upto)})
    hot = F.col("score") >= 0.5
    sums = cum.groupBy(*by).agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area"),
        F.coalesce(F.sum(F.when(hot, F.col("pos"))), F.lit(0)).alias("tp5"),
        F.coalesce(F.sum(F.when(hot, F.col("neg"))), F.lit(0)).alias("fp5"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    precision = share(F.col("tp5"), F.col("tp5") + F.col("fp5"))
    recall = share(F.col("tp5"), F.col("p"))
    f1 = share(2 * F.col("tp5"), F.col("tp5") + F.col("fp5") + F.col("p"))
    return sums.select(
        *by,
        (F.col("p") + F.col("n")).alias("n_rows"),
        F.col("p").alias("n_positive"),
        tidy(F.when(both, F.col("area") / (F.col("p") * F.col("n"))), 6).alias("roc_auc"),
        tidy(F.when(both, F.col("ap") / F.col("p")), 6).alias("pr_auc"),
        tidy(precision, 6).alias("precision"),
        tidy(recall, 6).alias("recall"),
        tidy(f1, 6).alias("f1"),
    )


def cv_summary(metrics: DataFrame) -> DataFrame:
    """Mean and population deviation over folds; undefined values are skipped."""
    aggs = []
    for m in METRICS:
        aggs += [tidy(F.avg(m), 6).alias(f"{m}_mean"), tidy(F.stddev_pop(m), 6).alias(f"{m}_std")]
    return metrics.groupBy("model").agg(*aggs, F.count(F.lit(1)).alias("n_folds"))


def select_model(summary: DataFrame, order: list[str] = MODELS) -> DataFrame:
    """Highest mean average precision, then ROC-AUC, then list order."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return summary.orderBy(
        F.coalesce("pr_auc_mean", F.lit(-1.0)).desc(), F.coalesce("roc_auc_mean", F.lit(-1.0)).desc(), place
    ).limit(1)


# --- fitting ---------------------------------------------------------------------------------
@dataclass
class Fitted:
    name: str
    model: LogisticRegressionModel | RandomForestClassificationModel
    stats: Stats
    metadata: dict
    #: the trees of a forest as its rows walk them, once they are read
    walks: Walks | None = None


def guard(rows: DataFrame) -> dict:
    """Refuse an empty or single-class target; returns the training counts."""
    s = training_summary(rows).first().asDict()
    if s["n_rows"] == 0:
        raise ValueError("empty training dataset")
    if s["n_positive"] in (0, s["n_rows"]):
        raise ValueError(f"degenerate target: {s['n_positive']}/{s['n_rows']} positive")
    return s


def _label_weights(s: dict) -> tuple[float, float]:
    """The weights of the labels 0 and 1."""
    pos, n = s["n_positive"], s["n_rows"]
    return n / (2.0 * (n - pos)), n / (2.0 * pos)


def _weighted(rows: DataFrame, s: dict) -> DataFrame:
    zero, one = _label_weights(s)
    return rows.withColumn("weight", F.when(F.col("label") == 1, one).otherwise(zero))


def _vector(rows: DataFrame, name: str, stats: Stats) -> DataFrame:
    """``features`` vector: standardised for the linear model, plain for the forest."""
    if name == "logistic_regression":
        cols = {f"_z{i}": standardized(i, stats) for i in range(len(MODEL_COLUMNS))}
        out = VectorAssembler(inputCols=list(cols), outputCol="features").transform(rows.withColumns(cols))
        return out.drop(*cols)
    return VectorAssembler(inputCols=MODEL_COLUMNS, outputCol="features").transform(matrix(rows))


def _detached(fitted, spark: SparkSession):
    """The model as read back from its files. A fresh fit holds its training rows and through them
    the session, which its tasks would then have to carry along."""
    path = f"{shared_folder(spark)}/tessera/{spark.sparkContext.applicationId}-models/{uuid.uuid4().hex}"
    fitted.write().save(path)
    return type(fitted).load(path)


def fit(
    rows: DataFrame, name: str, trees: int = TREES, counts: dict | None = None, with_stats: bool = True
) -> Fitted:
    """Fit one classifier. ``counts`` are the training counts when they are known already;
    the forest needs the column statistics for its record only."""
    s = counts or guard(rows)
    stats = Stats.of(rows) if with_stats or name == "logistic_regression" else Stats([], [])
    if name == "random_forest":
        settings = forest.Settings(trees, MAX_DEPTH, LEAF_ROWS, MAX_BINS, SEED)
        fitted = forest.fit(rows, [number(c) for c in MODEL_COLUMNS], _label_weights(s), s["n_rows"], settings)
        return Fitted(name, fitted, stats, s)
    train = _vector(_weighted(rows, s), name, stats).select("features", "label", "weight").persist()
    est = LogisticRegression(
        weightCol="weight", maxIter=MAX_ITERATIONS, elasticNetParam=0.0, regParam=1.0 / s["n_rows"],
        standardization=False, tol=1e-6,
    )
    fitted = _detached(est.fit(train), rows.sparkSession)
    train.unpersist()
    return Fitted(name, fitted, stats, s)


def save(fitted: Fitted, path: str, spark: SparkSession) -> None:
    """The model and its record: how it was validated and chosen, on what, with which columns."""
    fitted.model.write().overwrite().save(f"{path}/model")
    meta = {
        **fitted.metadata, "model_name": fitted.name, "model_version": MODEL_VERSION,
        "feature_columns": MODEL_COLUMNS, "means": fitted.stats.means, "scales": fitted.stats.scales,
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(path: str, spark: SparkSession) -> Fitted:
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    except Exception as e:
        raise NotTrained(f"no trained model under {path}") from e
    kind = LogisticRegressionModel if meta["model_name"] == "logistic_regression" else RandomForestClassificationModel
    return Fitted(meta["model_name"], kind.load(f"{path}/model"), Stats(meta["means"], meta["scales"]), meta)


# --- scoring -----------------------------------------------------------------------------------
def score(rows: DataFrame, f: Fitted) -> DataFrame:
    """``rows`` with the probability of class 1. A forest's is the mean rate over its trees, as in
    Spark's model, whose objects took six times as long."""
    if f.name == "random_forest":
        return rows.withColumn("model_output", tidy(_walked(f, rows.sparkSession, "rate"), 6))
    out = f.model.transform(_vector(rows, f.name, f.stats))
    p = vector_to_array("probability")[1]
    return out.withColumn("model_output", tidy(p, 6)).drop("features", "rawPrediction", "probability", "prediction")


def baseline(f: Fitted, ws: Workspace) -> float:
    if f.name == "logistic_regression":
        return round(float(1 / (1 + np.exp(-f.model.intercept))), 6)
    nodes = forest_nodes(f, ws)
    return round(float(nodes.filter("id = 0").agg(F.avg("rate")).first()[0]), 6)


# --- attribution: linear -------------------------------------------------------------------------
def linear_attribution(rows: DataFrame, coefficients: list[float], stats: Stats) -> DataFrame:
    """Add ``contributions``: coefficient times standardised value, per model column."""
    parts = [standardized(i, stats) * float(c) for i, c in enumerate(coefficients)]
    return rows.withColumn("contributions", F.array(*parts))


def linear_score(rows: DataFrame, coefficients: list[float], intercept: float, stats: Stats) -> DataFrame:
    """Probability and contributions of a linear model with known coefficients."""
    out = linear_attribution(rows, coefficients, stats)
    margin = F.aggregate("contributions", F.lit(float(intercept)), lambda a, c: a + c)
    return out.withColumns(
        {
            "model_output": tidy(logistic(margin), 6),
            "baseline_output": tidy(logistic(F.lit(float(intercept))), 6),
        }
    )


# --- attribution: forest ---------------------------------------------------------------------------
def forest_nodes(f: Fitted, ws: Workspace) -> DataFrame:
    """(tree, id, feature, threshold, left, right, rate, rows) from the stored node table."""
    return _exported(f, ws.path("forest_export"), ws.spark)


def _exported(f: Fitted, path: str, spark: SparkSession) -> DataFrame:
    f.model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    n = "nodeData"
    stats = F.col(f"{n}.impurityStats")
    total = stats[0] + stats[1]
    return data.select(
        F.col("treeID").alias("tree"),
        F.col(f"{n}.id").alias("id"),
        F.col(f"{n}.split.featureIndex").alias("feature"),
        F.get(f"{n}.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col(f"{n}.leftChild").alias("left"),
        F.col(f"{n}.rightChild").alias("right"),
        F.when(total > 0, stats[1] / total).otherwise(0.0).alias("rate"),
        F.col(f"{n}.rawCount").alias("rows"),
    )


def forest_facts(f: Fitted, ws: Workspace) -> DataFrame:
    """What any forest fitted with these settings must show: its trees, leaves that hold too few
    rows, nodes below the depth limit, and splits on columns that do not exist. The node table has
    at most trees * 2^(depth+1) rows."""
    data = ws.store("forest_nodes", forest_nodes(f, ws))
    level = data.filter("id = 0").select("tree", "id", "left", "right")
    for _ in range(MAX_DEPTH):
        down = level.filter("left >= 0").select("tree", F.explode(F.array("left", "right")).alias("id"))
        level = data.select("tree", "id", "left", "right").join(down, ["tree", "id"])
    deep = level.agg(F.count_if(F.col("left") >= 0).alias("n_deep"))
    leaf, split = F.col("left") < 0, F.col("left") >= 0
    facts = data.agg(
        F.count_distinct("tree").alias("n_trees"),
        F.count_if(leaf & (F.col("id") > 0) & (F.col("rows") < LEAF_ROWS)).alias("n_small_leaves"),
        F.count_if(split & ~F.col("feature").between(0, len(MODEL_COLUMNS) - 1)).alias("n_foreign_splits"),
        F.count_if(~F.col("rate").between(0, 1)).alias("n_outside"),
    )
    return facts.join(F.broadcast(deep))  # one row each


@dataclass
class Walks:
    """All trees as full heaps down to the deepest leaf, in arrays (tree, place). A leaf above sends
    every row left, so that all rows take as many steps."""

    features: list[np.ndarray]  # per level: the column asked
    limits: list[np.ndarray]  # per level: larger values go right
    rates: np.ndarray  # at the end of a walk
    shares: np.ndarray  # (tree, place, column): what the walk adds to the rate, by column


def _walks(f: Fitted, spark: SparkSession) -> Walks:
    """Read once for a fitted forest; at most trees * 2^(depth+1) nodes."""
    if f.walks is None:
        path = f"{shared_folder(spark)}/tessera/{spark.sparkContext.applicationId}-models/{uuid.uuid4().hex}-nodes"
        f.walks = _heaps(_exported(f, path, spark).toPandas())
    return f.walks


def _heaps(nodes: pd.DataFrame) -> Walks:
    trees, width = [t.sort_values("id") for _, t in nodes.groupby("tree", sort=True)], len(MODEL_COLUMNS)
    level = [np.zeros(len(trees), dtype=np.int64)[:, None]]  # node at every place of a level
    sums = np.zeros((len(trees), 1, width))
    columns = {c: [t[c].to_numpy() for t in trees] for c in ("feature", "threshold", "left", "right", "rate")}
    of = lambda c, at: np.array([v[a] for v, a in zip(columns[c], at)])
    features, limits = [], []
    while (split := of("left", level[-1]) >= 0).any():
        at = level[-1]
        feature = np.where(split, of("feature", at), 0)
        left, right = np.where(split, of("left", at), at), np.where(split, of("right", at), at)
        features.append(feature)
        limits.append(np.where(split, of("threshold", at).astype(float), np.inf))
        level.append(np.stack([left, right], axis=2).reshape(len(trees), -1))
        change = of("rate", level[-1]) - np.repeat(of("rate", at), 2, axis=1)
        sums = np.repeat(sums, 2, axis=1)
        t, p = np.indices(change.shape)
        sums[t, p, np.repeat(feature, 2, axis=1)] += change
    return Walks(features, limits, of("rate", level[-1]), sums)


def _walked(f: Fitted, spark: SparkSession, result: str) -> Column:
    """Rows stay where they are and walk all trees in Arrow batches, tree by tree; ``result`` is the
    ``rate`` of class 1 over all trees, or the ``shares`` of the columns in it."""
    walks = _walks(f, spark)
    w = spark.sparkContext.broadcast((walks.features, walks.limits, walks.rates, walks.shares if result == "shares" else None))
    returns = "double" if result == "rate" else "array<double>"

    # nested, so that workers need nothing but numpy and pandas
    @F.pandas_udf(returns)
    def walk(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        features, limits, rates, shares = w.value
        ends = rates if result == "rate" else shares
        for part in parts:
            x = np.array([c.to_numpy() for c in part], dtype=np.float64)
            n = x.shape[1]
            x, rows, total = x.ravel(), np.arange(n), np.zeros((n, *ends.shape[2:]))
            for t in range(len(rates)):
                at = np.zeros(n, dtype=np.int64)
                for feature, limit in zip(features, limits):
                    right = x.take((feature[t] * n).take(at) + rows) > limit[t].take(at)
                    at += at
                    at += right
                total += ends[t].take(at, axis=0)
            total /= max(len(rates), 1)
            yield pd.Series(total if result == "rate" else list(total))

    return walk(*[number(c) for c in MODEL_COLUMNS])


def forest_attribution(rows: DataFrame, f: Fitted, ws: Workspace) -> DataFrame:
    """Add ``contributions``: the changes of the rate along a row's path, by column, mean of all trees."""
    return rows.withColumn("contributions", _walked(f, ws.spark, "shares"))


# --- explanations of a score --------------------------------------------------------------------------
def top_features(rows: DataFrame, k: int = TOP_FEATURES) -> DataFrame:
    """The ``k`` strongest contributions per row, long, with value and direction."""
    named = [
        F.struct(
            F.lit(i).alias("i"), F.lit(c).alias("feature_name"), number(c).alias("value"),
            F.element_at("contributions", i + 1).alias("c"),
        )
        for i, c in enumerate(MODEL_COLUMNS)
    ]
    ranked = F.array_sort(
        F.transform(F.array(*named), lambda s: F.struct((-F.round(F.abs(s["c"]), 9)).alias("neg"), s["i"].alias("i"), s.alias("s")))
    )
    top = F.slice(ranked, 1, k)
    long = rows.select(*PAIR, F.posexplode(top).alias("place", "t"))
    c = F.col("t.s.c")
    return long.select(
        *PAIR,
        (F.col("place") + 1).alias("place"),
        F.col("t.s.feature_name").alias("feature_name"),
        tidy(F.col("t.s.value"), 6).alias("feature_value"),
        tidy(c, 6).alias("contribution"),
        direction(F.round(c, 9)).alias("direction"),
    )


def top_names(rows: DataFrame, k: int = 3) -> DataFrame:
    """Add ``top_feature_names``: the strongest few as an array of names."""
    parts = [
        F.struct((-F.round(F.abs(F.element_at("contributions", i + 1)), 9)).alias("neg"), F.lit(i).alias("i"), F.lit(c).alias("name"))
        for i, c in enumerate(MODEL_COLUMNS)
    ]
    names = F.transform(F.slice(F.array_sort(F.array(*parts)), 1, k), lambda s: s["name"])
    return rows.withColumn("top_feature_names", names)


def importance(spark: SparkSession, values: list[float]) -> DataFrame:
    """Model columns by absolute weight, largest first."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature_name"), F.abs(F.lit(float(v))).alias("importance"), F.lit(i).alias("i"))
          for i, (c, v) in enumerate(zip(MODEL_COLUMNS, values, strict=True))]
    )
    long = spark.range(1).select(F.inline(pairs))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("importance").desc(), "i"))
    return long.withColumn("place", place).drop("i")


def global_importance(f: Fitted, spark: SparkSession) -> DataFrame:
    values = f.model.coefficients if f.name == "logistic_regression" else f.model.featureImportances
    return importance(spark, [float(v) for v in values.toArray()])


# --- cross validation -----------------------------------------------------------------------------------
def cross_validate(
    rows: DataFrame, ws: Workspace, models: list[str] = MODELS, trees: int = TREES, at_once: int = FITS_AT_ONCE
) -> DataFrame:
    """Out-of-fold scores of every model: (model, fold, disease_id, drug_id, label, score).

    Folds whose training part has one class are skipped. Fits are independent jobs; ``at_once``
    of them share the cluster, so that one's small stages fill the gaps of another."""
    by_fold = ws.store("cv_rows", rows.join(folds(rows), "disease_id"))
    counts = by_fold.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect()
    n, p = sum(r["n"] for r in counts), sum(r["p"] for r in counts)
    usable = [r for r in sorted(counts, key=lambda c: c["fold"]) if (p - r["p"]) not in (0, n - r["n"])]
    if not usable:
        raise ValueError("no fold leaves both classes to train on")

    def held_out(job: tuple) -> DataFrame:
        r, name = job
        train, test = by_fold.filter(F.col("fold") != r["fold"]), by_fold.filter(F.col("fold") == r["fold"])
        known = {"n_rows": n - r["n"], "n_positive": p - r["p"]}
        scored = score(test, fit(train, name, trees, known, with_stats=False)).select(
            F.lit(name).alias("model"), "fold", *PAIR, "label", F.col("model_output").alias("score")
        )
        return ws.store(f"cv_{name}_{r['fold']}", scored)

    jobs = [(r, name) for r in usable for name in models]
    with ThreadPool(min(at_once, len(jobs))) as pool:
        parts = pool.map(inheritable_thread_target(rows.sparkSession)(held_out), jobs)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- the trained model, end to end ------------------------------------------------------------------------
def train(rows: DataFrame, ws: Workspace, trees: int = TREES, scores: DataFrame | None = None) -> Fitted:
    """Validate both classifiers on whole diseases, choose one, fit it on all rows. ``scores``
    are out-of-fold scores if they are known. The record tells how it was chosen."""
    counts = guard(rows)
    if scores is None:
        scores = ws.store("cv_scores", cross_validate(rows, ws, trees=trees))
    summary = ws.store("cv_summary", cv_summary(fold_metrics(scores)))
    chosen = select_model(summary).first()["model"]
    fitted = fit(rows, chosen, trees, counts)
    fitted.metadata = {
        **counts,
        "prevalence": counts["n_positive"] / counts["n_rows"],
        "target": "the drug is a known candidate of the disease",
        "selection": "mean average precision, then mean ROC-AUC, then list order",
        "validation": [r.asDict() for r in summary.collect()],
        "folds": CV_FOLDS,
        "seed": SEED,
    }
    return fitted


def predict(rows: DataFrame, f: Fitted, ws: Workspace) -> DataFrame:
    """``rows`` with output, baseline, contributions and strongest columns of a fitted model."""
    if f.name == "logistic_regression":
        explained = linear_attribution(rows, [float(c) for c in f.model.coefficients], f.stats)
    else:
        explained = forest_attribution(rows, f, ws)
    scored = score(explained, f).withColumns(
        {"baseline_output": F.lit(baseline(f, ws)), "model_name": F.lit(f.name)}
    )
    return top_names(scored)


def largest_gradient(rows: DataFrame, f: Fitted) -> float:
    """Largest first derivative of the weighted, regularised loss at the fitted coefficients."""
    s = f.metadata
    scored = _weighted(score(rows, f), s)
    gap = F.col("weight") * (F.col("model_output") - F.col("label"))
    sums = scored.agg(
        F.sum("weight").alias("w"),
        *[F.sum(gap * standardized(i, f.stats)).alias(f"g{i}") for i in range(len(MODEL_COLUMNS))],
    ).first()
    beta = f.model.coefficients
    return max(abs(sums[f"g{i}"] / sums["w"] + float(beta[i]) / s["n_rows"]) for i in range(len(MODEL_COLUMNS)))
