"""All stage tables over one data folder, each built on first use.

A table that later stages read more than once is written to the workspace;
everything else stays a lazy plan for Catalyst to prune and fuse.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.constants import MODEL_COLUMNS, TREES
from tessera.operators import (
    build,
    candidates,
    features,
    fusion,
    graph,
    guards,
    model,
    narrative,
    ranking,
    registry,
    resolve,
)
from tessera.operators.candidates import Bridge
from tessera.operators.conform import ledger
from tessera.plans import report
from tessera.sources import files
from tessera.sources.given import GivenTables
from tessera.workspace import Workspace

_OPEN: dict[tuple[str, str], "Study"] = {}


def study(spark: SparkSession, folder: str) -> "Study":
    """The study of a folder in this application; stage tables are shared by its queries. It
    ranks the stand-in's scores, which SQL can follow; ``with_model("learned")`` ranks the
    scores of the model that validation chose, over the same tables."""
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _OPEN:
        _OPEN[key] = Study(spark, folder, model_kind="stand_in")
    return _OPEN[key]


class Tables(Mapping[str, DataFrame]):
    """The six tables by name; asking for one builds it and what it needs."""

    _BUILT = {
        "drugs": "built_drugs",
        "diseases": "built_diseases",
        "drug_targets": "built_drug_targets",
        "drug_side_effects": "built_side_effects",
        "disease_genes": "built_genes",
        "disease_pathways": "built_pathways",
    }

    def __init__(self, owner: "Study") -> None:
        self._owner = owner

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self._owner, self._BUILT[name]).table

    def __iter__(self) -> Iterator[str]:
        return iter(self._BUILT)

    def __len__(self) -> int:
        return len(self._BUILT)


class Study:
    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        ws: Workspace | None = None,
        top_n: int = 10,
        graph_top_n: int = 5,
        genes_per_disease: int | None = None,
        trees: int = TREES,
        model_kind: str = "learned",
    ) -> None:
        """``top_n`` candidates per disease are published, ``graph_top_n`` of them as graphs;
        ``genes_per_disease`` keeps only the strongest associations of a disease. ``model_kind``
        says whose scores are fused: those of the chosen model, or of the ``stand_in``."""
        if model_kind not in MODEL_KINDS:
            raise ValueError(f"model_kind must be one of {MODEL_KINDS}, got {model_kind!r}")
        self.model_kind = model_kind
        self.spark, self.trees = spark, trees
        self.top_n, self.graph_top_n, self.genes_per_disease = top_n, graph_top_n, genes_per_disease
        self.raw = GivenTables(spark, folder)
        tag = hashlib.sha1(self.raw.folder.encode()).hexdigest()[:8]
        self.ws = ws or Workspace(spark, f"{spark.sparkContext.applicationId}-{tag}")

    # --- the six tables -----------------------------------------------------------
    @cached_property
    def built_drugs(self) -> build.Built:
        return self._keep(
            "drugs", build.build_drugs(self.raw["raw_drug_names"], self.raw["raw_chembl_map"], self.ws)
        )

    @cached_property
    def built_side_effects(self) -> build.Built:
        b = build.build_drug_side_effects(
            self.raw["raw_side_effects"], self.built_drugs.registry, self.ws
        )
        return self._keep("drug_side_effects", b)

    @cached_property
    def built_diseases(self) -> build.Built:
        b = build.build_diseases(self.raw["raw_diseases"], self.ws, self.raw["raw_seeds"])
        return self._keep("diseases", b)

    @cached_property
    def landed_genes(self) -> DataFrame:
        """The associations are sums over three tables; worked out once."""
        return self.ws.store("landed_genes", self.raw["raw_disease_genes"])

    @cached_property
    def built_genes(self) -> build.Built:
        b = build.build_disease_genes(
            self.landed_genes, self.built_diseases.registry, self.ws, self.genes_per_disease
        )
        return self._keep("disease_genes", b)

    @cached_property
    def built_targets(self) -> build.Built:
        return self._keep("targets", build.target_dimension(self.raw["raw_targets"], self.ws))

    @cached_property
    def built_drug_targets(self) -> build.Built:
        claims = build.first_drug_per_chembl(
            self.raw["raw_drug_names"], self.raw["raw_chembl_map"], self.built_drugs.registry
        )
        b = build.build_drug_targets(self.raw["raw_mechanisms"], claims, self.built_targets.table, self.ws)
        return self._keep("drug_targets", b)

    @cached_property
    def gene_pathways(self) -> DataFrame:
        return build.gene_pathway_edges(self.raw["raw_gene_pathways"])

    @cached_property
    def support(self) -> DataFrame:
        genes = self.built_genes.table
        edges = build.gene_pathway_edges(self.raw["raw_gene_pathways"], genes)
        support = build.accounted(build.pathway_support(genes, edges), self.support_counts)
        return self.ws.store("pathway_support", support)

    @cached_property
    def support_counts(self) -> Observation:
        return Observation()

    @cached_property
    def built_pathways(self) -> build.Built:
        names = build.pathway_names(self.raw["raw_pathway_names"])
        return self._keep("disease_pathways", build.build_disease_pathways(self.support, names, self.ws))

    def _keep(self, name: str, b: build.Built) -> build.Built:
        return build.keep(b, name, self.ws)

    @cached_property
    def tables(self) -> "Tables":
        return Tables(self)

    @property
    def built(self) -> list[build.Built]:
        return [
            self.built_drugs, self.built_side_effects, self.built_diseases,
            self.built_genes, self.built_targets, self.built_drug_targets, self.built_pathways,
        ]

    @cached_property
    def registries(self) -> dict[str, DataFrame]:
        return {entity: b.registry for entity, b in self._minted.items()}

    @cached_property
    def identifiers(self) -> DataFrame:
        seen = [o for b in self.built for o in b.observations]
        return self.ws.store("identifiers", registry.crosswalk(seen))

    @cached_property
    def run_report(self) -> report.RunReport:
        """What the builds read, wrote and lost; the counts came with the writes."""
        built = {name: getattr(self, Tables._BUILT[name]) for name in self.tables}
        seeds = build.unresolved_seeds(self.raw["raw_seeds"], self.raw["raw_diseases"])
        stages = report.build_stages(files.coverage(list(report.LICENCES)), built, self.support_counts)
        made = {e: b.ids for e, b in self._minted.items()}
        return report.RunReport(self.spark, stages, built, made, self.ledger, seeds)

    @property
    def _minted(self) -> dict[str, build.Built]:
        return {
            "drug": self.built_drugs,
            "side_effect": self.built_side_effects,
            "disease": self.built_diseases,
            "gene": self.built_genes,
            "target": self.built_targets,
            "pathway": self.built_pathways,
        }

    @cached_property
    def rejections(self) -> list[DataFrame]:
        return [r for b in self.built for r in b.rejected]

    @cached_property
    def ledger(self) -> DataFrame:
        return ledger(self.rejections, self.ws)

    # --- links ---------------------------------------------------------------------
    @cached_property
    def bridge(self) -> Bridge:
        b = candidates.bridge(self.raw["raw_gene_bridge"])
        return Bridge(
            self.ws.store("bridge_genes", b.genes),
            self.ws.store("bridge_proteins", b.proteins),
            self.ws.store("bridge_symbols", b.symbols),
        )

    @cached_property
    def bridged_genes(self) -> DataFrame:
        t = candidates.bridged_genes(self.tables["disease_genes"], self.bridge)
        return self.ws.store("bridged_genes", t)

    @cached_property
    def bridged_targets(self) -> DataFrame:
        t = candidates.bridged_targets(self.tables["drug_targets"], self.bridge)
        return self.ws.store("bridged_targets", t)

    @cached_property
    def protein_pathways(self) -> DataFrame:
        return self.ws.store("protein_pathways", candidates.protein_pathways(self.raw["raw_gene_pathways"], self.tables["drug_targets"]))

    @cached_property
    def drug_protein_pathways(self) -> candidates.DrugFacts:
        """Not unfolded: a fact for each pathway of each protein of a drug."""
        return candidates.DrugFacts(self.tables["drug_targets"], self.protein_pathways, self.ws)

    @cached_property
    def drug_pathways(self) -> DataFrame:
        return self.ws.store("drug_pathways", self.drug_protein_pathways.drug_pathways())

    @cached_property
    def gene_matches(self) -> DataFrame:
        """Not written, like the pathway matches: a row for each gene row and target row of a pair."""
        return candidates.gene_target_matches(self.bridged_genes, self.bridged_targets)

    @cached_property
    def pathway_matches(self) -> DataFrame:
        """Not written: the join is cheap to redo and can be far larger than its inputs."""
        return candidates.pathway_matches(self.tables["disease_pathways"], self.drug_pathways)

    @cached_property
    def pairs(self) -> DataFrame:
        t = candidates.candidate_pairs(
            candidates.gene_pair_counts_of(self.bridged_genes, self.bridged_targets, self.ws),
            candidates.pathway_pair_counts(self.pathway_matches),
        )
        return self.ws.store("pairs", t)

    # --- features and scores --------------------------------------------------------
    @cached_property
    def disease_dim(self) -> DataFrame:
        """Written, so that its measured size decides whether the pairs must move for it."""
        t = self.tables
        d = features.disease_dimension(
            t["diseases"], t["disease_genes"], self.bridged_genes, t["disease_pathways"]
        )
        return self.ws.store("disease_dim", d)

    @cached_property
    def drug_dim(self) -> DataFrame:
        t = self.tables
        d = features.drug_dimension(
            t["drugs"], t["drug_side_effects"], t["drug_targets"], self.bridged_targets, self.drug_pathways
        )
        return self.ws.store("drug_dim", d)

    @cached_property
    def features(self) -> DataFrame:
        return self.ws.store("features", features.features(self.pairs, self.disease_dim, self.drug_dim))

    @cached_property
    def fused_without_model(self) -> DataFrame:
        return fusion.fuse(self.features)

    # --- model ------------------------------------------------------------------------
    @cached_property
    def training(self) -> DataFrame:
        rows = model.labelled(self.features, self.tables["diseases"], self.raw["raw_known_pairs"])
        return self.ws.store("training", rows)

    @cached_property
    def stats(self) -> model.Stats:
        return model.Stats.of(self.training)

    def linear(self, shift: int = 7) -> DataFrame:
        """Scores of a linear model whose coefficients follow a rule; stands in for a
        stored model wherever results must be comparable with SQL."""
        name = f"linear_{shift}"
        if name not in self._linear:
            rows = model.linear_score(self.features, rule_coefficients(shift), RULE_INTERCEPT, self.stats)
            self._linear[name] = self.ws.store(name, model.top_names(rows))
        return self._linear[name]

    @cached_property
    def _linear(self) -> dict[str, DataFrame]:
        return {}

    def with_model(self, kind: str) -> "Study":
        """This study with the scores of another model: everything up to the features is shared,
        what follows from the scores is built anew."""
        if kind == self.model_kind:
            return self
        if kind not in self._others:
            other = Study(
                self.spark, self.raw.folder, self.ws, self.top_n, self.graph_top_n, self.genes_per_disease, self.trees, kind
            )
            # built once, for both
            self.features  # noqa: B018
            if kind == "learned":
                self.learned_predictions  # noqa: B018
            shared = {k: v for k, v in self.__dict__.items() if k not in AFTER_SCORES and k not in other.__dict__}
            other.__dict__.update(shared, _others={self.model_kind: self})
            self._others[kind] = other
        return self._others[kind]

    @cached_property
    def _others(self) -> dict[str, "Study"]:
        return {}

    @cached_property
    def predictions(self) -> DataFrame:
        """Predictions of the study's model for all pairs."""
        if self.model_kind == "learned":
            return self.learned_predictions.drop("contributions")
        return self.linear().select(
            "disease_id", "drug_id", "model_output", "baseline_output",
            F.lit("logistic_regression").alias("model_name"), "top_feature_names",
        )

    @cached_property
    def rule_scores(self) -> DataFrame:
        """Two rule models scored on the training rows with their held-out fold."""
        folds = model.folds(self.training)
        rows = self.training.select("disease_id", "drug_id", "label").join(folds, "disease_id")
        parts = [
            rows.join(
                self.linear(k).select("disease_id", "drug_id", F.col("model_output").alias("score")),
                ["disease_id", "drug_id"],
            ).withColumn("model", F.lit(f"linear_{k}"))
            for k in RULE_SHIFTS
        ]
        return parts[0].unionByName(parts[1])

    @cached_property
    def cv_scores(self) -> DataFrame:
        return self.ws.store("cv_all", model.cross_validate(self.training, self.ws, trees=self.trees))

    @cached_property
    def forest(self) -> model.Fitted:
        return model.fit(self.training, "random_forest")

    @cached_property
    def logistic(self) -> model.Fitted:
        return model.fit(self.training, "logistic_regression")

    @cached_property
    def learned(self) -> model.Fitted:
        """The classifier that validation chose, fitted on all training rows."""
        return model.train(self.training, self.ws, self.trees, self.cv_scores)

    @cached_property
    def stored_model(self) -> str:
        """Where the chosen model lies with its record."""
        path = self.ws.path("model_record")
        model.save(self.learned, path, self.spark)
        return path

    @cached_property
    def learned_predictions(self) -> DataFrame:
        rows = model.predict(self.features, self.learned, self.ws)
        return self.ws.store(
            "learned",
            rows.select(
                *model.PAIR, "model_output", "baseline_output", "model_name", "top_feature_names", "contributions"
            ),
        )

    # --- scores, ranks, narratives, graphs -----------------------------------------------
    @cached_property
    def fused(self) -> DataFrame:
        """A plan, not a table: one join of two written tables, and ranking writes its rows anyway."""
        return fusion.fuse(self.features, self.predictions)

    @cached_property
    def ranked(self) -> DataFrame:
        """Ranking writes the rows in rank order; the rank itself is a small join on top."""
        return ranking.rank(self.fused, self.ws)

    @cached_property
    def rollups(self) -> DataFrame:
        return candidates.rollups(self.gene_matches, self.pathway_matches)

    @cached_property
    def top(self) -> DataFrame:
        """The published pairs: the top of each disease with their matched ids. They need no full ranking."""
        ids = candidates.rollups(*self._top_matches)
        return self.ws.store("top", narrative.with_rollups(self.best, ids))

    @cached_property
    def best(self) -> DataFrame:
        return self.ws.store("best", ranking.top_n(self.fused, self.top_n))

    @cached_property
    def _top_matches(self) -> tuple[DataFrame, DataFrame]:
        """Gene and pathway matches of the published pairs, for their ids and for their graphs."""
        only = self.best.select("disease_id", "drug_id")
        genes = candidates.gene_matches_of(only, self.bridged_genes, self.bridged_targets, self.ws)
        paths = candidates.pathway_matches_of(only, self.tables["disease_pathways"], self.drug_pathways)
        return self.ws.store("top_genes", genes), self.ws.store("top_pathways", paths)

    @cached_property
    def narratives(self) -> DataFrame:
        return self.ws.store("narratives", narrative.narratives(self.top))

    @cached_property
    def _graph_inputs(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        best = self.top.filter(F.col("rank") <= self.graph_top_n)
        of_genes, of_pathways = self._top_matches  # joined to the pairs of the graphs, some of the published ones
        genes = self.ws.store("graph_genes", graph.gene_reasons(of_genes, best))
        paths = self.ws.store("graph_pathways", graph.pathway_reasons(of_pathways, best))
        return best, genes, paths, self.narratives.filter(F.col("rank") <= self.graph_top_n)

    @cached_property
    def nodes(self) -> DataFrame:
        return self.ws.store("nodes", graph.first_seen(graph.nodes(*self._graph_inputs)))

    @cached_property
    def edges(self) -> DataFrame:
        edges = graph.first_seen(graph.edges(*self._graph_inputs))
        return self.ws.store("edges", guards.attached(edges, self.nodes))

    # --- resolution -------------------------------------------------------------------------
    @cached_property
    def aliases(self) -> DataFrame:
        return resolve.read_aliases(self.raw["raw_aliases"])

    @cached_property
    def disease_keys(self) -> DataFrame:
        keys = resolve.disease_keys(self.tables["diseases"], self.identifiers, self.aliases)
        return self.ws.store("disease_keys", keys)

    @cached_property
    def drug_keys(self) -> DataFrame:
        return self.ws.store("drug_keys", resolve.drug_keys(self.tables["drugs"], self.identifiers))

    @cached_property
    def resolved_diseases(self) -> DataFrame:
        q = self.raw["raw_disease_queries"]
        return self.ws.store("resolved_diseases", resolve.resolve_diseases(q, self.disease_keys, self.tables["diseases"]))

    @cached_property
    def resolved_drugs(self) -> DataFrame:
        q = self.raw["raw_drug_queries"]
        return self.ws.store("resolved_drugs", resolve.resolve_drugs(q, self.drug_keys, self.tables["drugs"]))


MODEL_KINDS = ("learned", "stand_in")
#: What depends on whose scores are fused.
AFTER_SCORES = {
    "model_kind", "_others", "predictions", "fused", "ranked", "best", "_top_matches", "top", "narratives", "_graph_inputs", "nodes", "edges",
}

# fixed values: the rule models
RULE_SHIFTS = [7, 5]
RULE_INTERCEPT = -1.0


def rule_coefficients(shift: int) -> list[float]:
    return [((i * shift) % 13 - 6) / 10 for i in range(len(MODEL_COLUMNS))]
