"""The evidence behind ranked pairs as node and edge tables, one graph per disease."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.constants import COMPONENTS, NODE_ORDER, VISIBLE_PER_TYPE
from tessera.functions.texts import fixed
from tessera.operators.candidates import PAIR
from tessera.operators.fusion import GENE_FAMILY, MODEL_FAMILY, PATHWAY_FAMILY, components
from tessera.operators.ordering import first_per_key, top_per_group
from tessera.workspace import Workspace

# fixed values: provenance texts
BRIDGE_TEXT = (
    "HGNC complete set: disease gene ensembl_gene_id -> hgnc_id ; "
    "drug target uniprot -> hgnc_id ; overlap on hgnc_id (Level 4)"
)
DRUG_PATHWAY_SOURCE = "derived:chembl-targets+reactome"
SCORE_TEXT = "Phase 7 evidence fusion (UNCHANGED here)"
RANK_TEXT = "Phase 8 candidate ranking (UNCHANGED here)"
EXPLANATION_TEXT = "Phase 9 AI explanation (narration only, not re-derived here)"


def _id(kind: str, *parts: Column | str) -> Column:
    return F.concat_ws(":", F.lit(kind), *[F.col(p) if isinstance(p, str) else p for p in parts])


def _node(df: DataFrame, section: int, kind: str, node_id: Column, label: Column, meta: Column, place: Column | None = None) -> DataFrame:
    return df.select(
        F.col("disease_id").alias("graph_id"),
        node_id.alias("id"),
        F.lit(kind).alias("type"),
        label.alias("label"),
        F.to_json(meta).alias("metadata"),
        F.col("rank").alias("at_rank"),
        F.lit(section).alias("at_section"),
        (place if place is not None else F.lit(0)).cast("int").alias("at_place"),
    )


def _edge(df: DataFrame, section: int, kind: str, source: Column, target: Column, meta: Column, provenance: Column, place: Column | None = None) -> DataFrame:
    return df.select(
        F.col("disease_id").alias("graph_id"),
        F.concat_ws("->", source, F.lit(kind), target).alias("id"),
        source.alias("source"),
        target.alias("target"),
        F.lit(kind).alias("type"),
        F.to_json(meta).alias("metadata"),
        provenance.alias("provenance"),
        F.col("rank").alias("at_rank"),
        F.lit(section).alias("at_section"),
        (place if place is not None else F.lit(0)).cast("int").alias("at_place"),
    )


def _disease() -> Column:
    return _id("disease", "disease_id")


def _drug() -> Column:
    return _id("drug", "drug_id")


def gene_reasons(matches: DataFrame, ranked: DataFrame) -> DataFrame:
    """Gene-target reasons of the ranked pairs with their place in the reason list."""
    order = [
        F.col("association_score").desc_nulls_last(),
        F.col("disease_gene_name").asc_nulls_last(),
        F.col("disease_gene_id"),
        F.col("drug_target_id"),
    ]
    rows = matches.join(ranked.select(*PAIR, "rank"), PAIR)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*PAIR).orderBy(*order)))


def pathway_reasons(matches: DataFrame, ranked: DataFrame) -> DataFrame:
    order = [F.col("disease_gene_support_count").desc_nulls_last(), F.col("pathway_name"), F.col("reactome_id")]
    rows = matches.join(ranked.select(*PAIR, "rank"), PAIR)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*PAIR).orderBy(*order)))


def nodes(
    ranked: DataFrame, genes: DataFrame, pathways: DataFrame, narratives: DataFrame | None = None
) -> DataFrame:
    """All node sightings; ``first_seen`` keeps one per graph and id."""
    place = F.col("place")
    parts = [
        _node(ranked, 0, "disease", _disease(), F.col("disease_name"), F.struct("disease_id")),
        _node(ranked, 1, "drug", _drug(), F.col("drug_name"), F.struct("drug_id", "generation_methods")),
        _node(
            genes, 2, "disease_gene", _id("disease_gene", "disease_gene_id"),
            F.coalesce("gene_symbol", "hgnc_id"),
            F.struct(
                "disease_gene_id", "hgnc_id", "gene_symbol",
                F.col("disease_gene_ensembl_id").alias("ensembl_id"), F.col("disease_gene_source").alias("source"),
            ),
            place,
        ),
        _node(
            genes, 2, "drug_target", _id("drug_target", "drug_target_id"),
            F.coalesce("drug_target_name", "hgnc_id"),
            F.struct(
                "drug_target_id", "hgnc_id", F.col("drug_target_uniprot_id").alias("uniprot_id"),
                F.col("drug_action_type").alias("action_type"), F.col("drug_target_source").alias("source"),
            ),
            place,
        ),
        _node(
            pathways, 3, "pathway", _id("pathway", "reactome_id"), F.coalesce("pathway_name", "reactome_id"),
            F.struct("reactome_id", "disease_gene_support_count", "drug_supporting_target_count"),
            place,
        ),
    ]
    evidence = components(ranked, ["disease_id", "drug_id", "rank"]).filter("available")
    parts.append(
        _node(
            evidence, 4, "evidence_component", _id("evidence", "drug_id", "component"),
            F.concat("component", F.lit(" evidence")),
            F.struct(
                F.col("component").alias("name"), "value", "configured_weight", "effective_weight",
                "contribution_points", "calculation_method", "provenance", "supporting",
            ),
            F.col("component_order"),
        )
    )
    predicted = ranked.filter("ml_value is not null")
    parts += [
        _node(
            predicted, 5, "prediction", _id("prediction", "drug_id"),
            F.concat(F.coalesce("model_name", F.lit("model")), F.lit(" prediction")),
            F.struct("model_name", "model_output", "baseline_output", "top_feature_names"),
        ),
        _node(
            ranked, 6, "score", _id("score", "drug_id"),
            F.concat(fixed(F.col("repurposing_score"), 1), F.lit("/100")),
            F.struct("repurposing_score", F.lit("0-100").alias("score_scale"), "scoring_version"),
        ),
        _node(
            ranked, 7, "rank", _id("rank", "drug_id"), F.concat(F.lit("Rank #"), "rank"), F.struct("rank")
        ),
    ]
    if narratives is not None:
        told = narratives.select(*PAIR, "rank", "summary", "provider", "limitations")
        parts.append(
            _node(
                told, 8, "explanation", _id("explanation", "drug_id"), F.lit("AI explanation"),
                F.struct("summary", "provider", "limitations"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def edges(
    ranked: DataFrame, genes: DataFrame, pathways: DataFrame, narratives: DataFrame | None = None
) -> DataFrame:
    place = F.col("place")
    gene, target = _id("disease_gene", "disease_gene_id"), _id("drug_target", "drug_target_id")
    pathway = _id("pathway", "reactome_id")
    parts = [
        _edge(
            genes, 2, "associated_with", _disease(), gene,
            F.struct(F.col("disease_gene_id").alias("gene_id"), "gene_symbol"), F.col("disease_gene_source"), place,
        ),
        _edge(genes, 2, "matched_to", gene, target, F.struct("hgnc_id", "gene_symbol"), F.lit(BRIDGE_TEXT), place),
        _edge(
            genes, 2, "has_target", _drug(), target, F.struct(F.col("drug_action_type").alias("action_type")),
            F.col("drug_target_source"), place,
        ),
        _edge(
            pathways, 3, "associated_with", _disease(), pathway,
            F.struct(F.col("disease_gene_support_count").alias("gene_support_count")),
            F.col("disease_pathway_source"), place,
        ),
        _edge(
            pathways, 3, "participates_in", _drug(), pathway,
            F.struct(F.col("drug_supporting_target_count").alias("supporting_target_count")),
            F.lit(DRUG_PATHWAY_SOURCE), place,
        ),
    ]
    evidence = components(ranked, ["disease_id", "drug_id", "rank"]).filter("available")
    family = (
        F.when(F.col("component") == COMPONENTS[0], GENE_FAMILY)
        .when(F.col("component") == COMPONENTS[1], PATHWAY_FAMILY)
        .otherwise(MODEL_FAMILY)
    )
    parts.append(
        _edge(
            evidence, 4, "received", _drug(), _id("evidence", "drug_id", "component"),
            F.struct("contribution_points"), family, F.col("component_order"),
        )
    )
    predicted = ranked.filter("ml_value is not null")
    parts += [
        _edge(predicted, 5, "received", _drug(), _id("prediction", "drug_id"), F.struct("model_output"), F.lit(MODEL_FAMILY)),
        _edge(ranked, 6, "received", _drug(), _id("score", "drug_id"), F.struct("repurposing_score"), F.lit(SCORE_TEXT)),
        _edge(ranked, 7, "ranked", _drug(), _id("rank", "drug_id"), F.struct("rank"), F.lit(RANK_TEXT)),
    ]
    if narratives is not None:
        told = narratives.select(*PAIR, "rank", "provider")
        parts.append(
            _edge(told, 8, "explained_by", _drug(), _id("explanation", "drug_id"), F.struct("provider"), F.lit(EXPLANATION_TEXT))
        )
    return reduce(DataFrame.unionByName, parts)


def first_seen(sightings: DataFrame) -> DataFrame:
    """One row per graph and id: candidates by rank, then section, then reason."""
    return first_per_key(
        sightings, ["graph_id", "id"], [F.col("at_rank"), F.col("at_section"), F.col("at_place")]
    )


# --- metadata and guards --------------------------------------------------------------------
def graph_metadata(node_table: DataFrame, edge_table: DataFrame, ranked: DataFrame) -> DataFrame:
    def counted(df: DataFrame, prefix: str) -> DataFrame:
        per = df.groupBy("graph_id", "type").agg(F.count(F.lit(1)).alias("n"))
        entries = F.array_sort(F.collect_list(F.struct("type", "n")))
        return per.groupBy("graph_id").agg(
            F.sum("n").alias(f"n_{prefix}s"), F.map_from_entries(entries).alias(f"{prefix}_type_counts")
        )

    covered = ranked.groupBy(F.col("disease_id").alias("graph_id")).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        (F.count("ml_value") > 0).alias("includes_ml_evidence"),
    )
    told = node_table.groupBy("graph_id").agg((F.count_if(F.col("type") == "explanation") > 0).alias("includes_explanation"))
    return covered.join(counted(node_table, "node"), "graph_id").join(counted(edge_table, "edge"), "graph_id").join(told, "graph_id")


def unmatched_ranks(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ranked pairs without a candidate; must be empty."""
    return ranked.join(pairs, PAIR, "left_anti").select(*PAIR)


def dangling(edge_table: DataFrame, node_table: DataFrame) -> DataFrame:
    """Edge ends without a node; must be empty."""
    known = node_table.select("graph_id", "id")
    ends = [
        edge_table.select("graph_id", F.col("id").alias("edge_id"), F.col(end).alias("id")).join(
            known, ["graph_id", "id"], "left_anti"
        )
        for end in ("source", "target")
    ]
    return ends[0].unionByName(ends[1])


# --- lookups and views --------------------------------------------------------------------------
def node_degrees(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Edges from, to and touching every node."""
    ends = edge_table.select("graph_id", F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edge_table.select("graph_id", F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    sums = ends.groupBy("graph_id", "id").agg(F.sum("o").alias("n_from"), F.sum("i").alias("n_to"))
    out = node_table.select("graph_id", "id", "type").join(sums, ["graph_id", "id"], "left").fillna(0, ["n_from", "n_to"])
    return out.withColumn("n_touching", F.col("n_from") + F.col("n_to"))


def edges_touching(edge_table: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen(graph_id, id)`` -> its edges with their direction."""
    parts = []
    for end, way in (("source", "from"), ("target", "to")):
        seeds = chosen.select("graph_id", F.col("id").alias(end))
        hit = edge_table.join(seeds, ["graph_id", end])
        parts.append(hit.select("graph_id", F.col(end).alias("node_id"), F.lit(way).alias("way"), F.col("id").alias("edge_id"), "type"))
    return parts[0].unionByName(parts[1])


def _meta(field: str, c: str = "metadata") -> Column:
    return F.get_json_object(c, f"$.{field}")


def target_joins(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Gene-to-target joins, one per matched_to edge, with both ends' details."""

    def end(name: str) -> DataFrame:
        return node_table.select(
            "graph_id", F.col("id").alias(name), F.col("label").alias(f"_{name}_label"), F.col("metadata").alias(f"_{name}_meta")
        )

    e = edge_table.filter("type = 'matched_to'").select("graph_id", "source", "target", "metadata", "provenance")
    e = e.join(end("source"), ["graph_id", "source"], "left").join(end("target"), ["graph_id", "target"], "left")
    return e.select(
        "graph_id",
        F.col("source").alias("gene_node_id"),
        F.coalesce("_source_label", "source").alias("gene_symbol"),
        _meta("disease_gene_id", "_source_meta").alias("gene_id"),
        _meta("ensembl_id", "_source_meta").alias("ensembl_id"),
        _meta("source", "_source_meta").alias("gene_source"),
        F.col("target").alias("target_node_id"),
        F.coalesce("_target_label", "target").alias("target_name"),
        _meta("drug_target_id", "_target_meta").alias("target_id"),
        _meta("uniprot_id", "_target_meta").alias("uniprot_id"),
        _meta("action_type", "_target_meta").alias("action_type"),
        F.coalesce(_meta("hgnc_id"), _meta("hgnc_id", "_source_meta")).alias("hgnc_id"),
        "provenance",
    )


def shared_pathways(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    given = (
        edge_table.filter("type = 'participates_in'")
        .groupBy("graph_id", F.col("target").alias("id"))
        .agg(F.sort_array(F.collect_set("provenance")).alias("provenances"))
    )
    rows = node_table.filter("type = 'pathway'").join(given, ["graph_id", "id"], "left")
    return rows.select(
        "graph_id",
        F.col("id").alias("node_id"),
        F.col("label").alias("name"),
        F.coalesce(_meta("reactome_id"), F.regexp_replace("id", "^pathway:", "")).alias("reactome_id"),
        F.coalesce("provenances", F.array().cast("array<string>")).alias("provenances"),
    )


def reach(edge_table: DataFrame, seeds: DataFrame, ws: Workspace, name: str = "reach") -> tuple[DataFrame, DataFrame]:
    """All ancestors and descendants of every seed and the edges walked.

    ``seeds(graph_id, id)``. Each round joins the frontier with the edges and keeps
    only nodes not met before; the round is written, which cuts the lineage and
    lets the loop stop when a round finds nothing."""
    steps = [
        ("descendant", edge_table.select("graph_id", F.col("id").alias("edge_id"), F.col("source").alias("id"), F.col("target").alias("next"))),
        ("ancestor", edge_table.select("graph_id", F.col("id").alias("edge_id"), F.col("target").alias("id"), F.col("source").alias("next"))),
    ]
    links = reduce(DataFrame.unionByName, [df.withColumn("way", F.lit(way)) for way, df in steps])
    start = seeds.select("graph_id", F.col("id").alias("seed"), "id").withColumn("way", F.explode(F.array(F.lit("descendant"), F.lit("ancestor"))))
    key = ["graph_id", "seed", "way", "id"]
    frontier, seen, walked = start, start.select(*key), None
    for step in itertools.count():
        moves = frontier.join(links, ["graph_id", "way", "id"]).select("graph_id", "seed", "way", "edge_id", F.col("next").alias("id"))
        moves = ws.store(f"{name}_{step}", moves)
        if moves.isEmpty():
            break
        walked = moves if walked is None else walked.unionByName(moves)
        frontier = ws.store(f"{name}_new_{step}", moves.select(*key).distinct().join(seen, key, "left_anti"))
        seen = seen.unionByName(frontier)
    nodes_out = seen.filter("id <> seed").distinct()
    empty = frontier.select("graph_id", "seed", "way", F.lit("").alias("edge_id")).limit(0)
    edges_out = (walked.select("graph_id", "seed", "way", "edge_id").distinct()) if walked is not None else empty
    return nodes_out, edges_out


# --- reading order -----------------------------------------------------------------------------------
def _order(c: str = "type") -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in NODE_ORDER]), F.col(c)).cast("int")


def trace_columns(node_table: DataFrame) -> DataFrame:
    """Types present per graph, numbered in reading order."""
    present = node_table.select("graph_id", "type").distinct().withColumn("o", _order())
    step = F.row_number().over(Window.partitionBy("graph_id").orderBy("o"))
    return present.withColumn("step", step).drop("o")


def trace_steps(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Cumulative counts per step: nodes of the first k types, edges among them.

    A node enters at its type's step and an edge at the later step of its ends, so
    one running count per graph replaces one subgraph per step."""
    steps = trace_columns(node_table)
    entered = node_table.join(steps, ["graph_id", "type"]).select("graph_id", "id", "step")
    ends = edge_table.join(entered.withColumnsRenamed({"id": "source", "step": "s1"}), ["graph_id", "source"]).join(
        entered.withColumnsRenamed({"id": "target", "step": "s2"}), ["graph_id", "target"]
    )
    n_nodes = entered.groupBy("graph_id", "step").agg(F.count(F.lit(1)).alias("nn"))
    n_edges = ends.groupBy("graph_id", F.greatest("s1", "s2").alias("step")).agg(F.count(F.lit(1)).alias("ne"))
    upto = Window.partitionBy("graph_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.join(n_nodes, ["graph_id", "step"], "left").join(n_edges, ["graph_id", "step"], "left").fillna(0, ["nn", "ne"])
    return rows.select(
        "graph_id", "step", "type", F.sum("nn").over(upto).alias("n_nodes"), F.sum("ne").over(upto).alias("n_edges")
    )


def step_subgraph(node_table: DataFrame, edge_table: DataFrame, steps: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of the first ``steps`` types and the edges inside."""
    active = trace_columns(node_table).filter(F.col("step") <= steps)
    kept = node_table.join(active, ["graph_id", "type"], "left_semi")
    return kept, induced(edge_table, kept)


def induced(edge_table: DataFrame, kept: DataFrame) -> DataFrame:
    ids = kept.select("graph_id", "id")
    return edge_table.join(ids.withColumnRenamed("id", "source"), ["graph_id", "source"], "left_semi").join(
        ids.withColumnRenamed("id", "target"), ["graph_id", "target"], "left_semi"
    )


def relevance() -> Column:
    fields = ["contribution_points", "drug_supporting_target_count", "disease_gene_support_count", "value"]
    return F.coalesce(*[_meta(f).cast("double") for f in fields], F.lit(0.0))


def visible_nodes(node_table: DataFrame, k: int = VISIBLE_PER_TYPE) -> DataFrame:
    """The ``k`` most relevant nodes per type; ties keep first-seen order."""
    order = [F.col("relevance").desc(), F.col("at_rank"), F.col("at_section"), F.col("at_place"), F.col("id")]
    return top_per_group(node_table.withColumn("relevance", relevance()), ["graph_id", "type"], order, k, out="row")


def overflow(node_table: DataFrame, k: int = VISIBLE_PER_TYPE) -> DataFrame:
    n = node_table.groupBy("graph_id", "type").agg(F.count(F.lit(1)).alias("n_nodes"))
    return n.withColumn("overflow_count", F.greatest(F.col("n_nodes") - k, F.lit(0)))
