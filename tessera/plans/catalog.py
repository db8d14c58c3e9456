"""Every query by name: ``name -> f(spark, folder) -> DataFrame``.

Names follow the inventory ids. A query returns flat columns so that its rows
can be compared with an SQL twin.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.constants import COMPONENTS, DEAD_BAND, MODEL_COLUMNS, TABLES
from tessera.functions import ids, numbers, texts
from tessera.operators import (
    build,
    candidates,
    conform,
    features,
    fusion,
    graph,
    model,
    narrative,
    profiles,
    quality,
    ranking,
    registry,
    resolve,
)
from tessera.plans import ingest, reports
from tessera.plans.landing import Landing
from tessera.plans.study import Study, rule_coefficients, study
from tessera.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
    """Register a function of a study under its own name."""
    QUERIES[f.__name__] = lambda spark, folder: f(study(spark, folder))
    return f


def _landing(s: Study) -> Landing:
    if not hasattr(s, "_landing"):
        s._landing = Landing(s)
    return s._landing


def _joined(c: str) -> "F.Column":
    return F.array_join(c, "|").alias(c)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- scans, sources, sinks ---------------------------------------------------------------
@query
def s1_drug_names(s: Study) -> DataFrame:
    return files.read_drug_names(s.spark, _landing(s).path("drug_names")).drop("seq")


@query
def s2_preferred_side_effects(s: Study) -> DataFrame:
    raw = files.read_side_effects(s.spark, _landing(s).path("side_effects"))
    return build.preferred_terms(raw).drop("seq")


@query
def s3_pathway_names(s: Study) -> DataFrame:
    return files.read_pathway_names(s.spark, _landing(s).path("pathway_names")).drop("seq")


@query
def s4_gene_pathways(s: Study) -> DataFrame:
    return files.read_gene_pathways(s.spark, _landing(s).path("gene_pathways"))


@query
def s5_protein_pathways(s: Study) -> DataFrame:
    return files.read_protein_pathways(s.spark, _landing(s).path("protein_pathways"))


@query
def s6_gene_bridge(s: Study) -> DataFrame:
    b = candidates.bridge(files.read_gene_bridge(s.spark, _landing(s).path("gene_bridge")))
    parts = [(b.genes, "ensembl_id", "hgnc_id"), (b.proteins, "uniprot_id", "hgnc_id"), (b.symbols, "hgnc_id", "symbol")]
    return _union([d.select(F.lit(k).alias("kind"), F.col(k).alias("key"), F.col(v).alias("value")) for d, k, v in parts])


@query
def s7_mechanisms(s: Study) -> DataFrame:
    return files.read_mechanisms(s.spark, _landing(s).path("mechanisms"), multiline=False).drop("seq")


@query
def s8_targets(s: Study) -> DataFrame:
    return files.read_targets(s.spark, _landing(s).path("targets"), multiline=False).drop("seq")


@query
def s9_compound_map(s: Study) -> DataFrame:
    return files.read_compound_map(s.spark, _landing(s).path("compound_map")).drop("seq")


@query
def s9_first_synonym(s: Study) -> DataFrame:
    n = F.col("s_suppkey")
    syn = F.array_compact(
        F.array(
            F.col("s_name"),
            F.concat(F.lit("chembl"), n),
            F.when(n % 4 != 0, F.concat(F.lit("CHEMBL"), n)),
            F.concat(F.lit("CHEMBL9"), n),
        )
    )
    syn = F.when(n % 5 == 0, F.slice(syn, 1, 2)).otherwise(syn)
    return files.first_chembl_synonym(s.raw["supplier"].select(n.alias("cid"), syn.alias("synonyms")))


def _payloads(s: Study) -> DataFrame:
    return files.read_disease_payloads(s.spark, _landing(s).path("diseases"), multiline=False)


@query
def s10_diseases(s: Study) -> DataFrame:
    return files.payload_diseases(_payloads(s)).drop("seq")


@query
def s11_disease_genes(s: Study) -> DataFrame:
    return files.payload_genes(_payloads(s)).drop("seq")


@query
def s12_unresolved_seeds(s: Study) -> DataFrame:
    seeds = files.read_seeds(s.spark, _landing(s).path("seeds")).drop("seq")
    return build.unresolved_seeds(seeds, files.payload_diseases(_payloads(s)))


@query
def s13_seeds(s: Study) -> DataFrame:
    return files.read_seeds(s.spark, _landing(s).path("seeds")).drop("seq")


@query
def s14_aliases(s: Study) -> DataFrame:
    return files.alias_map(files.read_alias_lines(s.spark, _landing(s).path("aliases")))


@query
def s15_known_drugs(s: Study) -> DataFrame:
    return files.read_known_drugs(s.spark, _landing(s).path("known_drugs"), multiline=False)


def _stored(s: Study) -> str:
    if not hasattr(s, "_stored_at"):
        root = s.ws.path("processed")
        files.write_tables({**s.tables, files.CROSSWALK: s.identifiers}, root)
        s._stored_at = root
    return s._stored_at


@query
def s16_load_tables(s: Study) -> DataFrame:
    root = _stored(s)
    return quality.row_counts({n: files.load_table(s.spark, root, n) for n in files.available_tables(s.spark, root)})


@query
def s17_csv_copies(s: Study) -> DataFrame:
    root = _stored(s)
    return quality.row_counts({n: s.spark.read.csv(f"{root}/{n}.csv", header=True) for n in [*TABLES, files.CROSSWALK]})


@query
def s18_run_report(s: Study) -> DataFrame:
    root = s.ws.path("report")
    files.write_report({"checks": quality.quality_checks(s.tables), "counts": quality.row_counts(s.tables)}, root)
    kinds = "check_name string, severity string, passed boolean, detail string"
    return s.spark.read.schema(kinds).json(f"{root}/_reports/checks")


def _reported(s: Study, part: str) -> DataFrame:
    """A part of the run report, written as JSON and read back."""
    parts = {"stages": s.run_report.stages(), "counts": s.run_report.counts()}
    root = s.ws.path("report")
    files.write_report(parts, root)
    return s.spark.read.schema(parts[part].schema).json(f"{root}/_reports/{part}")


@query
def s18_stages(s: Study) -> DataFrame:
    """What every build read, wrote and refused, with its note."""
    return _reported(s, "stages")


@query
def s18_counts(s: Study) -> DataFrame:
    """Rows of every dataset and ids of every entity, as counted when they were written."""
    return _reported(s, "counts")


@query
def s19_coverage(s: Study) -> DataFrame:
    """What builds when one source is missing, weighed by the rows the others hold."""
    n = {t: s.tables[t] for t in TABLES}
    counts = quality.row_counts(n)
    parts = []
    for absent in ("none", "sider", "chembl", "opentargets", "reactome"):
        plan = files.coverage([x for x in ingest.REQUIRED if x != absent])
        parts.append(
            s.spark.createDataFrame(plan, "table_name string, built boolean, note string").withColumn("absent", F.lit(absent))
        )
    rows = _union(parts).join(counts, "table_name")
    return rows.withColumn("n_rows", F.when(F.col("built"), F.col("n_rows")).otherwise(0))


# --- scalar rules as table jobs --------------------------------------------------------------
def _all_texts(s: Study) -> DataFrame:
    d = s.raw["documents"].select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("doc_id").alias("n"), "text")
    c = s.raw["conversations"].select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"), F.col("conv_id").alias("n"), "text"
    )
    return d.unionByName(c)


@query
def f1_name_keys(s: Study) -> DataFrame:
    key = ids.name_key(F.col("text"))
    return _all_texts(s).select("id", F.length(key).alias("n_chars"), F.md5(key).alias("key_md5"))


@query
def f2_compound_ids(s: Study) -> DataFrame:
    raw = s.raw["raw_drug_names"].select(F.col("stitch_id").alias("value"))
    raw = raw.union(s.raw["raw_chembl_map"].select(F.concat(F.lit(" 00"), "pubchem_cid")))
    return ids.normalize_ids(raw, {"value": "compound"})


@query
def f3_ontology_ids(s: Study) -> DataFrame:
    raw = s.raw["raw_diseases"].select(F.concat(F.lit(" "), "ontology_id", F.lit("\t")).alias("value"))
    raw = raw.union(s.raw["raw_aliases"].select("ontology_id")).union(s.raw["raw_disease_queries"].select("query"))
    return ids.normalize_ids(raw, {"value": "ontology"})


@query
def f4_gene_ids(s: Study) -> DataFrame:
    return ids.normalize_ids(
        s.raw["raw_disease_genes"].select(
            "ontology_id",
            F.when(F.col("gene_symbol").endswith("4"), F.col("gene_symbol")).otherwise(F.col("ensembl_id")).alias("gene"),
        ),
        {"gene": "gene"},
    )


@query
def f5_prefixed_ids(s: Study) -> DataFrame:
    t = s.raw["raw_targets"].select(
        F.lower("target_chembl_id").alias("a"),
        F.when(F.col("seq") % 3 == 0, F.concat(F.lit(" r-hsa-"), "seq")).otherwise(F.col("target_name")).alias("b"),
    )
    return ids.normalize_ids(t, {"a": "chembl", "b": "reactome"})


@query
def f6_concept_ids(s: Study) -> DataFrame:
    raw = s.raw["raw_side_effects"].select(
        F.when(F.col("seq") % 11 == 0, F.substring("umls_label", 1, 6)).otherwise(F.col("umls_meddra")).alias("value")
    )
    keyed = ids.normalize_ids(raw, {"value": "concept"})
    return keyed.groupBy("value", "value_key", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query
def f7_protein_ids(s: Study) -> DataFrame:
    n = F.col("seq")
    shape = (
        F.when(n % 4 == 0, F.concat(F.lit("a"), n % 10, F.lit("bc1"), n % 10))
        .when(n % 4 == 1, F.concat(F.lit("B"), n % 10, F.lit("XY1"), n % 10, F.lit("Z2"), n % 10))
        .when(n % 4 == 2, F.concat(F.lit("x"), F.col("uniprot_id")))
        .otherwise(F.col("uniprot_id"))
    )
    return ids.normalize_ids(s.raw["raw_targets"].select("seq", shape.alias("value")), {"value": "protein"})


@query
def f8_query_text(s: Study) -> DataFrame:
    q = s.raw["raw_disease_queries"].select(F.lit("disease").alias("what"), "query_id", "query")
    q = q.union(s.raw["raw_drug_queries"].select(F.lit("drug"), "query_id", "query"))
    return q.withColumn("normalized", ids.query_text(F.col("query")))


@query
def f9_query_kinds(s: Study) -> DataFrame:
    c = F.col("query")
    q = s.raw["raw_disease_queries"].select(
        F.lit("disease").alias("what"), "query_id", ids.disease_query_kind(c).alias("kind"),
        F.lit(None).cast("string").alias("cid"), F.lit(None).cast("string").alias("chembl"),
    )
    d = s.raw["raw_drug_queries"].select(
        F.lit("drug").alias("what"), "query_id", ids.drug_query_kind(c).alias("kind"),
        ids.cid_in_query(c).alias("cid"), ids.chembl_in_query(c).alias("chembl"),
    )
    return q.unionByName(d)


@query
def f10_clean_missing(s: Study) -> DataFrame:
    n = F.col("c_custkey")
    dirty = s.raw["customer"].select(
        "c_custkey",
        F.when(n % 7 == 0, float("nan")).otherwise(F.col("c_acctbal")).alias("balance"),
        F.when(n % 5 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("\n "), "c_mktsegment", F.lit("  "))).alias("segment"),
    )
    return ids.clean_missing(dirty)


@query
def f11_safe_ratio(s: Study) -> DataFrame:
    li = s.raw["lineitem"].groupBy("l_partkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("n"), F.count_if(F.col("l_discount") > 0.08).alias("d")
    )
    return li.withColumn("ratio", numbers.ratio(F.col("n"), F.col("d")))


@query
def f12_clip(s: Study) -> DataFrame:
    n = F.col("c_custkey")
    v = (
        F.when(n % 9 == 0, float("nan")).when(n % 9 == 1, float("inf")).when(n % 9 == 2, F.lit(None))
        .otherwise(F.col("c_acctbal") / 5000)
    )
    return s.raw["customer"].select("c_custkey", numbers.tidy(numbers.clip01(v), 9).alias("clipped"))


@query
def f13_saturating_count(s: Study) -> DataFrame:
    li = s.raw["lineitem"].groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("d"))
    half = F.lit(0.5)
    return li.select(
        "l_suppkey", "l_linenumber",
        numbers.tidy(numbers.saturate(F.col("n"), F.lit(60)), 6).alias("count_norm"),
        numbers.tidy(numbers.blend(F.col("n"), F.lit(60), F.col("d") * 10, half, half), 6).alias("blend"),
    )


@query
def f14_logistic(s: Study) -> DataFrame:
    return s.raw["customer"].select("c_custkey", numbers.tidy(numbers.logistic(F.col("c_acctbal") / 1000), 9).alias("p"))


@query
def f15_direction(s: Study) -> DataFrame:
    v = (F.col("c_custkey") % 5 - 2) * F.lit(7e-7)
    return s.raw["customer"].select("c_custkey", numbers.direction(v).alias("direction"))


@query
def f16_mechanism_phrases(s: Study) -> DataFrame:
    blank = F.when(F.col("target_id").endswith("3"), F.lit("")).otherwise(F.col("target_name"))
    return s.tables["drug_targets"].select(
        "drug_id", "target_id", texts.mechanism_phrase(F.col("action_type"), blank, F.col("target_id")).alias("phrase")
    )


@query
def f17_graph_ids(s: Study) -> DataFrame:
    return s.edges.select("graph_id", F.col("id").alias("edge_id"), "source", "target")


@query
def f18_flat_features(s: Study) -> DataFrame:
    return features.flat_long(s.features)


@query
def f19_display(s: Study) -> DataFrame:
    return s.ranked.select(
        "disease_id", "drug_id",
        texts.shown_score(F.col("repurposing_score")).alias("score"),
        texts.shown_points(F.col("ml_points")).alias("ml_points"),
        texts.shown_percent(F.col("gene_target_value")).alias("gene_percent"),
        texts.shown_status(narrative.evidence_status(F.col("pathway_value"))).alias("pathway_status"),
        texts.title_case(F.when(F.col("generated_by_pathway"), "gene_target_pathway").otherwise("gene_target")).alias("title"),
    )


@query
def f20_mentions(s: Study) -> DataFrame:
    n = F.col("n")
    extra = F.concat(
        F.lit(" HGNC:"), n, F.lit(", DRUG:00"), n, F.lit("; xTGT:1 R-HSA-"), n * 3, F.lit(" GENE:7b GENE:"), n, F.lit(". DIS:")
    )
    d = _all_texts(s).withColumn("text", F.concat("text", F.when(n % 2 == 0, extra).otherwise(F.lit(""))))
    pages = s.raw["pages"].select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("page_id").alias("n"), F.col("html").alias("text"))
    d = d.unionByName(pages)
    found = texts.mentions(F.col("text"))
    return d.select("id", F.size(found).cast("long").alias("n_mentions"), F.array_join(found, "|").alias("mentions"))


@query
def f21_banned_language(s: Study) -> DataFrame:
    n = F.col("n")
    extra = (
        F.when(n % 8 == 0, " Will \n TREAT this").when(n % 8 == 1, " it is safely-made").when(n % 8 == 2, " incurable, unsafe")
        .when(n % 8 == 3, " clinically   proven").when(n % 8 == 4, " Guaranteed!").otherwise("")
    )
    d = _all_texts(s).withColumn("text", F.concat("text", extra))
    return d.select("id", texts.banned_phrase(F.col("text")).alias("phrase")).filter("phrase is not null")


# --- building the tables ---------------------------------------------------------------------
@query
def b1_minted_ids(s: Study) -> DataFrame:
    return _union([r.select(F.lit(e).alias("entity_type"), "key", "internal_id") for e, r in s.registries.items()])


@query
def b2_crosswalk(s: Study) -> DataFrame:
    return s.identifiers


@query
def b3_lookup(s: Study) -> DataFrame:
    wanted = s.raw["raw_aliases"].select(ids.ontology_key(F.col("ontology_id")).alias("ontology_id")).distinct()
    return registry.lookup(wanted, s.registries["disease"], "ontology_id", "disease_id")


@query
def b3_entity_counts(s: Study) -> DataFrame:
    return registry.entity_counts(s.registries)


@query
def b4_drugs(s: Study) -> DataFrame:
    return s.tables["drugs"]


@query
def b5_drug_side_effects(s: Study) -> DataFrame:
    return s.tables["drug_side_effects"]


@query
def b6_diseases(s: Study) -> DataFrame:
    return s.tables["diseases"]


@query
def b7_disease_genes(s: Study) -> DataFrame:
    return s.tables["disease_genes"]


@query
def b8_strongest_genes(s: Study) -> DataFrame:
    return build.strongest_genes(s.raw["raw_disease_genes"]).select(
        "ontology_id", "ensembl_id", "association_score", F.col("place").cast("long").alias("place")
    )


@query
def b9_targets(s: Study) -> DataFrame:
    return s.built_targets.table


@query
def b10_drug_targets(s: Study) -> DataFrame:
    return s.tables["drug_targets"]


@query
def b11_gene_pathway_edges(s: Study) -> DataFrame:
    return s.gene_pathways


@query
def b12_disease_pathways(s: Study) -> DataFrame:
    return s.tables["disease_pathways"]


@query
def b13_dropped_groups(s: Study) -> DataFrame:
    return build.support_accounting(s.support)


@query
def b14_rejections(s: Study) -> DataFrame:
    return s.ledger.select("stage", "reason", "n_rejected", F.array_join("examples", " ; ").alias("examples"))


@query
def b15_ingestion(s: Study) -> DataFrame:
    """The whole ingestion over landed files: rows per table."""
    land = _landing(s)
    names = ["drug_names", "side_effects", "mechanisms", "targets", "diseases", "pathway_names", "gene_pathways", "compound_map", "seeds"]
    done = ingest.build_all(s.spark, {n: land.path(n) for n in names}, s.ws, s.ws.path("ingested"), multiline=False)
    return done.counts


# --- validation and quality ---------------------------------------------------------------------
def _dirty_genes(s: Study) -> DataFrame:
    """Disease-gene rows with blanks, scores out of range and repeats."""
    g = s.tables["disease_genes"].drop("source")
    n = F.substring("gene_id", -2, 2).cast("int")
    base = g.select(
        F.when(n % 10 == 1, F.lit("")).otherwise(F.col("disease_id")).alias("disease_id"),
        F.when(n % 20 == 2, F.lit(None)).otherwise(F.col("gene_id")).alias("gene_id"),
        F.when(n % 10 == 3, F.lit("")).otherwise(F.col("gene_name")).alias("gene_name"),
        F.when(n % 10 == 4, F.col("association_score") + 1)
        .when(n % 10 == 5, F.lit(None)).otherwise(F.col("association_score")).alias("association_score"),
        F.when(n % 30 == 6, F.lit(None)).otherwise(F.lit("opentargets")).alias("source"),
        F.concat("disease_id", F.lit("|a|"), "gene_id").alias("seq"),
    )
    again = base.filter(n % 10 >= 7).withColumns({"seq": F.concat(F.lit("z"), "seq"), "gene_name": F.lit("again")})
    return base.unionByName(again)


@query
def v1_to_contract(s: Study) -> DataFrame:
    return conform.to_contract(_dirty_genes(s), "disease_genes")


@query
def v2_violations(s: Study) -> DataFrame:
    shaped = conform.to_contract(_dirty_genes(s), "disease_genes", keep=("seq",))
    _, bad = conform.split_valid(shaped, "disease_genes")
    return bad.select("seq", "disease_id", "gene_id", "reason")


@query
def v3_conformed(s: Study) -> DataFrame:
    clean, _ = conform.conform(_dirty_genes(s), "disease_genes")
    return clean


@query
def v3_duplicate_keys(s: Study) -> DataFrame:
    shaped = conform.to_contract(_dirty_genes(s), "disease_genes", keep=("seq",))
    good, _ = conform.split_valid(shaped, "disease_genes")
    return conform.duplicate_keys(good, "disease_genes")


def _damaged(s: Study) -> dict[str, DataFrame]:
    """The six tables with orphans, repeats and lost keys added to the relations."""
    out = {n: s.tables[n] for n in ("drugs", "diseases")}
    for n in ("drug_targets", "drug_side_effects", "disease_genes", "disease_pathways"):
        t = s.tables[n]
        fk, key = conform.PRIMARY_KEY[n]
        last, same, lost = F.substring(key, -1, 1), F.col(fk), F.lit(None).cast("string")
        pair = lambda a, b: F.struct(a.alias("_fk"), b.alias("_key"))
        again = {
            "7": pair(F.concat(F.lit("X"), same), F.col(key)), "3": pair(same, F.col(key)), "5": pair(same, lost), "9": pair(F.lit(""), F.col(key)),
        }
        more = [F.when(last == end, p) for end, p in again.items()]
        rows = t.select("*", F.inline(F.array_compact(F.array(pair(same, F.col(key)), *more))))  # one scan
        out[n] = rows.withColumns({fk: F.col("_fk"), key: F.col("_key")}).select(*t.columns)
    return out


@query
def q1_required_ids(s: Study) -> DataFrame:
    return quality.required_ids(_damaged(s))


@query
def q2_duplicate_rows(s: Study) -> DataFrame:
    return quality.duplicate_rows(_damaged(s))


@query
def q3_orphans(s: Study) -> DataFrame:
    return quality.orphans(_damaged(s))


@query
def q4_null_levels(s: Study) -> DataFrame:
    levels = quality.null_levels(_damaged(s), threshold=0.05)
    return levels.withColumn("null_fraction", numbers.tidy(F.col("null_fraction"), 6))


@query
def q5_core_tables(s: Study) -> DataFrame:
    return quality.core_tables({"drugs": s.tables["drugs"], "diseases": s.tables["diseases"].filter("source = 'nowhere'")})


@query
def q6_verdict(s: Study) -> DataFrame:
    good, bad = quality.verdict(quality.quality_checks(s.tables)), quality.verdict(quality.quality_checks(_damaged(s)))
    return good.withColumn("which", F.lit("stored")).unionByName(bad.withColumn("which", F.lit("damaged")))


@query
def q7_recheck_stored(s: Study) -> DataFrame:
    root = _stored(s)
    stored = {n: files.load_table(s.spark, root, n) for n in TABLES}
    return quality.quality_checks(stored)


# --- resolution and profiles -----------------------------------------------------------------------
@query
def e1_sanitize_issues(s: Study) -> DataFrame:
    return quality.sanitize(_damaged(s))[1]


@query
def e1_sanitized_counts(s: Study) -> DataFrame:
    return quality.row_counts(quality.sanitize(_damaged(s))[0])


@query
def e2_disease_keys(s: Study) -> DataFrame:
    return s.disease_keys


@query
def e3_unresolved_aliases(s: Study) -> DataFrame:
    return resolve.unresolved_aliases(s.aliases, s.disease_keys)


@query
def e4_drug_keys(s: Study) -> DataFrame:
    return s.drug_keys


@query
def e5_resolve_diseases(s: Study) -> DataFrame:
    return s.resolved_diseases.drop("shape")


@query
def e6_resolve_drugs(s: Study) -> DataFrame:
    return s.resolved_drugs.drop("shape")


@query
def e6_ambiguous_drugs(s: Study) -> DataFrame:
    return resolve.ambiguous_drugs(s.raw["raw_drug_queries"], s.drug_keys)


@query
def e7_disease_suggestions(s: Study) -> DataFrame:
    names = s.tables["diseases"].select(F.col("disease_id").alias("entity_id"), F.col("disease_name").alias("name"))
    return resolve.suggestions(s.resolved_diseases, s.disease_keys, names)


@query
def e7_drug_suggestions(s: Study) -> DataFrame:
    names = s.tables["drugs"].select(F.col("drug_id").alias("entity_id"), F.col("drug_name").alias("name"))
    return resolve.suggestions(s.resolved_drugs, s.drug_keys, names)


@query
def e8_ordered_genes(s: Study) -> DataFrame:
    d = profiles.ordered_genes(s.tables["disease_genes"], s.ws)
    return d.select("disease_id", "gene_id", "gene_name", "association_score", "position")


@query
def e8_ordered_pathways(s: Study) -> DataFrame:
    d = profiles.ordered_pathways(s.tables["disease_pathways"], s.ws)
    return d.select("disease_id", "pathway_id", "gene_support_count", "position")


def _summary(s: Study) -> DataFrame:
    t = s.tables
    return profiles.molecular_summary(t["diseases"], t["disease_genes"], t["disease_pathways"], s.genes_per_disease)


@query
def e9_molecular_summary(s: Study) -> DataFrame:
    d = _summary(s)
    return d.withColumns({c: F.array_join(c, "|") for c in ("top_gene_symbols", "top_pathway_names")})


@query
def e10_disease_profiles(s: Study) -> DataFrame:
    t = s.tables
    d = profiles.disease_profiles(
        t["diseases"], t["disease_genes"], t["disease_pathways"], s.identifiers, s.genes_per_disease
    )
    return d.select(
        "disease_id", "disease_name", "ontology_id", F.size("genes").alias("n_genes"), F.size("pathways").alias("n_pathways"),
        F.col("genes")[0]["gene_name"].alias("first_gene"), F.col("pathways")[0]["pathway_name"].alias("first_pathway"),
        F.size("external_identifiers").alias("n_external"), "genes_truncated",
    )


@query
def e10_provenance(s: Study) -> DataFrame:
    """Where each disease profile comes from."""
    t = s.tables
    d = profiles.disease_profiles(
        t["diseases"], t["disease_genes"], t["disease_pathways"], s.identifiers, s.genes_per_disease
    )
    p = "provenance"
    return d.select(
        "disease_id", f"{p}.disease_source", F.array_join(f"{p}.datasets_used", ",").alias("datasets_used"), f"{p}.gene_source",
        f"{p}.genes_capped_per_disease", f"{p}.genes_truncated", f"{p}.pathway_source", f"{p}.pathway_min_gene_support", f"{p}.snapshot_note",
    )


@query
def e11_external_ids(s: Study) -> DataFrame:
    parts = []
    for entity, table, col in (("disease", "diseases", "disease_id"), ("drug", "drugs", "drug_id")):
        known = profiles.external_ids(s.tables[table], s.identifiers, entity, col).withColumn("origin", F.lit("crosswalk"))
        own = profiles.fallback_external_ids(s.tables[table], entity).withColumn("origin", F.lit("own"))
        parts += [d.withColumnRenamed(col, "entity_id") for d in (known, own)]
    return _union(parts)


@query
def e12_ordered_side_effects(s: Study) -> DataFrame:
    d = profiles.ordered_side_effects(s.tables["drug_side_effects"], s.ws)
    return d.select("drug_id", "side_effect_id", "side_effect_name", "position")


@query
def e12_ordered_targets(s: Study) -> DataFrame:
    d = profiles.ordered_targets(s.tables["drug_targets"].select("drug_id", "target_id", "target_name"), s.ws)
    return d.select("drug_id", "target_id", "target_name", "position")


@query
def e13_mechanisms(s: Study) -> DataFrame:
    return profiles.mechanisms(s.tables["drug_targets"])


@query
def e14_drug_pathways(s: Study) -> DataFrame:
    d = profiles.capped_pathways(s.drug_pathways, s.drug_protein_pathways)
    return d.withColumns({"supporting_uniprot_ids": F.array_join("supporting_uniprot_ids", "|"), "position": F.col("position").cast("long")})


@query
def e15_context_availability(s: Study) -> DataFrame:
    t = s.tables
    kinds = {
        "given": profiles.context_availability(t["drugs"], t["drug_targets"], s.drug_pathways),
        "disabled": profiles.context_availability(t["drugs"], t["drug_targets"], s.drug_pathways, enabled=False),
        "missing": profiles.context_availability(t["drugs"], t["drug_targets"], None),
    }
    return _union([d.withColumn("run", F.lit(k)) for k, d in kinds.items()])


@query
def e16_drug_profiles(s: Study) -> DataFrame:
    t = s.tables
    d = profiles.drug_profiles(
        t["drugs"], t["drug_side_effects"], t["drug_targets"], s.drug_pathways, s.drug_protein_pathways, s.identifiers
    )
    return d.select(
        "drug_id", "drug_name", "side_effect_count", "target_count", "pathway_context_available",
        F.size(F.coalesce("mechanisms", F.array())).alias("n_mechanisms"),
        F.size(F.coalesce("pathways", F.array())).alias("n_pathways"),
        F.col("side_effects")[0]["side_effect_name"].alias("first_effect"),
        F.get("mechanisms", 0)["description"].alias("first_mechanism"),
    )


@query
def e16_provenance(s: Study) -> DataFrame:
    """The proteins of each drug, and where its profile comes from."""
    t = s.tables
    d = profiles.drug_profiles(
        t["drugs"], t["drug_side_effects"], t["drug_targets"], s.drug_pathways, s.drug_protein_pathways, s.identifiers
    )
    p = "provenance"
    return d.select(
        "drug_id", F.array_join("proteins", "|").alias("proteins"), f"{p}.pathway_source",
        F.array_join(f"{p}.datasets_used", ",").alias("datasets_used"), F.array_join(f"{p}.optional_sources_used", ",").alias("optional_sources_used"),
        F.col(f"{p}.optional_sources_skipped")["reactome"].alias("reactome_skipped"),
    )


@query
def e17_disease_summaries(s: Study) -> DataFrame:
    t = s.tables
    return profiles.disease_summaries(t["diseases"], t["disease_genes"], t["disease_pathways"], s.genes_per_disease)


@query
def e17_drug_summaries(s: Study) -> DataFrame:
    t = s.tables
    return profiles.drug_summaries(t["drugs"], t["drug_side_effects"], t["drug_targets"], s.drug_pathways)


# --- candidates -------------------------------------------------------------------------------------
@query
def c1_bridge(s: Study) -> DataFrame:
    return s.bridged_genes.select("disease_id", "gene_id", "ensembl_id", "hgnc_id", "gene_symbol")


@query
def c2_bridged_targets(s: Study) -> DataFrame:
    return s.bridged_targets.select("drug_id", "target_id", "uniprot_id", "hgnc_id", "action_type")


@query
def c2_bridge_coverage(s: Study) -> DataFrame:
    return candidates.bridge_coverage(s.tables["drug_targets"], s.bridged_targets)


@query
def c3_drug_pathways(s: Study) -> DataFrame:
    return s.drug_pathways


@query
def c4_gene_target_matches(s: Study) -> DataFrame:
    return s.gene_matches.drop("association_score", "disease_gene_name")


@query
def c5_pathway_matches(s: Study) -> DataFrame:
    return s.pathway_matches


@query
def c6_gene_route(s: Study) -> DataFrame:
    return candidates.route_pairs(s.gene_matches)


@query
def c6_pathway_route(s: Study) -> DataFrame:
    return candidates.route_pairs(s.pathway_matches)


@query
def c7_candidate_rollups(s: Study) -> DataFrame:
    d = s.rollups
    return d.select("disease_id", "drug_id", *[_joined(c) for c in d.columns if c not in candidates.PAIR])


@query
def c8_route_counts(s: Study) -> DataFrame:
    return candidates.route_counts(s.pairs, s.tables["diseases"], s.tables["drugs"])


@query
def c9_route_degradation(s: Study) -> DataFrame:
    """Candidates when the bridge is missing: the pathway route alone, and why."""
    none = candidates.empty_gene_matches(s.tables["disease_genes"], s.tables["drug_targets"])
    pairs = candidates.candidate_pairs(candidates.gene_pair_counts(none), candidates.pathway_pair_counts(s.pathway_matches))
    counts = pairs.agg(F.count_if("generated_by_gene_target").alias("gene_target"), F.count_if("generated_by_pathway").alias("pathway"))
    why = candidates.route_provenance("bridge file not present", None, s.spark)
    return why.join(counts).select("route", "available", "unavailable_reason", F.when(F.col("route") == "gene_target", F.col("gene_target")).otherwise(F.col("pathway")).alias("n_pairs"))


# --- features ---------------------------------------------------------------------------------------
def _features(s: Study, *columns: str) -> DataFrame:
    return s.features.select("disease_id", "drug_id", *columns)


@query
def g1_route_features(s: Study) -> DataFrame:
    return _features(s, *MODEL_COLUMNS[:5])


@query
def g2_gene_overlap(s: Study) -> DataFrame:
    return _features(s, *MODEL_COLUMNS[5:12])


@query
def g3_overlap_ratios(s: Study) -> DataFrame:
    return _features(s, *[c for c in MODEL_COLUMNS if c.startswith("fraction_")])


@query
def g4_pathway_overlap(s: Study) -> DataFrame:
    return _features(s, *MODEL_COLUMNS[14:17], "drug_pathway_source")


@query
def g5_side_effect_burden(s: Study) -> DataFrame:
    return _features(s, "side_effect_count", *MODEL_COLUMNS[26:])


@query
def g6_action_histograms(s: Study) -> DataFrame:
    def shown(c: str) -> "F.Column":
        e = F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"]))
        return F.array_join(e, "|").alias(c)

    return s.drug_dim.select("drug_id", *MODEL_COLUMNS[20:25], shown("target_action_type_counts"), shown("target_type_counts"))


@query
def g7_mechanism_count(s: Study) -> DataFrame:
    return s.drug_dim.select("drug_id", "mechanism_count")


@query
def g8_missing_dimensions(s: Study) -> DataFrame:
    known = s.drug_dim.filter(~F.col("drug_id").endswith("3"))
    return features.missing_dimensions(s.pairs, s.disease_dim, known)


@query
def g9_feature_rows(s: Study) -> DataFrame:
    return s.features.select("disease_id", "drug_id", "disease_name", "drug_name", *MODEL_COLUMNS, "unique_target_count")


# --- model ------------------------------------------------------------------------------------------
@query
def m1_labels(s: Study) -> DataFrame:
    return s.training.select("disease_id", "drug_id", "chembl_id", "label")


@query
def m2_training_summary(s: Study) -> DataFrame:
    return model.training_summary(s.training)


@query
def m3_matrix(s: Study) -> DataFrame:
    return model.matrix(s.features).select("disease_id", "drug_id", *MODEL_COLUMNS)


@query
def m4_standardized(s: Study) -> DataFrame:
    z = model.standardize(s.training.select("disease_id", "drug_id", *MODEL_COLUMNS), s.stats)
    long = z.select("disease_id", "drug_id", F.posexplode("z").alias("i", "v"))
    return long.select("disease_id", "drug_id", F.col("i").cast("long").alias("i"), numbers.tidy(F.col("v"), 6).alias("z"))


@query
def m5_class_weights(s: Study) -> DataFrame:
    return model.class_weights(s.training)


@query
def m6_logistic_regression(s: Study) -> DataFrame:
    d = model.score(s.training, s.logistic)
    return d.select("disease_id", "drug_id", "label", "model_output")


@query
def m7_random_forest(s: Study) -> DataFrame:
    d = model.score(s.training, s.forest)
    return d.select("disease_id", "drug_id", "label", "model_output")


@query
def m8_grouped_folds(s: Study) -> DataFrame:
    return model.folds(s.training)


@query
def m9_fold_metrics(s: Study) -> DataFrame:
    return model.fold_metrics(s.rule_scores)


@query
def m10_cv_summary(s: Study) -> DataFrame:
    return model.cv_summary(model.fold_metrics(s.rule_scores))


@query
def m11_selected_model(s: Study) -> DataFrame:
    picked = model.select_model(model.cv_summary(model.fold_metrics(s.rule_scores)), ["linear_7", "linear_5"])
    return picked.select("model", "pr_auc_mean", "roc_auc_mean")


@query
def m12_trained_models(s: Study) -> DataFrame:
    """Cross-validated quality of both classifiers over the whole training set."""
    return model.cv_summary(model.fold_metrics(s.cv_scores))


@query
def m13_stored_model(s: Study) -> DataFrame:
    """Scores of the model after it was written and read back."""
    path = s.ws.path("model_store")
    model.save(s.logistic, path, s.spark)
    return model.score(s.features, model.load(path, s.spark)).select("disease_id", "drug_id", "model_output")


@query
def m14_scores(s: Study) -> DataFrame:
    d = s.linear()
    return d.select("disease_id", "drug_id", "model_output", "baseline_output")


@query
def m15_linear_attribution(s: Study) -> DataFrame:
    d = model.linear_attribution(s.features, rule_coefficients(7), s.stats)
    long = d.select("disease_id", "drug_id", F.posexplode("contributions").alias("i", "c"))
    return long.select("disease_id", "drug_id", F.col("i").cast("long").alias("i"), numbers.tidy(F.col("c"), 6).alias("contribution"))


@query
def m16_forest_attribution(s: Study) -> DataFrame:
    """Sum of path contributions per pair; output minus baseline must equal it."""
    base = model.baseline(s.forest, s.ws)
    d = model.score(model.forest_attribution(s.features, s.forest, s.ws), s.forest)
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c)
    return d.select("disease_id", "drug_id", "model_output", F.lit(base).alias("baseline_output"), numbers.tidy(total, 6).alias("sum_contributions"))


@query
def m6_checks(s: Study) -> DataFrame:
    """Facts about the fitted linear model that hold whatever its coefficients are."""
    d = model.score(s.training, s.logistic)
    flat = model.largest_gradient(s.training, s.logistic) < 1e-3
    return _facts(d).withColumn("at_optimum", F.lit(flat))


@query
def m7_checks(s: Study) -> DataFrame:
    return _facts(model.score(s.training, s.forest))


def _facts(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("label").cast("long").alias("n_positive"),
        F.count_if(~F.col("model_output").between(0, 1) | F.col("model_output").isNull()).alias("n_outside"),
    )


@query
def m12_checks(s: Study) -> DataFrame:
    """Every training row is held out once by each classifier."""
    per_row = s.cv_scores.groupBy("model", *model.PAIR).agg(F.count(F.lit(1)).alias("n"))
    return per_row.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n") != 1).alias("n_repeated"))


@query
def m13_checks(s: Study) -> DataFrame:
    """Pairs that the stored model scores otherwise than the fitted one."""
    path = s.ws.path("model_checked")
    model.save(s.logistic, path, s.spark)
    pair = list(model.PAIR)
    stored = model.score(s.features, model.load(path, s.spark)).select(*pair, F.col("model_output").alias("stored"))
    both = model.score(s.features, s.logistic).select(*pair, "model_output").join(stored, pair)
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(F.col("stored") - F.col("model_output")) > 1e-6).alias("n_different"))


@query
def m14_learned_checks(s: Study) -> DataFrame:
    """The chosen model scores every pair, and its contributions explain each output."""
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c)
    logit = lambda p: F.log(F.col(p) / (1 - F.col(p)))
    linear = F.abs(logit("model_output") - logit("baseline_output") - total) > 0.05
    forest = F.abs(F.col("model_output") - F.col("baseline_output") - total) > 1e-4
    inside = F.col("model_output").between(0.001, 0.999)
    open_gap = F.when(F.col("model_name") == "logistic_regression", inside & linear).otherwise(forest)
    return s.learned_predictions.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("model_output").between(0, 1)).alias("n_outside"),
        F.count_if(open_gap).alias("n_unexplained"),
    )


@query
def m16_checks(s: Study) -> DataFrame:
    d = m16_forest_attribution(s)
    gap = F.abs(F.col("model_output") - F.col("baseline_output") - F.col("sum_contributions")) > 1e-4
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(gap).alias("n_unexplained"))


def _learned_features(s: Study) -> DataFrame:
    rows = s.features.join(s.learned_predictions.select(*model.PAIR, "contributions"), list(model.PAIR))
    return model.top_features(rows).withColumn("place", F.col("place").cast("long"))


@query
def m17_learned_features(s: Study) -> DataFrame:
    """The strongest contributions of the chosen model, for every pair."""
    return _learned_features(s)


@query
def m7_forest_facts(s: Study) -> DataFrame:
    """The fitted forest follows its settings, from its node table."""
    return model.forest_facts(s.forest, s.ws)


@query
def m11_learned_checks(s: Study) -> DataFrame:
    """The chosen classifier has the best validation of all."""
    summary = model.cv_summary(model.fold_metrics(s.cv_scores)).withColumn("chosen", F.col("model") == s.learned.name)
    best = F.max(F.when(F.col("chosen"), F.col("pr_auc_mean"))).over(Window.partitionBy(F.lit(0)))  # a row for each model
    marked = summary.withColumn("better", F.col("pr_auc_mean") > best)
    return marked.agg(
        F.count(F.lit(1)).alias("n_models"), F.count_if("chosen").alias("n_chosen"), F.count_if("better").alias("n_better")
    )


@query
def m13_record_checks(s: Study) -> DataFrame:
    """The stored record of the chosen model, and pairs that it scores otherwise than the model."""
    stored = model.load(s.stored_model, s.spark)
    told, pair = stored.metadata, list(model.PAIR)
    again = model.score(s.features, stored).select(*pair, F.col("model_output").alias("stored"))
    both = s.learned_predictions.select(*pair, "model_output").join(again, pair)
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.abs(F.col("stored") - F.col("model_output")) > 1e-6).alias("n_different"),
    ).withColumns(
        {
            "n_training_rows": F.lit(told["n_rows"]).cast("long"),
            "n_positive": F.lit(told["n_positive"]).cast("long"),
            "prevalence": F.round(F.lit(told["prevalence"]), 6),
            "n_validated": F.lit(len(told["validation"])),
            "n_columns": F.lit(len(told["feature_columns"])),
            "seed": F.lit(told["seed"]),
            "chosen_is_stored": F.lit(stored.name == s.learned.name),
        }
    )


@query
def m18_learned_checks(s: Study) -> DataFrame:
    """Importances of the chosen model: a place for each column, largest first."""
    before = F.lag("importance").over(Window.partitionBy(F.lit(0)).orderBy("place"))  # a row for each column
    d = model.global_importance(s.learned, s.spark).withColumn("before", before)
    return d.agg(
        F.count_distinct("place").alias("n_places"),
        F.count_distinct("feature_name").alias("n_columns"),
        F.count_if((F.col("importance") < 0) | (F.col("importance") > F.col("before"))).alias("n_out_of_order"),
    )


@query
def m18_learned_importance(s: Study) -> DataFrame:
    return model.global_importance(s.learned, s.spark)


@query
def r2_learned_top(s: Study) -> DataFrame:
    """Top candidates per disease with the trained model's scores."""
    return s.with_model("learned").top.select("disease_id", "drug_id", "rank", "repurposing_score")


@query
def r2_learned_checks(s: Study) -> DataFrame:
    """Published pairs of the chosen model, per disease: dense ranks in the order of the scores,
    whose parts add up; and every pair is fused."""
    chosen = s.with_model("learned")
    before = F.lag("repurposing_score").over(Window.partitionBy("disease_id").orderBy("rank"))
    parts = sum((F.coalesce(F.col(f"{c}_points"), F.lit(0.0)) for c in COMPONENTS), F.lit(0.0))
    d = chosen.top.withColumns({"before": before, "gap": F.abs(parts - F.col("repurposing_score"))})
    per = d.groupBy("disease_id").agg(
        F.count(F.lit(1)).alias("n_published"),
        F.max("rank").cast("long").alias("last_rank"),
        F.count_if(F.col("repurposing_score") > F.col("before")).alias("n_out_of_order"),
        F.count_if(F.col("gap") > 0.01).alias("n_unbalanced"),
        F.count("ml_value").alias("n_with_model"),
    )
    n = chosen.fused.groupBy("disease_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    return n.join(per, "disease_id", "left")


@query
def p1_learned_runs(s: Study) -> DataFrame:
    return reports.disease_runs(s.resolved_diseases, s.with_model("learned").top, s.top_n)


@query
def p1_learned_checks(s: Study) -> DataFrame:
    """Rows that each query gets from the chosen model."""
    runs = reports.disease_runs(s.resolved_diseases, s.with_model("learned").top, s.top_n)
    d = runs.groupBy("query_id", "status")
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.count("drug_id").alias("n_ranked"), F.max("rank").cast("long").alias("last_rank"))


@query
def p2_learned_checks(s: Study) -> DataFrame:
    """What the overview counts whatever the model's scores are."""
    routes = candidates.route_counts(s.pairs, s.tables["diseases"], s.tables["drugs"])
    d = reports.overview(_summary(s), routes, s.with_model("learned").top, s.top_n)
    return d.select("disease_id", "candidates_ranked", "n_with_ml_evidence")


@query
def p4_learned_checks(s: Study) -> DataFrame:
    """Attributions of the chosen model for the resolved queries: places in the order of size,
    directions that follow the signs."""
    asked = s.resolved_diseases.filter("status = 'resolved'").select("query_id", F.col("match_id").alias("disease_id"))
    size = F.abs("contribution")
    before = F.lag(size).over(Window.partitionBy("query_id", "disease_id", "drug_id").orderBy("place"))
    d = asked.join(_learned_features(s), "disease_id").withColumn("before", before)
    sign = numbers.direction(F.col("contribution"))
    told = (size > DEAD_BAND) & (F.col("direction") != sign)
    return d.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(size > F.col("before") + 1e-6).alias("n_out_of_order"),
        F.count_if(told).alias("n_wrong_direction"),
    )


@query
def m17_top_features(s: Study) -> DataFrame:
    return model.top_features(s.linear()).withColumn("place", F.col("place").cast("long"))


@query
def m18_global_importance(s: Study) -> DataFrame:
    """The rule model's weights times the spread of its columns, strongest first."""
    spread = model.column_stats(s.training).select(F.posexplode("scales").alias("i", "scale"))
    rank = model.importance(s.spark, rule_coefficients(7))
    names = s.spark.createDataFrame(list(enumerate(MODEL_COLUMNS)), "i int, feature_name string")
    d = rank.join(names, "feature_name").join(spread, "i")
    return d.select("feature_name", F.col("place").cast("long").alias("place"), "importance", numbers.tidy(F.col("scale"), 6).alias("scale"))


# --- fusion and ranking --------------------------------------------------------------------------------
def _component(s: Study, name: str) -> DataFrame:
    d = fusion.components(s.fused).filter(F.col("component") == name)
    return d.select(
        "disease_id", "drug_id", "available", "value", "effective_weight", "contribution_points", "unavailable_reason"
    )


@query
def u1_gene_target_component(s: Study) -> DataFrame:
    return _component(s, "gene_target")


@query
def u2_pathway_component(s: Study) -> DataFrame:
    return _component(s, "pathway")


@query
def u3_model_component(s: Study) -> DataFrame:
    return _component(s, "ml")


@query
def u4_fused_score(s: Study) -> DataFrame:
    return s.fused.select("disease_id", "drug_id", "repurposing_score", *[f"{c}_points" for c in COMPONENTS])


@query
def u4_score_without_model(s: Study) -> DataFrame:
    return s.fused_without_model.select("disease_id", "drug_id", "repurposing_score", "weights_renormalized")


@query
def u5_weighting_schemes(s: Study) -> DataFrame:
    """Every pair under every valid scheme; schemes come from the regions, some are invalid."""
    r = F.col("r_regionkey")
    schemes = s.raw["region"].select(
        F.concat(F.lit("scheme "), r).alias("scheme"),
        (F.lit(0.1) * (r + 1)).alias("gene_target_weight"),
        F.when(r == 3, 0.0).otherwise(0.25).alias("pathway_weight"),
        F.lit(0.3).alias("ml_weight"),
        (r + 1).alias("gene_target_cap"),
        F.lit(10).alias("pathway_cap"),
        (F.lit(0.25) * F.least(r, F.lit(3))).alias("count_share"),
        F.when(r == 4, 0.9).otherwise(1 - F.lit(0.25) * F.least(r, F.lit(3))).alias("specificity_share"),
    )
    d = fusion.fuse(s.features, s.predictions, schemes=schemes)
    return d.select("scheme", "disease_id", "drug_id", "repurposing_score")


@query
def u6_fused_rows(s: Study) -> DataFrame:
    return s.fused.select(
        "disease_id", "drug_id", "disease_name", "drug_name", "repurposing_score", "model_output", "baseline_output",
        F.array_join("top_feature_names", "|").alias("top_feature_names"), "scoring_version",
    )


@query
def u6_key_mismatches(s: Study) -> DataFrame:
    shifted = s.predictions.withColumn("drug_id", F.when(F.col("drug_id").endswith("5"), F.concat(F.lit("X"), "drug_id")).otherwise(F.col("drug_id")))
    return fusion.key_mismatches(s.features, shifted)


@query
def u7_context_columns(s: Study) -> DataFrame:
    return s.fused.select(
        "disease_id", "drug_id", "side_effect_count", "has_sider_evidence", "drug_target_count", "drug_pathway_count", "mechanism_count"
    )


@query
def u8_availability(s: Study) -> DataFrame:
    return fusion.availability(s.fused)


@query
def r1_rank(s: Study) -> DataFrame:
    return s.ranked.select("disease_id", "drug_id", "rank", "repurposing_score")


@query
def r2_top_n(s: Study) -> DataFrame:
    return ranking.top_n(s.fused, s.top_n).select("disease_id", "drug_id", "rank", "repurposing_score")


@query
def r3_duplicate_pairs(s: Study) -> DataFrame:
    twice = s.fused.unionByName(s.fused.filter(F.col("drug_id").endswith("4")))
    return ranking.duplicate_pairs(twice)


@query
def r4_ranking_table(s: Study) -> DataFrame:
    return ranking.ranking_table(s.ranked)


@query
def r5_run_provenance(s: Study) -> DataFrame:
    return ranking.run_provenance(s.fused, 40)


# --- narratives -------------------------------------------------------------------------------------------
@query
def n1_evidence_context(s: Study) -> DataFrame:
    d = narrative.evidence_context(s.top)
    pick = ["rank", "repurposing_score", "matched_gene_hgnc_ids[0]", "components[2].unavailable_reason", "model_output"]
    return d.select("disease_id", "drug_id", *[F.get_json_object("payload", f"$.{p}").alias(f"p{i}") for i, p in enumerate(pick)])


@query
def n2_evidence_status(s: Study) -> DataFrame:
    return s.ranked.select(
        "disease_id", "drug_id", *[narrative.evidence_status(F.col(f"{c}_value")).alias(f"{c}_status") for c in COMPONENTS]
    )


@query
def n3_family_sentences(s: Study) -> DataFrame:
    return s.narratives.select("disease_id", "drug_id", *[f"{c}_description" for c in COMPONENTS])


@query
def n4_summaries(s: Study) -> DataFrame:
    return s.narratives.select("disease_id", "drug_id", "summary", F.array_join("limitations", " | ").alias("limitations"))


@query
def n5_allowed_ids(s: Study) -> DataFrame:
    return narrative.allowed_ids(s.top).select("disease_id", "drug_id", F.array_join("allowed", "|").alias("allowed"))


def _responses(s: Study) -> DataFrame:
    """JSON answers derived from the ranked pairs, most of them damaged in one of many ways."""
    k = (F.col("rank") + F.substring("drug_id", -4, 4).cast("int")) % 23
    score = F.col("repurposing_score")
    first = F.coalesce(F.get("matched_gene_hgnc_ids", 0), F.col("drug_id"))
    q = F.lit('"')

    def text(c) -> "F.Column":
        return F.concat(q, c, q)

    rank_text = F.when(k == 5, "null").when(k == 6, text(F.lit("x"))).when(k == 7, (F.col("rank") + 1).cast("string")).when(
        k == 8, F.concat(F.col("rank").cast("string"), F.lit(".7"))
    ).when(k == 9, text(F.concat(F.lit(" "), "rank"))).otherwise(F.col("rank").cast("string"))
    score_text = F.when(k == 10, text(F.lit("high"))).when(k == 11, numbers.tidy(score + 0.04, 4).cast("decimal(12,4)").cast("string")).when(
        k == 12, numbers.tidy(score + 1.0, 4).cast("decimal(12,4)").cast("string")
    ).otherwise(score.cast("decimal(12,4)").cast("string"))
    summary = (
        F.when(k == 13, text(F.lit("   ")))
        .when(k == 14, "7")
        .when(k == 17, text(F.concat(F.col("drug_id"), F.lit(" will  treat it"))))
        .when(k == 18, text(F.lit("see HGNC:999999999 and DRUG:1")))
        .otherwise(text(F.concat(F.lit(" plain words on "), "drug_id", F.lit(" and "), first, F.lit(" "))))
    )
    limits = (
        F.when(k == 15, text(F.lit("none"))).when(k == 16, '["a", 3]').when(k == 19, '["  "]')
        .when(k == 20, '["not proven"]').otherwise('[" short list "]')
    )
    notes = (
        F.when(k == 21, '["a"]').when(k == 22, '""').when(k == 4, '{"ml": " model note ", "gene_target": 5, "pathway": " "}')
        .otherwise('{"gene_target": "gene note"}')
    )
    who = F.when(k == 2, text(F.lit("DIS:0"))).otherwise(text(F.col("disease_id")))
    what = F.when(k == 3, "12").otherwise(text(F.col("drug_id")))
    body = F.concat(
        F.lit('{"disease_id": '), who, F.lit(', "drug_id": '), what, F.lit(', "rank": '), rank_text.cast("string"),
        F.lit(', "repurposing_score": '), score_text, F.when(k == 1, "").otherwise(F.concat(F.lit(', "summary": '), summary)),
        F.lit(', "evidence_notes": '), notes, F.lit(', "limitations": '), limits, F.lit("}"),
    )
    return s.top.select("disease_id", "drug_id", F.when(k == 0, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body).alias("response"))


@query
def n6_validated_responses(s: Study) -> DataFrame:
    return narrative.validate_responses(_responses(s), s.top).select("disease_id", "drug_id", "accepted", "failure")


@query
def n7_merged_narratives(s: Study) -> DataFrame:
    checked = narrative.validate_responses(_responses(s), s.top)
    d = narrative.merge_responses(s.narratives, checked)
    return d.withColumn("limitations", F.array_join("limitations", " | "))


@query
def n8_distinct_requests(s: Study) -> DataFrame:
    asked = s.top.withColumn("provider", F.lit("external")).unionByName(
        s.top.filter("rank <= 3").withColumn("provider", F.lit("external"))
    )
    return narrative.distinct_requests(asked)


# --- evidence graph ------------------------------------------------------------------------------------------
def _nodes_of(s: Study, *kinds: str) -> DataFrame:
    fields = {
        "disease_gene": ["hgnc_id", "ensembl_id", "source"],
        "drug_target": ["hgnc_id", "uniprot_id", "action_type"],
        "pathway": ["disease_gene_support_count", "drug_supporting_target_count"],
        "evidence_component": ["value", "effective_weight", "contribution_points"],
        "prediction": ["model_name", "model_output"],
        "score": ["repurposing_score"],
        "rank": ["rank"],
        "explanation": ["provider"],
    }
    names = [f for k in kinds for f in fields.get(k, [])]
    extra = [F.get_json_object("metadata", f"$.{f}").alias(f) for f in dict.fromkeys(names)]
    return s.nodes.filter(F.col("type").isin(*kinds)).select("graph_id", "id", "type", "label", *extra)


@query
def k1_entity_nodes(s: Study) -> DataFrame:
    return _nodes_of(s, "disease", "drug")


@query
def k2_gene_target_nodes(s: Study) -> DataFrame:
    return _nodes_of(s, "disease_gene", "drug_target")


@query
def k2_gene_target_edges(s: Study) -> DataFrame:
    genes = F.col("target").startswith("disease_gene")
    d = s.edges.filter(F.col("type").isin("matched_to", "has_target") | ((F.col("type") == "associated_with") & genes))
    return d.select("graph_id", F.col("id").alias("edge_id"), "source", "target", "type", "provenance")


@query
def k3_pathway_nodes(s: Study) -> DataFrame:
    return _nodes_of(s, "pathway")


@query
def k3_pathway_edges(s: Study) -> DataFrame:
    paths = F.col("target").startswith("pathway")
    d = s.edges.filter((F.col("type") == "participates_in") | ((F.col("type") == "associated_with") & paths))
    return d.select("graph_id", F.col("id").alias("edge_id"), "source", "target", "type", "provenance")


@query
def k4_evidence_nodes(s: Study) -> DataFrame:
    d = _nodes_of(s, "evidence_component", "prediction")
    numeric = ["value", "effective_weight", "contribution_points", "model_output"]
    return d.withColumns({c: F.col(c).cast("double") for c in numeric})


@query
def k4_methods(s: Study) -> DataFrame:
    """How each evidence node was worked out, and where it comes from."""
    of = lambda f: F.get_json_object("metadata", f"$.{f}").alias(f)
    d = s.nodes.filter("type = 'evidence_component'")
    return d.select("graph_id", "id", of("calculation_method"), of("provenance"))


@query
def k5_outcome_nodes(s: Study) -> DataFrame:
    d = _nodes_of(s, "score", "rank", "explanation")
    return d.withColumns({c: F.col(c).cast("double") for c in ("repurposing_score", "rank")})


@query
def k5_outcome_edges(s: Study) -> DataFrame:
    d = s.edges.filter(F.col("type").isin("received", "ranked", "explained_by"))
    return d.select("graph_id", F.col("id").alias("edge_id"), "type", "provenance")


@query
def k6_first_seen(s: Study) -> DataFrame:
    return s.nodes.select("graph_id", "id", "at_rank", "at_section", F.col("at_place").cast("long").alias("at_place"))


@query
def k7_graph_metadata(s: Study) -> DataFrame:
    def shown(c: str) -> "F.Column":
        e = F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"]))
        return F.array_join(e, "|").alias(c)

    d = graph.graph_metadata(s.nodes, s.edges, s.top.filter(F.col("rank") <= s.graph_top_n))
    return d.withColumns({c: shown(c) for c in ("node_type_counts", "edge_type_counts")})


@query
def k8_unmatched_ranks(s: Study) -> DataFrame:
    shifted = s.ranked.withColumn("drug_id", F.when(F.col("drug_id").endswith("6"), F.concat(F.lit("X"), "drug_id")).otherwise(F.col("drug_id")))
    return graph.unmatched_ranks(shifted, s.pairs)


@query
def k9_graph_sizes(s: Study) -> DataFrame:
    n = s.nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return n.join(s.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges")), "graph_id")


@query
def k10_node_degrees(s: Study) -> DataFrame:
    return graph.node_degrees(s.nodes, s.edges)


@query
def k10_edges_touching(s: Study) -> DataFrame:
    return graph.edges_touching(s.edges, s.nodes.filter("type = 'drug_target'"))


@query
def k11_target_joins(s: Study) -> DataFrame:
    return graph.target_joins(s.nodes, s.edges)


@query
def k12_shared_pathways(s: Study) -> DataFrame:
    return graph.shared_pathways(s.nodes, s.edges).withColumn("provenances", F.array_join("provenances", "|"))


def _ends(s: Study) -> DataFrame:
    """The nodes a reader traces from: the disease of a graph and its drugs."""
    return s.nodes.filter(F.col("type").isin("disease", "drug")).select("graph_id", "id")


@query
def k13_reachable_nodes(s: Study) -> DataFrame:
    return graph.reach(s.edges, _ends(s), s.ws)[0]


@query
def k13_walked_edges(s: Study) -> DataFrame:
    return graph.reach(s.edges, _ends(s), s.ws, "walk")[1]


@query
def k14_trace_steps(s: Study) -> DataFrame:
    return graph.trace_steps(s.nodes, s.edges)


@query
def k14_step_subgraph(s: Study) -> DataFrame:
    kept, inside = graph.step_subgraph(s.nodes, s.edges, 4)
    return kept.select("graph_id", "id", F.lit("node").alias("what")).unionByName(inside.select("graph_id", "id", F.lit("edge").alias("what")))


@query
def k15_visible_nodes(s: Study) -> DataFrame:
    return graph.visible_nodes(s.nodes).select("graph_id", "id", "type", F.col("row").cast("long").alias("row"), "relevance")


@query
def k15_visible_edges(s: Study) -> DataFrame:
    return graph.induced(s.edges, graph.visible_nodes(s.nodes)).select("graph_id", F.col("id").alias("edge_id"))


@query
def k15_overflow(s: Study) -> DataFrame:
    return graph.overflow(s.nodes)


@query
def k16_dangling_edges(s: Study) -> DataFrame:
    some = s.nodes.filter(~F.col("id").endswith("5"))
    return graph.dangling(s.edges, some)


# --- end-to-end reports -----------------------------------------------------------------------------------------
@query
def p1_disease_runs(s: Study) -> DataFrame:
    return reports.disease_runs(s.resolved_diseases, s.top, s.top_n)


@query
def p2_overview(s: Study) -> DataFrame:
    routes = candidates.route_counts(s.pairs, s.tables["diseases"], s.tables["drugs"])
    return reports.overview(_summary(s), routes, s.top, s.top_n)


@query
def p3_found_pairs(s: Study) -> DataFrame:
    return reports.find_pairs(s.pairs.select("disease_id", "drug_id"), s.top, s.top_n)


@query
def p4_predictions(s: Study) -> DataFrame:
    d = model.top_features(s.linear())
    asked = s.resolved_diseases.filter("status = 'resolved'").select("query_id", F.col("match_id").alias("disease_id"))
    return asked.join(d, "disease_id").select("query_id", "disease_id", "drug_id", "place", "feature_name", "contribution")


@query
def p4_explanations(s: Study) -> DataFrame:
    asked = s.resolved_diseases.filter("status = 'resolved'").select("query_id", F.col("match_id").alias("disease_id"))
    return asked.join(s.narratives, "disease_id").select("query_id", "disease_id", "drug_id", "rank", "summary")
