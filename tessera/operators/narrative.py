"""Templated narratives for ranked pairs, and grounding checks of external responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.constants import COMPONENTS, RANKING_VERSION, RESPONSE_KEYS, SCORE_TOLERANCE
from tessera.functions.ids import strip
from tessera.functions.texts import banned_phrase, fixed, mentions, title_case
from tessera.operators.candidates import PAIR
from tessera.operators.guards import joined_to_candidates

ID_ARRAYS = [
    "matched_gene_hgnc_ids",
    "matched_disease_gene_ids",
    "matched_drug_target_ids",
    "matched_pathway_reactome_ids",
]


def with_rollups(ranked: DataFrame, rollups: DataFrame) -> DataFrame:
    """Attach the matched id lists to the ranked pairs that will be narrated; a pair that no
    match generated is an error."""
    none = F.array().cast("array<string>")
    columns = [*ID_ARRAYS, "matched_gene_symbols", "generation_methods"]
    joined = joined_to_candidates(ranked, rollups)
    return joined.withColumns({c: F.coalesce(c, none) for c in columns})


# --- status and sentences --------------------------------------------------------------
def evidence_status(value: Column) -> Column:
    return (
        F.when(value.isNull(), "not_assessed").when(value > 0, "supported").otherwise("assessed_no_support")
    )


def _points(name: str) -> Column:
    return fixed(F.coalesce(f"{name}_points", F.lit(0.0)), 1)


def _sentence(name: str, unavailable: Column, nothing: Column | None, found: Column) -> Column:
    value = F.col(f"{name}_value")
    out = F.when(value.isNull(), unavailable)
    if nothing is not None:
        out = out.when(value <= 0, nothing)
    return out.otherwise(found)


def gene_target_sentence() -> Column:
    ids = F.col("matched_gene_hgnc_ids")
    shown = F.coalesce(F.nullif(F.array_join(F.slice(ids, 1, 5), ", "), F.lit("")), F.lit("n/a"))
    # fixed values: wording
    return _sentence(
        "gene_target",
        F.concat(F.lit("Gene-target evidence was unavailable ("), "gene_target_reason", F.lit(").")),
        F.lit("Gene-target evidence was assessed; no shared gene/target overlap was found."),
        F.concat(
            F.size(ids),
            F.lit(" disease-associated gene(s) matched this drug's known target(s) via HGNC id ("),
            shown,
            F.lit("), contributing "),
            _points("gene_target"),
            F.lit(" of the "),
            fixed(F.col("repurposing_score"), 1),
            F.lit("-point repurposing score."),
        ),
    )


def pathway_sentence() -> Column:
    # fixed values: wording
    return _sentence(
        "pathway",
        F.concat(F.lit("Pathway evidence was unavailable ("), "pathway_reason", F.lit(").")),
        F.lit("Pathway evidence was assessed; no shared Reactome pathway was found."),
        F.concat(
            F.size("matched_pathway_reactome_ids"),
            F.lit(
                " Reactome pathway(s) associated with the disease are also linked to this drug's targets, "
                "contributing "
            ),
            _points("pathway"),
            F.lit(" points to the repurposing score."),
        ),
    )


def model_sentence() -> Column:
    # fixed values: wording
    def shown(c: str) -> Column:
        return F.coalesce(fixed(F.col(c), 2), F.lit("n/a"))

    return _sentence(
        "ml",
        F.lit("ML evidence was unavailable (no Phase 6 prediction for this candidate)."),
        None,
        F.concat(
            F.lit("The Phase 6 model output was "),
            shown("model_output"),
            F.lit(" (baseline "),
            shown("baseline_output"),
            F.lit("), contributing "),
            _points("ml"),
            F.lit(" points to the repurposing score."),
        ),
    )


def summary_text() -> Column:
    available = F.concat_ws(", ", *[F.when(F.col(f"{c}_value").isNotNull(), c) for c in COMPONENTS])
    # fixed values: wording
    return F.concat(
        F.col("drug_name"),
        F.lit(" was computationally prioritized at rank "),
        F.col("rank"),
        F.lit(" for "),
        F.col("disease_name"),
        F.lit(", with a repurposing score of "),
        fixed(F.col("repurposing_score"), 1),
        F.lit("/100 based on the available evidence: "),
        F.coalesce(F.nullif(available, F.lit("")), F.lit("none available")),
        F.lit(
            ". This score reflects the available computational and biological evidence supporting "
            "further investigation — it is not a measure of clinical efficacy or treatment probability."
        ),
    )


def limitations() -> Column:
    # fixed values: wording
    missing = [
        F.when(
            F.col(f"{c}_value").isNull() & F.col(f"{c}_reason").isNotNull(),
            F.concat(title_case(F.lit(c)), F.lit(" evidence was unavailable: "), F.col(f"{c}_reason"), F.lit(".")),
        )
        for c in COMPONENTS
    ]
    lines = [
        *missing,
        F.when(
            F.col("weights_renormalized"),
            "Evidence weights were renormalized over the components that were available.",
        ),
        F.lit(
            "The repurposing score is an internal research prioritization score for further investigation "
            "— it is not a measure of clinical efficacy, safety, or treatment probability, and this "
            "candidate has not been clinically validated for this disease."
        ),
    ]
    return F.array_compact(F.array(*lines))


def narratives(ranked: DataFrame) -> DataFrame:
    """One templated narrative per ranked pair."""
    return ranked.select(
        *PAIR,
        "disease_name",
        "drug_name",
        "rank",
        "repurposing_score",
        *[evidence_status(F.col(f"{c}_value")).alias(f"{c}_status") for c in COMPONENTS],
        summary_text().alias("summary"),
        gene_target_sentence().alias("gene_target_description"),
        pathway_sentence().alias("pathway_description"),
        model_sentence().alias("ml_description"),
        limitations().alias("limitations"),
        F.lit("deterministic_fallback").alias("provider"),
    )


# --- context ---------------------------------------------------------------------------------
def evidence_context(ranked: DataFrame) -> DataFrame:
    """Compact JSON per ranked pair; absent values are left out."""
    parts = [
        F.struct(
            F.lit(c).alias("name"),
            F.col(f"{c}_value").isNotNull().alias("available"),
            F.col(f"{c}_value").alias("value"),
            F.col(f"{c}_weight").cast("double").alias("configured_weight"),
            F.col(f"{c}_effective_weight").alias("effective_weight"),
            F.col(f"{c}_points").alias("contribution_points"),
            F.col(f"{c}_reason").alias("unavailable_reason"),
        )
        for c in COMPONENTS
    ]
    payload = F.struct(
        *PAIR, "disease_name", "drug_name", "rank", "repurposing_score",
        F.lit("0-100").alias("score_scale"), "generation_methods", *ID_ARRAYS,
        F.array(*parts).alias("components"), "side_effect_count", "drug_target_count",
        "drug_pathway_count", "mechanism_count", "model_name", "model_output", "baseline_output",
        "scoring_version", F.lit(RANKING_VERSION).alias("ranking_version"),
    )
    return ranked.select(*PAIR, "rank", F.to_json(payload).alias("payload"))


def allowed_ids(ranked: DataFrame) -> DataFrame:
    """Add ``allowed``: every identifier a text about the pair may mention."""
    own = F.array("disease_id", "drug_id")
    model = F.when(
        F.col("ml_value").isNotNull(),
        F.concat(
            F.array(F.lit("predicted_probability"), F.col("model_name")),
            F.coalesce("top_feature_names", F.array().cast("array<string>")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    every = F.array_compact(F.concat(own, *[F.col(c) for c in ID_ARRAYS], model))
    return ranked.withColumn("allowed", F.sort_array(F.array_distinct(every)))


# --- validation --------------------------------------------------------------------------------
def _first(checks: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda acc, c: F.when(c[0], c[1]).otherwise(acc), reversed(checks), F.lit(None).cast("string"))


def _field(path: str) -> Column:
    return F.try_variant_get("_v", path, "variant")


def _kind(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_field(path)), F.lit("ABSENT"))


def _text(path: str) -> Column:
    return F.try_variant_get("_v", path, "string")


_NUMERIC = r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)\z"


def _as_integer(path: str) -> Column:
    """Numbers are truncated, numeric text and flags are accepted; else null."""
    kind, s = _kind(path), strip(_text(path))
    return (
        F.when(kind.rlike(_NUMERIC), F.try_variant_get("_v", path, "double").cast("long"))
        .when((kind == "STRING") & s.rlike(r"^[+-]?[0-9]+\z"), s.try_cast("long"))
        .when(kind == "BOOLEAN", F.try_variant_get("_v", path, "boolean").cast("long"))
    )


def _as_number(path: str) -> Column:
    kind, s = _kind(path), strip(_text(path))
    plain = s.rlike(r"(?i)^[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|nan|inf(?:inity)?)\z")
    return (
        F.when(kind.rlike(_NUMERIC), F.try_variant_get("_v", path, "double"))
        .when((kind == "STRING") & plain, s.try_cast("double"))
        .when(kind == "BOOLEAN", F.try_variant_get("_v", path, "boolean").cast("double"))
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """Typed pieces of each response; ``_v`` is null when it is not JSON."""
    is_text = "transform(coalesce(_l, array()), x -> coalesce(schema_of_variant(x), 'VOID') = 'STRING')"
    d = responses.withColumn("_v", F.try_parse_json("response")).withColumns(
        {
            "_keys": F.expr("json_object_keys(response)"),
            "_l": F.expr("try_variant_get(_v, '$.limitations', 'array<variant>')"),
            "_n": F.expr("try_variant_get(_v, '$.evidence_notes', 'map<string,variant>')"),
            "_nk": F.expr("json_object_keys(get_json_object(response, '$.evidence_notes'))"),
        }
    )
    note_kinds = _kind("$.evidence_notes")
    empty_note = (
        note_kinds.isin("ABSENT", "VOID", "ARRAY<VOID>", "OBJECT<>")
        | ((note_kinds == "STRING") & (_text("$.evidence_notes") == ""))
        | ((note_kinds == "BOOLEAN") & ~F.try_variant_get("_v", "$.evidence_notes", "boolean"))
        | (note_kinds.rlike(_NUMERIC) & (F.try_variant_get("_v", "$.evidence_notes", "double") == 0))
    )
    return d.withColumns(
        {
            "is_object": F.col("_v").isNotNull() & F.coalesce(F.schema_of_variant("_v"), F.lit("")).startswith("OBJECT"),
            "missing": F.array_except(F.array(*[F.lit(k) for k in RESPONSE_KEYS]), F.coalesce("_keys", F.array().cast("array<string>"))),
            "r_disease": _text("$.disease_id"),
            "r_drug": _text("$.drug_id"),
            "r_rank": _as_integer("$.rank"),
            "r_score": _as_number("$.repurposing_score"),
            "r_summary": F.when(_kind("$.summary") == "STRING", _text("$.summary")),
            "limits_ok": _kind("$.limitations").startswith("ARRAY") & F.forall(F.expr(is_text), lambda b: b),
            "r_limitations": F.expr("transform(coalesce(_l, array()), x -> try_variant_get(x, '$', 'string'))"),
            "notes_ok": empty_note | note_kinds.startswith("OBJECT"),
            "r_notes": F.expr(
                "filter(transform(coalesce(_nk, array()), k -> case when schema_of_variant(_n[k]) = 'STRING'"
                " then try_variant_get(_n[k], '$', 'string') end), s -> s is not null)"
            ),
            **{
                f"note_{c}": F.expr(
                    f"case when schema_of_variant(_n['{c}']) = 'STRING' then try_variant_get(_n['{c}'], '$', 'string') end"
                )
                for c in COMPONENTS
            },
        }
    ).drop("_v", "_keys", "_l", "_n", "_nk")


def validate_responses(responses: DataFrame, ranked: DataFrame) -> DataFrame:
    """``responses(disease_id, drug_id, response)`` checked against the ranked pairs.

    ``failure`` names the first failed check, in fixed order; null means accepted."""
    facts = allowed_ids(ranked).select(*PAIR, "rank", "repurposing_score", "allowed")
    d = parse_responses(responses).join(facts, PAIR)
    d = d.withColumn("_texts", F.concat(F.array("r_summary"), "r_limitations", "r_notes"))
    banned = F.filter(F.transform("_texts", banned_phrase), lambda p: p.isNotNull())
    unknown = F.filter(
        F.flatten(F.transform("_texts", mentions)), lambda m: ~F.array_contains(F.col("allowed"), m)
    )
    d = d.withColumns({"_banned": F.get(banned, 0), "_unknown": F.get(unknown, 0)})
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    listed = F.concat(F.lit("['"), F.array_join("missing", "', '"), F.lit("']"))
    close = F.abs(F.col("r_score") - F.col("repurposing_score")) <= SCORE_TOLERANCE
    # fixed values: order and wording of the checks
    failure = _first(
        [
            (~F.col("is_object"), F.lit("response was not a JSON object")),
            (F.size("missing") > 0, F.concat(F.lit("response missing required keys: "), listed)),
            (~F.col("r_disease").eqNullSafe(F.col("disease_id")), F.lit("response disease_id does not match the input candidate")),
            (~F.col("r_drug").eqNullSafe(F.col("drug_id")), F.lit("response drug_id does not match the input candidate")),
            (F.col("r_rank").isNull(), F.lit("response rank was not an integer")),
            (F.col("r_rank") != F.col("rank"), F.lit("response rank does not match the input candidate")),
            (F.col("r_score").isNull(), F.lit("response repurposing_score was not a number")),
            (F.isnan("r_score") | ~close, F.lit("response repurposing_score does not match the input candidate")),
            (F.coalesce(strip(F.col("r_summary")), F.lit("")) == "", F.lit("response summary was empty or not a string")),
            (~F.col("limits_ok"), F.lit("response limitations was not a list of strings")),
            (~F.col("notes_ok"), F.lit("response evidence_notes was not an object")),
            (
                F.col("_banned").isNotNull(),
                F.concat(F.lit("response used disallowed clinical-claim language: "), quoted(F.col("_banned"))),
            ),
            (
                F.col("_unknown").isNotNull(),
                F.concat(
                    F.lit("response referenced an identifier not present in the supplied evidence: "),
                    quoted(F.col("_unknown")),
                ),
            ),
        ]
    )
    return d.withColumn("failure", failure).select(
        *PAIR, "failure", F.col("failure").isNull().alias("accepted"),
        "r_summary", "r_limitations", *[f"note_{c}" for c in COMPONENTS],
    )


def merge_responses(base: DataFrame, validated: DataFrame, provider: str = "external") -> DataFrame:
    """Accepted prose replaces text only; everything else keeps the template and says why."""
    d = base.drop("provider").join(validated, PAIR, "left")
    ok = F.coalesce("accepted", F.lit(False))

    def prose(note: str, template: str) -> Column:
        cleaned = F.nullif(strip(F.col(note)), F.lit(""))
        return F.when(ok, F.coalesce(cleaned, F.col(template))).otherwise(F.col(template))

    lines = F.filter(F.transform("r_limitations", strip), lambda s: s != "")
    kept = F.when(ok & (F.size(lines) > 0), lines).otherwise(F.col("limitations"))
    return d.select(
        *PAIR,
        "rank",
        "repurposing_score",
        F.when(ok, strip(F.col("r_summary"))).otherwise(F.col("summary")).alias("summary"),
        *[prose(f"note_{c}", f"{c}_description").alias(f"{c}_description") for c in COMPONENTS],
        kept.alias("limitations"),
        F.when(ok, provider).otherwise("deterministic_fallback").alias("provider"),
        F.when(F.col("failure").isNotNull(), F.concat(F.lit("ExplanationValidationError: "), "failure")).alias("fallback_reason"),
    )


def distinct_requests(requests: DataFrame) -> DataFrame:
    """One row per (disease, drug, score at four decimals, versions, provider)."""
    return requests.select(
        *PAIR, F.round("repurposing_score", 4).alias("score_key"), "scoring_version",
        F.lit(RANKING_VERSION).alias("ranking_version"), "provider",
    ).distinct()
