"""The SQL twin of every query that SQL can express."""

from __future__ import annotations

import re

from oracles import rules as r
from oracles.ctes import CTES, num, z
from tessera.constants import COMPONENTS, MODEL_COLUMNS, RESPONSE_KEYS, SNAPSHOT
from tessera.plans.study import rule_coefficients

# --- resolution --------------------------------------------------------------------------
CTES["aliases"] = f"""
    select alias, arg_max(ontology, seq) as ontology from (select seq, {r.query_text('alias')} as alias, {r.ontology('ontology_id')} as ontology from raw_aliases)
    where alias <> '' and ontology is not null group by alias
"""
CTES["disease_keys_own"] = f"""
    select kind, key, entity_id, min(phase)::int as phase from (
      select 'internal' as kind, disease_id as key, disease_id as entity_id, 0 as phase from diseases
      union all select 'name', {r.query_text('disease_name')}, disease_id, 0 from diseases
      union all select 'ontology', {r.ontology('ontology_id')}, disease_id, 0 from diseases
      union all select 'ontology', {r.ontology('external_id')}, internal_id, 1 from identifiers where entity_type = 'disease' and internal_id in (select disease_id from diseases)
      union all select 'name', {r.query_text('name')}, internal_id, 1 from identifiers where entity_type = 'disease' and internal_id in (select disease_id from diseases)
    ) where coalesce(key, '') <> '' group by 1, 2, 3
"""
CTES["disease_keys"] = """
    select * from disease_keys_own union all
    select 'alias', a.alias, k.entity_id, 2 from aliases a join disease_keys_own k on k.kind = 'ontology' and k.key = a.ontology
"""
CTES["drug_keys"] = f"""
    select kind, key, entity_id, min(phase)::int as phase from (
      select 'internal' as kind, drug_id as key, drug_id as entity_id, 0 as phase from drugs
      union all select 'name', {r.query_text('drug_name')}, drug_id, 0 from drugs
      union all select 'external', {r.shout('chembl_id')}, drug_id, 0 from drugs
      union all select 'external', {r.shout('canonical_identifier')}, drug_id, 0 from drugs
      union all select 'external', {r.shout('pubchem_cid')}, drug_id, 0 from drugs
      union all select 'external', 'CID:' || {r.shout('pubchem_cid')}, drug_id, 0 from drugs
      union all select 'external', {r.shout('external_id')}, internal_id, 1 from identifiers where entity_type = 'drug' and internal_id in (select drug_id from drugs)
    ) where coalesce(key, '') <> '' group by 1, 2, 3
"""


def _resolution(what: str) -> None:
    kind = r.disease_kind("text") if what == "disease" else r.drug_kind("text")
    CTES[f"{what}_texts"] = f"""
        select *, {kind} as shape, {r.query_text('text')} as norm from (select distinct coalesce(query, '') as text from raw_{what}_queries)
    """
    if what == "disease":
        probes = [
            (0, "internal", r.shout("text"), "internal_id", "internal_id"),
            (1, "ontology", r.ontology("text"), "ontology_id", "ontology_id"),
            (2, "name", "norm", "exact_name", "name"),
            (3, "alias", "norm", "alias", "name"),
        ]
    else:
        cid = r.cid_query("text")
        probes = [
            (0, "internal", r.shout("text"), "internal_id", "internal_id"),
            (1, "external", r.chembl_query("text"), "external_id", "external_id"),
            (2, "external", cid, "external_id", "external_id"),
            (3, "external", f"'CID:' || {cid}", "external_id", "external_id"),
            (4, "name", "norm", "exact_name", "name"),
        ]
    rows = " union all ".join(
        f"select text, {p} as priority, '{k}' as kind, {key} as key, '{m}' as match_type from {what}_texts where shape = '{s}'"
        for p, k, key, m, s in probes
    )
    CTES[f"{what}_hits"] = f"""
        select p.*, k.entity_id from ({rows}) p join {what}_keys k on p.kind = k.kind and p.key = k.key where coalesce(p.key, '') <> ''
        qualify min(p.priority) over (partition by text) = p.priority
    """
    names = (
        "d.disease_name as match_name, d.ontology_id" if what == "disease" else "d.drug_name as match_name, d.chembl_id, d.pubchem_cid"
    )
    CTES[f"resolved_{what}s"] = f"""
        select q.query_id, q.query, t.shape, t.norm as normalized_query, t.text,
          case when t.shape = 'empty' then 'empty_query' when h.n = 1 then 'resolved' when h.n > 1 then 'ambiguous' else 'not_supported' end as status,
          h.match_type, h.key as matched_value, h.id as match_id, coalesce(h.n, 0) as n_matches, {names}
        from raw_{what}_queries q join {what}_texts t on coalesce(q.query, '') = t.text
        left join (select text, any_value(match_type) as match_type, any_value(key) as key, count(*) as n, case when count(*) = 1 then min(entity_id) end as id from {what}_hits group by text) h on h.text = t.text
        left join {what}s d on d.{what}_id = h.id
    """
    CTES[f"{what}_suggestions"] = f"""
        select norm as normalized_query, row_number() over (partition by norm order by key_place, own_place, name) as place, name as suggestion from (
          select norm, name, (min(spot)).k as key_place, (min(spot)).o as own_place from (
            select o.norm, e.{what}_name as name, {{'k': min({{'p': k.phase, 'e': k.entity_id}}) over (partition by o.norm, k.key), 'o': {{'p': k.phase, 'e': k.entity_id}}}} as spot
            from (select distinct normalized_query as norm from resolved_{what}s where status = 'not_supported' and shape = 'name' and normalized_query <> '') o
            join (select * from {what}_keys where kind = 'name') k on contains(k.key, o.norm) or contains(o.norm, k.key)
            join {what}s e on e.{what}_id = k.entity_id) group by norm, name)
        qualify place <= 5
    """


_resolution("disease")
_resolution("drug")

# --- damaged tables ------------------------------------------------------------------------
_KEYS = {
    "drug_targets": ("drug_id", "target_id", "drugs", ["target_name", "target_type", "uniprot_id", "action_type", "source"]),
    "drug_side_effects": ("drug_id", "side_effect_id", "drugs", ["side_effect_name", "umls_cui", "source"]),
    "disease_genes": ("disease_id", "gene_id", "diseases", ["gene_name", "ensembl_id", "association_score", "source"]),
    "disease_pathways": ("disease_id", "pathway_id", "diseases", ["pathway_name", "reactome_id", "gene_support_count", "association_score", "source"]),
}
for _t, (_fk, _key, _parent, _rest) in _KEYS.items():
    CTES[f"bad_{_t}"] = f"""
        select * from {_t} union all select * replace ('X' || {_fk} as {_fk}) from {_t} where right({_key}, 1) = '7'
        union all select * from {_t} where right({_key}, 1) = '3' union all select * replace (null as {_key}) from {_t} where right({_key}, 1) = '5'
        union all select * replace ('' as {_fk}) from {_t} where right({_key}, 1) = '9'
    """
_ALL = {"drugs": ["drug_id"], "diseases": ["disease_id"], **{t: [v[0], v[1]] for t, v in _KEYS.items()}}


def _src(t: str) -> str:
    return f"bad_{t}" if t in _KEYS else t


_Q1 = " union all ".join(
    f"select '{t}' as table_name, '{k}' as column_name, count(*) filter (where coalesce({k}, '') = '') as n_bad from {_src(t)}"
    for t, ks in _ALL.items() for k in ks
)
_Q2 = " union all ".join(
    f"select '{t}' as table_name, (select coalesce(sum(n - 1), 0) from (select count(*) as n from {_src(t)} group by {', '.join(ks)}))::bigint as n_duplicate"
    for t, ks in _ALL.items()
)
_Q3 = " union all ".join(
    f"select '{t}' as table_name, '{fk}' as column_name, '{p}' as parent, (select count(*) from bad_{t} b where not exists (select 1 from {p} e where e.{fk} = b.{fk})) as n_orphan"
    for t, (fk, _, p, _r) in _KEYS.items()
)
_COLS = {"drugs": ["drug_name", "canonical_identifier", "pubchem_cid", "chembl_id", "source"], "diseases": ["disease_name", "ontology_id", "source"], **{t: v[3] for t, v in _KEYS.items()}}
_Q4 = "select table_name, column_name, " + r.tidy("f", 6) + " as null_fraction from (" + " union all ".join(
    f"select '{t}' as table_name, '{c}' as column_name, avg(({c} is null)::int) as f from {_src(t)}" for t, cs in _COLS.items() for c in cs
) + ") where f >= 0.05"


def _checks(prefix: bool) -> str:
    src = _src if prefix else (lambda t: t)
    parts = [
        f"select '{t}: required ids populated' as check_name, 'error' as severity, sum(n) = 0 as passed, case when sum(n) = 0 then '' else 'nulls/empties: ' || sum(n)::bigint end as detail from ("
        + " union all ".join(f"select count(*) filter (where coalesce({k}, '') = '') as n from {src(t)}" for k in ks) + ")"
        for t, ks in _ALL.items()
    ]
    parts += [
        f"select '{t}: unique primary key', 'error', n = 0, case when n = 0 then '' else n || ' duplicate rows' end from (select coalesce(sum(c - 1), 0)::bigint as n from (select count(*) as c from {src(t)} group by {', '.join(ks)}))"
        for t, ks in _ALL.items()
    ]
    parts += [
        f"select '{t}.{fk} -> {p}', 'error', n = 0, case when n = 0 then '' else n || ' orphan rows' end from (select count(*) as n from {src(t)} b where not exists (select 1 from {p} e where e.{fk} = b.{fk}))"
        for t, (fk, _, p, _r) in _KEYS.items()
    ]
    parts += [
        f"select '{t}.{c}: missing-value level', 'warning', false, round(f * 100)::int || '% null' from (select avg(({c} is null)::int) as f from {src(t)}) where f >= 0.6"
        for t, cs in _COLS.items() for c in cs
    ]
    parts += [f"select '{t}: non-empty', 'warning', n > 0, case when n > 0 then '' else '0 rows' end from (select count(*) as n from {t})" for t in ("drugs", "diseases")]
    return " union all ".join(parts)


CTES["checks_stored"] = _checks(False)
CTES["checks_damaged"] = _checks(True)


def _verdict(which: str) -> str:
    hard = "not passed and severity = 'error'"
    return f"select count(*) filter (where {hard}) = 0 as ok, count(*) filter (where {hard}) as n_hard_failures, count(*) filter (where not passed) as n_failed, count(*) as n_checks, '{which}' as which from checks_{which}"


_IN_USE = {
    "diseases": ["disease_id", "disease_name"], "disease_genes": ["disease_id", "gene_id"], "disease_pathways": ["disease_id", "pathway_id", "pathway_name"],
    "drugs": ["drug_id", "drug_name"], "drug_side_effects": ["drug_id", "side_effect_id", "side_effect_name"], "drug_targets": ["drug_id", "target_id"],
}
for _t, _req in _IN_USE.items():
    _ok = " and ".join(f"{c} is not null" for c in _req) + f" and trim({_req[0]}) <> ''"
    CTES[f"usable_{_t}"] = f"select * from {_src(_t)} where {_ok}"
    CTES[f"distinct_{_t}"] = f"select distinct * from usable_{_t}"
    if _t in _KEYS:
        CTES[f"clean_{_t}"] = f"select * from distinct_{_t} c where exists (select 1 from distinct_{_KEYS[_t][2]} e where e.{_KEYS[_t][0]} = c.{_KEYS[_t][0]})"
    else:
        CTES[f"clean_{_t}"] = f"select * from distinct_{_t}"


def _n(t: str) -> str:
    return f"(select count(*) from {t})"


_E1 = " union all ".join(
    [f"select {_n(_src(t))} - {_n('usable_' + t)} as n, '{t}' as table_name, 'missing required id/name' as reason" for t in _IN_USE]
    + [f"select {_n('usable_' + t)} - {_n('distinct_' + t)}, '{t}', 'exact duplicate row'" for t in _IN_USE]
    + [f"select {_n('distinct_' + t)} - {_n('clean_' + t)}, '{t}', '{v[0]} not in {v[2]}'" for t, v in _KEYS.items()]
)

# --- dirty disease genes ---------------------------------------------------------------------
CTES["dirty_base"] = """
    select case when n % 10 = 1 then '' else disease_id end as disease_id, case when n % 20 = 2 then null else gene_id end as gene_id,
      case when n % 10 = 3 then '' else gene_name end as gene_name,
      case when n % 10 = 4 then association_score + 1 when n % 10 = 5 then null else association_score end as association_score,
      case when n % 30 = 6 then null else 'opentargets' end as source, disease_id || '|a|' || gene_id as seq, n
    from (select *, right(gene_id, 2)::int as n from disease_genes)
"""
CTES["dirty"] = """
    select nullif(disease_id, '') as disease_id, nullif(gene_id, '') as gene_id, nullif(gene_name, '') as gene_name, null::varchar as ensembl_id,
      association_score, source, seq from (
        select * from dirty_base union all select * replace ('z' || seq as seq, 'again' as gene_name) from dirty_base where n % 10 >= 7)
"""
CTES["dirty_tagged"] = """
    select *, case when disease_id is null or gene_id is null or source is null then 'missing_required_field'
      when association_score is not null and not (association_score between 0 and 1) then 'schema_violation' end as reason from dirty
"""
_DG = "disease_id, gene_id, gene_name, ensembl_id, association_score, source"

# --- responses -----------------------------------------------------------------------------------
CTES["responses"] = """
    select disease_id, drug_id, rank, repurposing_score, case when k = 0 then '[' || body || ']' else body end as response from (
      select *, '{"disease_id": ' || case when k = 2 then '"DIS:0"' else '"' || disease_id || '"' end || ', "drug_id": ' || case when k = 3 then '12' else '"' || drug_id || '"' end
        || ', "rank": ' || case k when 5 then 'null' when 6 then '"x"' when 7 then (rank + 1)::varchar when 8 then rank || '.7' when 9 then '" ' || rank || '"' else rank::varchar end
        || ', "repurposing_score": ' || case k when 10 then '"high"' when 11 then (repurposing_score + 0.04)::decimal(12,4)::varchar when 12 then (repurposing_score + 1)::decimal(12,4)::varchar else repurposing_score::decimal(12,4)::varchar end
        || case when k = 1 then '' else ', "summary": ' || case k when 13 then '"   "' when 14 then '7' when 17 then '"' || drug_id || ' will  treat it"' when 18 then '"see HGNC:999999999 and DRUG:1"'
             else '" plain words on ' || drug_id || ' and ' || coalesce(matched_gene_hgnc_ids[1], drug_id) || ' "' end end
        || ', "evidence_notes": ' || case k when 21 then '["a"]' when 22 then '""' when 4 then '{"ml": " model note ", "gene_target": 5, "pathway": " "}' else '{"gene_target": "gene note"}' end
        || ', "limitations": ' || case k when 15 then '"none"' when 16 then '["a", 3]' when 19 then '["  "]' when 20 then '["not proven"]' else '[" short list "]' end || '}' as body
      from (select *, (rank + right(drug_id, 4)::int) % 23 as k from top))
"""
_req = "[" + ", ".join(f"'{k}'" for k in RESPONSE_KEYS) + "]"
_numt = "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'DECIMAL')"
CTES["parsed"] = f"""
    select *, list_concat([summary], limits, notes) as texts from (
      select *, json_type(response) = 'OBJECT' as is_object, list_filter({_req}, lambda x: not list_contains(json_keys(response), x)) as missing,
        case when json_type(response, '$.rank') in {_numt} then trunc((response->>'$.rank')::double)::bigint
          when json_type(response, '$.rank') = 'VARCHAR' and regexp_full_match(trim(response->>'$.rank'), '[+-]?[0-9]+') then trim(response->>'$.rank')::bigint end as r_rank,
        case when json_type(response, '$.repurposing_score') in {_numt} then (response->>'$.repurposing_score')::double end as r_score,
        case when json_type(response, '$.summary') = 'VARCHAR' then response->>'$.summary' end as summary,
        json_type(response, '$.limitations') = 'ARRAY' and len(list_filter(coalesce(from_json(json_extract(response, '$.limitations'), '["json"]'), []), lambda x: json_type(x) <> 'VARCHAR')) = 0 as limits_ok,
        case when json_type(response, '$.limitations') = 'ARRAY' then coalesce(from_json(json_extract(response, '$.limitations'), '["varchar"]'), []) else [] end as limits,
        json_type(response, '$.evidence_notes') = 'OBJECT' or response->>'$.evidence_notes' = '' as notes_ok,
        list_filter([case when json_type(response, '$.evidence_notes.ml') = 'VARCHAR' then response->>'$.evidence_notes.ml' end,
          case when json_type(response, '$.evidence_notes.gene_target') = 'VARCHAR' then response->>'$.evidence_notes.gene_target' end,
          case when json_type(response, '$.evidence_notes.pathway') = 'VARCHAR' then response->>'$.evidence_notes.pathway' end], lambda x: x is not null) as notes
      from responses)
"""
CTES["judged"] = f"""
    select p.*, case when not is_object then 'response was not a JSON object'
      when len(missing) > 0 then 'response missing required keys: [''' || array_to_string(missing, ''', ''') || ''']'
      when response->>'$.disease_id' is distinct from disease_id then 'response disease_id does not match the input candidate'
      when response->>'$.drug_id' is distinct from drug_id then 'response drug_id does not match the input candidate'
      when r_rank is null then 'response rank was not an integer' when r_rank <> rank then 'response rank does not match the input candidate'
      when r_score is null then 'response repurposing_score was not a number'
      when abs(r_score - repurposing_score) > 0.05 then 'response repurposing_score does not match the input candidate'
      when coalesce(trim(summary), '') = '' then 'response summary was empty or not a string'
      when not limits_ok then 'response limitations was not a list of strings' when not notes_ok then 'response evidence_notes was not an object'
      when hit is not null then 'response used disallowed clinical-claim language: ''' || hit || ''''
      when stranger is not null then 'response referenced an identifier not present in the supplied evidence: ''' || stranger || '''' end as failure
    from (select q.*, list_filter(list_transform(texts, lambda x: {r.banned('x')}), lambda x: x is not null)[1] as hit,
        list_filter(flatten(list_transform(texts, lambda x: {r.mentions('x')})), lambda x: not list_contains(a.allowed, x))[1] as stranger
      from parsed q join allowed a using (disease_id, drug_id)) p
"""

# --- graph walks -----------------------------------------------------------------------------------
CTES["links"] = """
    select graph_id, 'descendant' as way, id as edge_id, source as a, target as b from edges
    union all select graph_id, 'ancestor', id, target, source from edges
"""
CTES["reached"] = """
    select graph_id, id as seed, w.way, id from nodes, (values ('descendant'), ('ancestor')) w(way) where type in ('disease', 'drug')
    union select r.graph_id, r.seed, r.way, l.b from reached r join links l on l.graph_id = r.graph_id and l.way = r.way and l.a = r.id
"""
_ORDER = "['disease','disease_gene','drug_target','pathway','drug','prediction','evidence_component','score','rank','explanation']"
CTES["steps"] = f"""
    select graph_id, type, row_number() over (partition by graph_id order by list_position({_ORDER}, type))::int as step from (select distinct graph_id, type from nodes)
"""
CTES["entered"] = "select n.graph_id, n.id, s.step from nodes n join steps s using (graph_id, type)"
CTES["visible"] = """
    select *, row_number() over (partition by graph_id, type order by relevance desc, at_rank, at_section, at_place, id) as row from (
      select *, case type when 'evidence_component' then coalesce(v3, v1) when 'pathway' then coalesce(v1, v2) else 0 end::double as relevance from nodes)
    qualify row <= 14
"""

# --- text tables --------------------------------------------------------------------------------------
CTES["all_texts"] = """
    select 'd' || doc_id as id, doc_id as n, text from documents union all select 'c-' || conv_id || '-' || turn, conv_id, text from conversations
"""


def _norm(kind: str, source: str, column: str, key: str, extra: str = "") -> str:
    return f"select *, case when {column}_key is null then 'no_{kind}_key:{column}' end as reject_reason from (select *, {key} as {column}_key from ({source}))"


def _cols(prefix: str, columns: list[str]) -> str:
    return f"select {prefix}, {', '.join(columns)} from features"


def _component(c: str) -> str:
    return f"select disease_id, drug_id, {c}_value is not null as available, {c}_value as value, {c}_effective_weight as effective_weight, {c}_points as contribution_points, {c}_reason as unavailable_reason from fused"


_MOUSE = "right(reactome_id, 1) = '3'"
_PAIRS = "disease_id, drug_id"
_PAYLOAD = "(select * from raw_diseases where seq % 9 < 7)"

FINAL: dict[str, str] = {
    # scans
    "s1_drug_names": "select stitch_id, drug_name from raw_drug_names where seq % 70 <> 0",
    "s2_preferred_side_effects": "select stitch_id, coalesce(umls_meddra, umls_label) as umls_cui, side_effect_name from raw_side_effects where meddra_type = 'PT'",
    "s3_pathway_names": f"select reactome_id, pathway_name from raw_pathway_names where not {_MOUSE}",
    "s4_gene_pathways": f"select ensembl_id, reactome_id, pathway_name, 'IEA' as evidence_code from raw_gene_pathways where length(pathway_name) % 2 = 1 and not {_MOUSE}",
    "s5_protein_pathways": f"select distinct uniprot, reactome_id, pathway_name from raw_gene_pathways where uniprot is not null and not {_MOUSE}",
    "s6_gene_bridge": "select 'ensembl_id' as kind, ensembl_id as key, hgnc_id as value from bridge_genes union all select 'uniprot_id', uniprot_id, hgnc_id from bridge_proteins union all select 'hgnc_id', hgnc_id, symbol from bridge_symbols",
    "s7_mechanisms": "select chembl_id, target_chembl_id, action_type, lower(action_type) || ' mechanism' as mechanism_of_action from raw_mechanisms where seq % 13 <> 0",
    "s8_targets": "select target_chembl_id, target_name, target_type, case when seq % 6 <> 5 then uniprot_id end as uniprot_id, case when seq % 6 <> 5 then 'SYM' || seq end as gene_symbol from raw_targets",
    "s9_compound_map": "select pubchem_cid, chembl_id from raw_chembl_map",
    "s9_first_synonym": """select s_suppkey::varchar as pubchem_cid, case when s_suppkey % 4 <> 0 then 'CHEMBL' || s_suppkey else 'CHEMBL9' || s_suppkey end as chembl_id from supplier where s_suppkey % 5 <> 0""",
    "s10_diseases": f"select ontology_id, disease_name from {_PAYLOAD}",
    "s11_disease_genes": f"select s.ontology_id, s.ensembl_id, s.gene_symbol, 'gene ' || s.gene_symbol as gene_full_name, s.association_score from raw_disease_genes s join {_PAYLOAD} p on s.ontology_id = p.ontology_id",
    "s12_unresolved_seeds": f"select distinct ontology_id from raw_seeds where upper(ontology_id) not in (select upper(ontology_id) from {_PAYLOAD})",
    "s13_seeds": "select distinct ontology_id from raw_seeds",
    "s14_aliases": "select alias, ontology from aliases",
    "s15_known_drugs": "select distinct ontology_id, chembl_id, 'PHASE' || length(chembl_id) % 4 as max_stage from raw_known_pairs",
    "s16_load_tables": " union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in [*_ALL, "identifiers"]),
    "s17_csv_copies": " union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in [*_ALL, "identifiers"]),
    "s18_run_report": "select check_name, severity, passed, detail from checks_stored",
    "s18_stages": """select t.position, t.stage, true as available, t.note, t.input_rows, t.output_rows, coalesce(x.n, 0)::bigint as n_rejected from (
          select 1 as position, 'build:drugs' as stage, '' as note, (select count(*) from drugs_all) as input_rows, (select count(*) from drugs) as output_rows
          union all select 2, 'build:drug_side_effects', '', (select count(*) from se_all), (select count(*) from drug_side_effects)
          union all select 3, 'build:diseases', coalesce((select 'seed ids not resolvable in Open Targets: ' || string_agg(ontology_id, ', ' order by seq, ontology_id) from (select ontology_id, min(seq) as seq from unresolved group by 1)), ''),
            (select count(*) from diseases), (select count(*) from diseases)
          union all select 4, 'build:disease_genes', '', (select count(*) from (select distinct disease_id, gene from gene_rows)), (select count(*) from disease_genes)
          union all select 5, 'build:drug_targets', '', (select count(*) from mech_rows where drug_id is not null and target_id is not null), (select count(*) from drug_targets)
          union all select 6, 'build:disease_pathways', (select 'DERIVED: Open Targets disease genes x Reactome gene->pathway | ' || count(*) || ' candidate (disease,pathway) pairs; ' || count(*) filter (where gene_support_count < 3) || ' dropped for < 3 supporting genes' from support),
            (select count(*) from pathway_rows), (select count(*) from disease_pathways)) t
        left join (select stage, sum(n) as n from rejects group by 1) x using (stage)""",
    "s18_counts": " union all ".join(f"select 'dataset' as kind, '{t}' as name, count(*) as n from {t}" for t in _ALL)
    + "".join(f" union all select 'entity', '{e}', count(*) from ids_{e}" for e in ("drug", "side_effect", "disease", "gene", "target", "pathway")),
    "s19_coverage": """select t.table_name, a.absent, not list_contains(t.needs, a.absent) as built, case when list_contains(t.needs, a.absent) then t.note else '' end as note,
        case when list_contains(t.needs, a.absent) then 0 else t.n end as n_rows from (values ('none'), ('sider'), ('chembl'), ('opentargets'), ('reactome')) a(absent) cross join (
          select 'drugs' as table_name, ['sider'] as needs, 'requires SIDER' as note, (select count(*) from drugs) as n
          union all select 'drug_side_effects', ['sider'], 'requires SIDER+drugs', (select count(*) from drug_side_effects)
          union all select 'diseases', ['opentargets'], 'requires Open Targets', (select count(*) from diseases)
          union all select 'disease_genes', ['opentargets'], 'requires Open Targets', (select count(*) from disease_genes)
          union all select 'drug_targets', ['chembl', 'sider'], 'requires ChEMBL+drugs', (select count(*) from drug_targets)
          union all select 'disease_pathways', ['reactome', 'opentargets'], 'requires Reactome + disease_genes', (select count(*) from disease_pathways)) t""",
    # rules
    "f1_name_keys": f"select id, length(k)::int as n_chars, md5(k) as key_md5 from (select id, {r.name_key('text')} as k from all_texts)",
    "f2_compound_ids": _norm("compound", "select stitch_id as value from raw_drug_names union all select ' 00' || pubchem_cid from raw_chembl_map", "value", r.compound("value")),
    "f3_ontology_ids": _norm("ontology", "select ' ' || ontology_id || chr(9) as value from raw_diseases union all select ontology_id from raw_aliases union all select query from raw_disease_queries", "value", r.ontology("value")),
    "f4_gene_ids": _norm("gene", "select ontology_id, case when right(gene_symbol, 1) = '4' then gene_symbol else ensembl_id end as gene from raw_disease_genes", "gene", r.gene("gene")),
    "f5_prefixed_ids": f"select a, b, a_key, b_key, case when a_key is null then 'no_chembl_key:a' when b_key is null then 'no_reactome_key:b' end as reject_reason from (select *, {r.chembl('a')} as a_key, {r.reactome('b')} as b_key from (select lower(target_chembl_id) as a, case when seq % 3 = 0 then ' r-hsa-' || seq else target_name end as b from raw_targets))",
    "f6_concept_ids": "select value, value_key, reject_reason, count(*) as n from ("
    + _norm("concept", "select case when seq % 11 = 0 then substr(umls_label, 1, 6) else umls_meddra end as value from raw_side_effects", "value", r.concept("value")) + ") group by all",
    "f7_protein_ids": _norm("protein", "select seq, case seq % 4 when 0 then 'a' || seq % 10 || 'bc1' || seq % 10 when 1 then 'B' || seq % 10 || 'XY1' || seq % 10 || 'Z2' || seq % 10 when 2 then 'x' || uniprot_id else uniprot_id end as value from raw_targets", "value", r.protein("value")),
    "f8_query_text": f"select *, {r.query_text('query')} as normalized from (select 'disease' as what, query_id, query from raw_disease_queries union all select 'drug', query_id, query from raw_drug_queries)",
    "f9_query_kinds": f"select 'disease' as what, query_id, {r.disease_kind('query')} as kind, null::varchar as cid, null::varchar as chembl from raw_disease_queries union all select 'drug', query_id, {r.drug_kind('query')}, {r.cid_query('query')}, {r.chembl_query('query')} from raw_drug_queries",
    "f10_clean_missing": "select c_custkey, case when c_custkey % 7 <> 0 then c_acctbal end as balance, case when c_custkey % 5 <> 0 then c_mktsegment end as segment from customer",
    "f11_safe_ratio": f"select l_partkey, n, d, {r.ratio('n', 'd')} as ratio from (select l_partkey, count(*) filter (where l_returnflag = 'R') as n, count(*) filter (where l_discount > 0.08) as d from lineitem group by 1)",
    "f12_clip": f"select c_custkey, {r.tidy(r.clip('v'), 9)} as clipped from (select c_custkey, case c_custkey % 9 when 0 then 'nan'::double when 1 then 'inf'::double when 2 then null else c_acctbal / 5000 end as v from customer)",
    "f13_saturating_count": f"select l_suppkey, l_linenumber, {r.tidy('least(n, 60) / 60', 6)} as count_norm, {r.tidy(r.clip('(0.5 * (least(n, 60) / 60) + 0.5 * ' + r.clip('(d * 10)') + ')'), 6)} as blend from (select l_suppkey, l_linenumber, count(*)::double as n, avg(l_discount) as d from lineitem group by 1, 2)",
    "f14_logistic": f"select c_custkey, {r.tidy('1 / (1 + exp(-(c_acctbal / 1000)))', 9)} as p from customer",
    "f15_direction": f"select c_custkey, {r.direction('v')} as direction from (select c_custkey, (c_custkey % 5 - 2) * 7e-7 as v from customer)",
    "f16_mechanism_phrases": f"select drug_id, target_id, case when act <> '' then act || ' of ' || what else 'acts on ' || what end as phrase from (select drug_id, target_id, lower({r.strip('coalesce(action_type, ' + chr(39) * 2 + ')')}) as act, coalesce(nullif(case when right(target_id, 1) = '3' then '' else target_name end, ''), target_id) as what from drug_targets)",
    "f17_graph_ids": "select graph_id, id as edge_id, source, target from edges",
    "f18_flat_features": " union all ".join(f"select {_PAIRS}, '{c}' as feature_name, {c}::double as feature_value from features" for c in [*MODEL_COLUMNS, "unique_target_count"])
    + "".join(f" union all select p.disease_id, p.drug_id, '{pre}__' || a.{c}, count(*)::double from pairs p join acted a using (drug_id) where a.{c} is not null group by 1, 2, 3" for c, pre in (("act", "action_type"), ("kind", "target_type"))),
    "f19_display": f"select {_PAIRS}, case when abs(repurposing_score * 4) % 2 = 1 then {r.fixed('ceil(repurposing_score * 10) / 10', 1)} else {r.fixed('repurposing_score', 1)} end as score, "
    f"case when ml_points is null then '—' when abs(ml_points * 4) % 2 = 1 then {r.fixed('ceil(ml_points * 10) / 10', 1)} else {r.fixed('ml_points', 1)} end as ml_points, "
    "case when gene_target_value is null then '—' else floor(gene_target_value * 100 + 0.5)::bigint || '%' end as gene_percent, "
    "case when pathway_value is null then 'Not assessable' when pathway_value > 0 then 'Supported by evidence' else 'Assessed — no overlap found' end as pathway_status, "
    "case when generated_by_pathway then 'Gene Target Pathway' else 'Gene Target' end as title from ranked",
    "f20_mentions": f"select id, len(m) as n_mentions, array_to_string(m, '|') as mentions from (select id, {r.mentions('text')} as m from (select id, text || case when n % 2 = 0 then ' HGNC:' || n || ', DRUG:00' || n || '; xTGT:1 R-HSA-' || n * 3 || ' GENE:7b GENE:' || n || '. DIS:' else '' end as text from all_texts union all select 'p' || page_id, html from pages))",
    "f21_banned_language": f"select id, phrase from (select id, {r.banned('text')} as phrase from (select id, text || case n % 8 when 0 then ' Will ' || chr(10) || ' TREAT this' when 1 then ' it is safely-made' when 2 then ' incurable, unsafe' when 3 then ' clinically   proven' when 4 then ' Guaranteed!' else '' end as text from all_texts)) where phrase is not null",
    # tables
    "b1_minted_ids": " union all ".join(f"select '{e}' as entity_type, key, internal_id from ids_{e}" for e in ("drug", "side_effect", "disease", "gene", "target", "pathway")),
    "b2_crosswalk": "select * from identifiers",
    "b3_lookup": f"select a.o as ontology_id, i.internal_id as disease_id from (select distinct {r.ontology('ontology_id')} as o from raw_aliases) a left join ids_disease i on a.o = i.key",
    "b3_entity_counts": " union all ".join(f"select '{e}' as entity_type, count(*) as n_ids from ids_{e}" for e in ("drug", "side_effect", "disease", "gene", "target", "pathway")),
    "b4_drugs": "select * from drugs",
    "b5_drug_side_effects": "select * from drug_side_effects",
    "b6_diseases": "select * from diseases",
    "b7_disease_genes": "select * from disease_genes",
    "b8_strongest_genes": "select ontology_id, ensembl_id, association_score, place from strongest",
    "b9_targets": "select * from targets",
    "b10_drug_targets": "select * from drug_targets",
    "b11_gene_pathway_edges": "select * from edges_gp",
    "b12_disease_pathways": "select * from disease_pathways",
    "b13_dropped_groups": "select count(*) as n_candidate_pairs, count(*) filter (where gene_support_count < 3) as n_dropped, count(*) filter (where gene_support_count >= 3) as n_kept from support",
    "b14_rejections": """select stage, reason, sum(n)::bigint as n_rejected, string_agg(example, ' ; ' order by p, example) filter (where place <= 5) as examples from (
        select *, row_number() over (partition by stage, reason order by p, example) as place from (
          select stage, reason, substr(coalesce(example, ''), 1, 200) as example, sum(n) as n,
            min(case when try_cast(seq as bigint) is null then '0' || seq else '1' || lpad(seq, 30, '0') end) as p from rejects group by 1, 2, 3)) group by 1, 2""",
    "b15_ingestion": """with landed_drugs as (select distinct cid from good_drugs where seq % 70 <> 0), landed_genes as (select * from gene_rows where ontology_id in (select ontology_id from raw_diseases where seq % 9 < 7)),
        landed_edges as (select distinct ensembl_id, reactome_id from raw_gene_pathways where length(pathway_name) % 2 = 1 and right(reactome_id, 1) <> '3')
        select 'drugs' as table_name, (select count(*) from landed_drugs) as n_rows
        union all select 'drug_side_effects', (select count(*) from (select distinct s.drug_id, s.cui from se_good s join ids_drug i on i.internal_id = s.drug_id where i.key in (select cid from landed_drugs)))
        union all select 'diseases', (select count(*) from raw_diseases where seq % 9 < 7)
        union all select 'disease_genes', (select count(*) from (select distinct disease_id, gene from landed_genes))
        union all select 'drug_targets', (select count(*) from (select distinct m.drug_id, m.target_id from mech_rows m join ids_drug i on i.internal_id = m.drug_id where m.target_id is not null and m.seq % 13 <> 0 and i.key in (select cid from landed_drugs)))
        union all select 'disease_pathways', (select count(*) from (select g.disease_id, e.reactome_id from landed_genes g join landed_edges e on e.ensembl_id = g.gene group by 1, 2 having count(distinct g.gene) >= 3))""",
    "v1_to_contract": f"select {_DG} from dirty",
    "v2_violations": "select seq, disease_id, gene_id, reason from dirty_tagged where reason is not null",
    "v3_conformed": f"select {_DG} from dirty_tagged where reason is null qualify row_number() over (partition by disease_id, gene_id order by seq) = 1",
    "v3_duplicate_keys": "select disease_id, gene_id, count(*) - 1 as surplus from dirty_tagged where reason is null group by 1, 2 having count(*) > 1",
    "q1_required_ids": _Q1,
    "q2_duplicate_rows": _Q2,
    "q3_orphans": _Q3,
    "q4_null_levels": _Q4,
    "q5_core_tables": "select 'drugs' as table_name, count(*) > 0 as non_empty from drugs union all select 'diseases', count(*) > 0 from diseases where source = 'nowhere'",
    "q6_verdict": f"{_verdict('stored')} union all {_verdict('damaged')}",
    "q7_recheck_stored": "select check_name, severity, passed, detail from checks_stored",
    # entities
    "e1_sanitize_issues": f"select * from ({_E1}) where n > 0",
    "e1_sanitized_counts": " union all ".join(f"select '{t}' as table_name, {_n('clean_' + t)} as n_rows" for t in _IN_USE),
    "e2_disease_keys": "select * from disease_keys",
    "e3_unresolved_aliases": "select alias, ontology from aliases where ontology not in (select key from disease_keys where kind = 'ontology')",
    "e4_drug_keys": "select * from drug_keys",
    "e5_resolve_diseases": "select * exclude (shape, text) from resolved_diseases",
    "e6_resolve_drugs": "select * exclude (shape, text) from resolved_drugs",
    "e6_ambiguous_drugs": "select q.query_id, h.match_type, h.key as matched_value, h.entity_id from raw_drug_queries q join drug_hits h on coalesce(q.query, '') = h.text where h.text in (select text from drug_hits group by text having count(*) > 1)",
    "e7_disease_suggestions": "select normalized_query, place::int as place, suggestion from disease_suggestions",
    "e7_drug_suggestions": "select normalized_query, place::int as place, suggestion from drug_suggestions",
    "e8_ordered_genes": "select disease_id, gene_id, gene_name, association_score, row_number() over (partition by disease_id order by association_score desc nulls last, gene_name nulls last, gene_id) as position from disease_genes",
    "e8_ordered_pathways": "select disease_id, pathway_id, gene_support_count, row_number() over (partition by disease_id order by gene_support_count desc nulls last, association_score desc nulls last, pathway_name nulls last, pathway_id) as position from disease_pathways",
    "e9_molecular_summary": f"""select d.disease_id, coalesce(g.n, 0) as gene_count, coalesce(p.n, 0) as pathway_count, g.mean as mean_gene_association_score, g.max as max_gene_association_score,
        coalesce(g.names, '') as top_gene_symbols, coalesce(p.names, '') as top_pathway_names, coalesce(g.n, 0) >= 200 as genes_truncated from diseases d
        left join (select disease_id, count(*) as n, {r.tidy('avg(association_score)', 6)} as mean, {r.tidy('max(association_score)', 6)} as max, string_agg(gene_name, '|' order by pos) filter (where pos <= 15 and gene_name <> '') as names
          from (select *, row_number() over (partition by disease_id order by association_score desc nulls last, gene_name nulls last, gene_id) as pos from disease_genes) group by 1) g using (disease_id)
        left join (select disease_id, count(*) as n, string_agg(pathway_name, '|' order by pos) filter (where pos <= 15) as names
          from (select *, row_number() over (partition by disease_id order by gene_support_count desc nulls last, association_score desc nulls last, pathway_name nulls last, pathway_id) as pos from disease_pathways) group by 1) p using (disease_id)""",
    "e10_disease_profiles": """select d.disease_id, d.disease_name, d.ontology_id, g.n::int as n_genes, p.n::int as n_pathways, g.first_gene, p.first_pathway, (select count(*) from identifiers i where i.internal_id = d.disease_id)::int as n_external, g.n >= 200 as genes_truncated
        from diseases d left join (select disease_id, count(*) as n, max(gene_name) filter (where pos = 1) as first_gene from (select *, row_number() over (partition by disease_id order by association_score desc nulls last, gene_name nulls last, gene_id) as pos from disease_genes) group by 1) g using (disease_id)
        left join (select disease_id, count(*) as n, max(pathway_name) filter (where pos = 1) as first_pathway from (select *, row_number() over (partition by disease_id order by gene_support_count desc nulls last, association_score desc nulls last, pathway_name nulls last, pathway_id) as pos from disease_pathways) group by 1) p using (disease_id)""",
    "e16_drug_profiles": """select d.drug_id, d.drug_name, coalesce(e.n, 0) as side_effect_count, coalesce(t.n, 0) as target_count, coalesce(t.u, 0) > 0 as pathway_context_available, coalesce(t.m, 0)::int as n_mechanisms, least(coalesce(p.n, 0), 100)::int as n_pathways, e.first_effect, t.first_mechanism
        from drugs d left join (select drug_id, count(*) as n, max(side_effect_name) filter (where pos = 1) as first_effect from (select *, row_number() over (partition by drug_id order by side_effect_name, side_effect_id) as pos from drug_side_effects) group by 1) e using (drug_id)
        left join (select drug_id, count(*) as n, count(distinct uniprot_id) as u, count(distinct target_id || '|' || coalesce(action_type, '')) as m, max(case when action_type is null then 'acts on ' else lower(action_type) || ' of ' end || coalesce(target_name, target_id)) filter (where pos = 1) as first_mechanism
          from (select *, row_number() over (partition by drug_id order by target_name nulls last, target_id) as pos from drug_targets) group by 1) t using (drug_id)
        left join (select drug_id, count(*) as n from drug_pathways group by 1) p using (drug_id)""",
    "e11_external_ids": "select internal_id as entity_id, external_id, external_source as source, is_primary, 'crosswalk' as origin from identifiers where entity_type in ('disease', 'drug') union all select disease_id, ontology_id, source, true, 'own' from diseases union all select drug_id, chembl_id, 'chembl', false, 'own' from drugs where chembl_id is not null union all select drug_id, pubchem_cid, 'pubchem', false, 'own' from drugs",
    "e12_ordered_side_effects": "select drug_id, side_effect_id, side_effect_name, row_number() over (partition by drug_id order by side_effect_name nulls last, side_effect_id) as position from drug_side_effects",
    "e12_ordered_targets": "select drug_id, target_id, target_name, row_number() over (partition by drug_id order by target_name nulls last, target_id) as position from drug_targets",
    "e13_mechanisms": f"select drug_id, target_id, target_name, action_type, case when coalesce(action_type, '') <> '' then lower({r.strip('action_type')}) || ' of ' else 'acts on ' end || coalesce(target_name, target_id) as description, source from drug_targets",
    "e14_drug_pathways": """select k.drug_id, k.reactome_id, k.pathway_name, k.supporting_target_count, k.position, string_agg(distinct d.uniprot_id, '|' order by d.uniprot_id) as supporting_uniprot_ids
        from (select *, row_number() over (partition by drug_id order by supporting_target_count desc, pathway_name, reactome_id) as position from drug_pathways qualify position <= 100) k
        join dpp d using (drug_id, reactome_id) group by all""",
    "e15_context_availability": """select d.drug_id, coalesce(t.n, 0) as n_proteins, case when run = 'missing' then 0 else coalesce(p.n, 0) end as n_pathways, run = 'given' and coalesce(t.n, 0) > 0 as pathway_context_available,
        case when run = 'disabled' then 'pathway enrichment disabled for this call' when coalesce(t.n, 0) = 0 then 'drug has no target with a UniProt accession'
          when run = 'missing' then 'Reactome enrichment unavailable: source not present' when coalesce(p.n, 0) = 0 then 'no human Reactome pathway maps to this drug''s target proteins' end as unavailable_reason, run
        from drugs d cross join (values ('given'), ('disabled'), ('missing')) v(run) left join (select drug_id, count(distinct uniprot_id) as n from drug_targets group by 1) t using (drug_id) left join (select drug_id, count(*) as n from drug_pathways group by 1) p using (drug_id)""",
    "e17_disease_summaries": """select disease_id, concat_ws(chr(10), 'Disease: ' || disease_name, 'Internal ID: ' || disease_id, 'Ontology ID: ' || ontology_id, '', 'Associated genes (' || ng || case when ng >= 200 then ', Level 1 cap reached' else '' end || '):',
          '  ' || coalesce(gs, '') || case when ng > 10 then ' ...' else '' end, '', 'Associated pathways (' || np || ', derived from disease genes x Reactome):', ps, case when np > 10 then '  ...' end, '', 'Evidence:',
          '  - disease-gene associations: Open Targets Platform association scores', '  - disease-pathway associations: DERIVED (Reactome gene->pathway; >= 3 supporting genes), not curated', '',
          'Note: ''associated with'' does not mean ''causes''. This profile is hypothesis-generating evidence, not a clinical or therapeutic claim.') as summary_text
        from (select d.*, coalesce(g.n, 0) as ng, coalesce(p.n, 0) as np, g.gs, p.ps from diseases d
          left join (select disease_id, count(*) as n, string_agg(coalesce(gene_name, gene_id), ', ' order by pos) filter (where pos <= 10) as gs from (select *, row_number() over (partition by disease_id order by association_score desc nulls last, gene_name nulls last, gene_id) as pos from disease_genes) group by 1) g using (disease_id)
          left join (select disease_id, count(*) as n, string_agg('  - ' || pathway_name || ' (n=' || gene_support_count || ')', chr(10) order by pos) filter (where pos <= 10) as ps from (select *, row_number() over (partition by disease_id order by gene_support_count desc nulls last, association_score desc nulls last, pathway_name nulls last, pathway_id) as pos from disease_pathways) group by 1) p using (disease_id))""",
    "e17_drug_summaries": """select drug_id, concat_ws(chr(10), 'Drug: ' || drug_name, 'Internal ID: ' || drug_id, 'ChEMBL ID: ' || chembl_id, 'PubChem CID: ' || pubchem_cid, '', 'Side effects (' || ne || ', SIDER):', '  ' || coalesce(es, '') || case when ne > 10 then ' ...' else '' end, '',
          case when nt > 0 then 'Targets (' || nt || ', ChEMBL mechanism of action):' else 'Targets: none in the SIDER∩ChEMBL mechanism-of-action intersection' end, ms, '',
          case when np > 0 then 'Target pathways (' || least(np, 100) || ', derived via Reactome):' else 'Target pathways: unavailable (' || case when nu = 0 then 'drug has no target with a UniProt accession' else 'no human Reactome pathway maps to this drug''s target proteins' end || ')' end, ps, '',
          'Provenance: SIDER -> side effects; ChEMBL -> targets/mechanisms; Reactome -> optional target pathways.',
          'Note: target and pathway annotations are mechanistic / annotation evidence only. They are not evidence of clinical benefit for any disease.') as summary_text
        from (select d.*, coalesce(e.n, 0) as ne, coalesce(t.n, 0) as nt, coalesce(t.u, 0) as nu, coalesce(p.n, 0) as np, e.es, t.ms, p.ps from drugs d
          left join (select drug_id, count(*) as n, string_agg(side_effect_name, ', ' order by pos) filter (where pos <= 10) as es from (select *, row_number() over (partition by drug_id order by side_effect_name, side_effect_id) as pos from drug_side_effects) group by 1) e using (drug_id)
          left join (select drug_id, count(*) as n, count(distinct uniprot_id) as u, string_agg('  - ' || case when action_type is null then 'acts on ' else lower(action_type) || ' of ' end || coalesce(target_name, target_id), chr(10) order by pos) filter (where pos <= 10) as ms from (select *, row_number() over (partition by drug_id order by target_name nulls last, target_id) as pos from drug_targets) group by 1) t using (drug_id)
          left join (select drug_id, count(*) as n, string_agg('  - ' || pathway_name || ' (targets=' || supporting_target_count || ')', chr(10) order by pos) filter (where pos <= 8) as ps from (select *, row_number() over (partition by drug_id order by supporting_target_count desc, pathway_name, reactome_id) as pos from drug_pathways) group by 1) p using (drug_id))""",
    # candidates
    "c1_bridge": "select disease_id, gene_id, ensembl_id, hgnc_id, gene_symbol from bridged_genes",
    "c2_bridged_targets": "select drug_id, target_id, uniprot_id, hgnc_id, action_type from bridged_targets",
    "c2_bridge_coverage": "select (select count(uniprot_id) from drug_targets) as target_rows, (select count(*) from bridged_targets) as target_rows_bridged",
    "c3_drug_pathways": "select * from drug_pathways",
    "c4_gene_target_matches": "select * exclude (association_score, disease_gene_name) from gene_matches",
    "c5_pathway_matches": "select * from pathway_matches",
    "c6_gene_route": "select distinct disease_id, drug_id from gene_matches",
    "c6_pathway_route": "select distinct disease_id, drug_id from pathway_matches",
    "c7_candidate_rollups": f"select {_PAIRS}, " + ", ".join(f"array_to_string({c}, '|') as {c}" for c in ("matched_gene_hgnc_ids", "matched_gene_symbols", "matched_disease_gene_ids", "matched_drug_target_ids", "matched_pathway_reactome_ids", "generation_methods")) + " from rollups",
    "c8_route_counts": """select d.disease_id, count(*) filter (where g) as gene_target, count(*) filter (where p) as pathway, count(*) filter (where g and not p) as gene_target_only,
        count(*) filter (where p and not g) as pathway_only, count(*) filter (where g and p) as both, count(x.drug_id) as candidates, (select count(*) from drugs) as universe
        from diseases d left join (select disease_id, drug_id, generated_by_gene_target as g, generated_by_pathway as p from features) x using (disease_id) group by 1""",
    "c9_route_degradation": "select 'gene_target' as route, false as available, 'bridge file not present' as unavailable_reason, 0::bigint as n_pairs union all select 'pathway', true, null, (select count(*) from (select distinct disease_id, drug_id from pathway_matches))",
    # features
    "g1_route_features": _cols(_PAIRS, MODEL_COLUMNS[:5]),
    "g2_gene_overlap": _cols(_PAIRS, MODEL_COLUMNS[5:12]),
    "g3_overlap_ratios": _cols(_PAIRS, [c for c in MODEL_COLUMNS if c.startswith("fraction_")]),
    "g4_pathway_overlap": _cols(_PAIRS, [*MODEL_COLUMNS[14:17], "drug_pathway_source"]),
    "g5_side_effect_burden": _cols(_PAIRS, ["side_effect_count", *MODEL_COLUMNS[26:]]),
    "g6_action_histograms": f"select drug_id, {', '.join(MODEL_COLUMNS[20:25])}, target_action_type_counts, target_type_counts from drug_dim",
    "g7_mechanism_count": "select drug_id, mechanism_count from drug_dim",
    "g8_missing_dimensions": "select disease_id, drug_id, 'drug' as missing from pairs where right(drug_id, 1) = '3'",
    "g9_feature_rows": _cols(_PAIRS, ["disease_name", "drug_name", *MODEL_COLUMNS, "unique_target_count"]),
    # model
    "m1_labels": "select disease_id, drug_id, chembl_id, label from training",
    "m2_training_summary": f"select count(*) as n_rows, sum(label)::bigint as n_positive, count(distinct disease_id) as n_diseases, {r.tidy('sum(label) / count(*)', 6)} as positive_prevalence from training",
    "m3_matrix": f"select {_PAIRS}, " + ", ".join(f"{num(c)} as {c}" for c in MODEL_COLUMNS) + " from features",
    "m4_standardized": f"select {_PAIRS}, i, {r.tidy('v', 6)} as z from (select {_PAIRS}, unnest([{', '.join(z(i) for i in range(len(MODEL_COLUMNS)))}]) as v, unnest(range(0, {len(MODEL_COLUMNS)})) as i from training f, stats)",
    "m5_class_weights": "select label, n, (sum(n) over ()) / (n * 2) as weight from (select label, count(*) as n from training group by 1)",
    "m8_grouped_folds": "select disease_id, fold from folds",
    "m9_fold_metrics": "select * from fold_metrics",
    "m10_cv_summary": "select * from cv",
    "m11_selected_model": "select model, pr_auc_mean, roc_auc_mean from cv order by coalesce(pr_auc_mean, -1) desc, coalesce(roc_auc_mean, -1) desc, list_position(['linear_7', 'linear_5'], model) limit 1",
    "m14_scores": f"select {_PAIRS}, model_output, baseline_output from linear_7",
    "m15_linear_attribution": f"select {_PAIRS}, i, {r.tidy('c', 6)} as contribution from (select {_PAIRS}, unnest(contributions) as c, unnest(range(0, {len(MODEL_COLUMNS)})) as i from linear_7)",
    "m17_top_features": "select * from top_features",
    "m18_global_importance": "select feature_name, row_number() over (order by importance desc, i) as place, importance, scale from ("
    + " union all ".join(f"select '{c}' as feature_name, {i} as i, {abs(v)}::double as importance, {r.tidy(f's{i}', 6)} as scale from stats" for i, (c, v) in enumerate(zip(MODEL_COLUMNS, rule_coefficients(7), strict=True))) + ")",
    # fusion and ranking
    "u1_gene_target_component": _component("gene_target"),
    "u2_pathway_component": _component("pathway"),
    "u3_model_component": _component("ml"),
    "u4_fused_score": f"select {_PAIRS}, repurposing_score, " + ", ".join(f"{c}_points" for c in COMPONENTS) + " from fused",
    "u4_score_without_model": f"select {_PAIRS}, repurposing_score, weights_renormalized from fused_plain",
    "u5_weighting_schemes": f"select scheme, {_PAIRS}, repurposing_score from fused_schemes",
    "u6_fused_rows": f"select {_PAIRS}, disease_name, drug_name, repurposing_score, model_output, baseline_output, array_to_string(top_feature_names, '|') as top_feature_names, scoring_version from fused",
    "u6_key_mismatches": "select disease_id, 'X' || drug_id as drug_id from predictions where right(drug_id, 1) = '5'",
    "u7_context_columns": f"select {_PAIRS}, side_effect_count, has_sider_evidence, drug_target_count, drug_pathway_count, mechanism_count from fused",
    "u8_availability": "select disease_id, count(gene_target_value) as n_with_gene_target, count(pathway_value) as n_with_pathway, count(ml_value) as n_with_ml, count(*) filter (where weights_renormalized) as n_renormalized, count(*) as n_pairs from fused group by 1",
    "r1_rank": f"select {_PAIRS}, rank, repurposing_score from ranked",
    "r2_top_n": f"select {_PAIRS}, rank, repurposing_score from ranked where rank <= 10",
    "r3_duplicate_pairs": "select disease_id, drug_id, 2::bigint as n from fused where right(drug_id, 1) = '4'",
    "r4_ranking_table": f"select rank, {_PAIRS}, drug_name, repurposing_score, gene_target_value, gene_target_points, pathway_value, pathway_points, ml_value, ml_points, concat_ws(',', case when generated_by_gene_target then 'gene_target' end, case when generated_by_pathway then 'pathway' end) as generation_methods from ranked",
    "r5_run_provenance": "select disease_id, count(*) as n_input, least(40, count(*)) as n_ranked, 40::bigint as top_n_requested, least(40, count(*)) as top_n_applied, '1.0' as scoring_version, '1.0' as ranking_version from fused group by 1",
    # narratives
    "n1_evidence_context": "select disease_id, drug_id, rank::varchar as p0, repurposing_score::varchar as p1, matched_gene_hgnc_ids[1] as p2, ml_reason as p3, model_output::varchar as p4 from top",
    "n2_evidence_status": f"select {_PAIRS}, " + ", ".join(f"{r.status(c + '_value')} as {c}_status" for c in COMPONENTS) + " from ranked",
    "n3_family_sentences": f"select {_PAIRS}, " + ", ".join(f"{c}_description" for c in COMPONENTS) + " from narratives",
    "n4_summaries": f"select {_PAIRS}, summary, limitations from narratives",
    "n5_allowed_ids": f"select {_PAIRS}, array_to_string(allowed, '|') as allowed from allowed",
    "n6_validated_responses": f"select {_PAIRS}, failure is null as accepted, failure from judged",
    "n7_merged_narratives": """select n.disease_id, n.drug_id, n.rank, n.repurposing_score, case when failure is null then trim(j.summary) else n.summary end as summary,
        case when failure is null and json_type(j.response, '$.evidence_notes.gene_target') = 'VARCHAR' then coalesce(nullif(trim(j.response->>'$.evidence_notes.gene_target'), ''), gene_target_description) else gene_target_description end as gene_target_description,
        case when failure is null and json_type(j.response, '$.evidence_notes.pathway') = 'VARCHAR' then coalesce(nullif(trim(j.response->>'$.evidence_notes.pathway'), ''), pathway_description) else pathway_description end as pathway_description,
        case when failure is null and json_type(j.response, '$.evidence_notes.ml') = 'VARCHAR' then coalesce(nullif(trim(j.response->>'$.evidence_notes.ml'), ''), ml_description) else ml_description end as ml_description,
        case when failure is null then coalesce(nullif(array_to_string(list_filter(list_transform(j.limits, lambda x: trim(x)), lambda x: x <> ''), ' | '), ''), n.limitations) else n.limitations end as limitations,
        case when failure is null then 'external' else 'deterministic_fallback' end as provider, 'ExplanationValidationError: ' || failure as fallback_reason
        from narratives n join judged j using (disease_id, drug_id)""",
    "n8_distinct_requests": "select distinct disease_id, drug_id, round(repurposing_score, 4) as score_key, scoring_version, '1.0' as ranking_version, 'external' as provider from top",
    # graph
    "k1_entity_nodes": "select graph_id, id, type, label from nodes where type in ('disease', 'drug')",
    "k2_gene_target_nodes": "select graph_id, id, type, label, a1 as hgnc_id, case when type = 'disease_gene' then a2 end as ensembl_id, case when type = 'disease_gene' then a3 else 'chembl' end as source, case when type = 'drug_target' then a2 end as uniprot_id, case when type = 'drug_target' then a3 end as action_type from nodes where type in ('disease_gene', 'drug_target')",
    "k2_gene_target_edges": "select graph_id, id as edge_id, source, target, type, provenance from edges where type in ('matched_to', 'has_target') or (type = 'associated_with' and starts_with(target, 'disease_gene'))",
    "k3_pathway_nodes": "select graph_id, id, type, label, v2::int::varchar as disease_gene_support_count, v1::int::varchar as drug_supporting_target_count from nodes where type = 'pathway'",
    "k3_pathway_edges": "select graph_id, id as edge_id, source, target, type, provenance from edges where type = 'participates_in' or (type = 'associated_with' and starts_with(target, 'pathway'))",
    "k4_evidence_nodes": "select graph_id, id, type, label, case when type = 'evidence_component' then v1 end as value, v2 as effective_weight, v3 as contribution_points, case when type = 'prediction' then a1 end as model_name, case when type = 'prediction' then v1 end as model_output from nodes where type in ('evidence_component', 'prediction')",
    "k5_outcome_nodes": "select graph_id, id, type, label, case when type = 'score' then v1 end as repurposing_score, case when type = 'rank' then v1 end as rank, case when type = 'explanation' then a1 end as provider from nodes where type in ('score', 'rank', 'explanation')",
    "k5_outcome_edges": "select graph_id, id as edge_id, type, provenance from edges where type in ('received', 'ranked', 'explained_by')",
    "k6_first_seen": "select graph_id, id, at_rank, at_section, at_place::bigint as at_place from nodes",
    "k7_graph_metadata": """select g.graph_id, n_candidates, includes_ml_evidence, n_nodes, node_type_counts, n_edges, edge_type_counts, true as includes_explanation
        from (select disease_id as graph_id, count(*) as n_candidates, count(ml_value) > 0 as includes_ml_evidence from g_top group by 1) g
        join (select graph_id, sum(n)::bigint as n_nodes, string_agg(type || '=' || n, '|' order by type) as node_type_counts from (select graph_id, type, count(*) as n from nodes group by 1, 2) group by 1) a using (graph_id)
        join (select graph_id, sum(n)::bigint as n_edges, string_agg(type || '=' || n, '|' order by type) as edge_type_counts from (select graph_id, type, count(*) as n from edges group by 1, 2) group by 1) b using (graph_id)""",
    "k8_unmatched_ranks": "select disease_id, 'X' || drug_id as drug_id from ranked where right(drug_id, 1) = '6'",
    "k9_graph_sizes": "select graph_id, (select count(*) from nodes n where n.graph_id = g.graph_id) as n_nodes, (select count(*) from edges e where e.graph_id = g.graph_id) as n_edges from (select distinct graph_id from nodes) g",
    "k10_node_degrees": "select n.graph_id, n.id, n.type, coalesce(a.c, 0) as n_from, coalesce(b.c, 0) as n_to, coalesce(a.c, 0) + coalesce(b.c, 0) as n_touching from nodes n left join (select graph_id, source as id, count(*) as c from edges group by 1, 2) a using (graph_id, id) left join (select graph_id, target as id, count(*) as c from edges group by 1, 2) b using (graph_id, id)",
    "k10_edges_touching": "select e.graph_id, e.source as node_id, 'from' as way, e.id as edge_id, e.type from edges e join nodes n on n.graph_id = e.graph_id and n.id = e.source where n.type = 'drug_target' union all select e.graph_id, e.target, 'to', e.id, e.type from edges e join nodes n on n.graph_id = e.graph_id and n.id = e.target where n.type = 'drug_target'",
    "k11_target_joins": "select e.graph_id, e.source as gene_node_id, g.label as gene_symbol, replace(g.id, 'disease_gene:', '') as gene_id, g.a2 as ensembl_id, g.a3 as gene_source, e.target as target_node_id, t.label as target_name, replace(t.id, 'drug_target:', '') as target_id, t.a2 as uniprot_id, t.a3 as action_type, e.hgnc_id, e.provenance from edges e join nodes g on g.graph_id = e.graph_id and g.id = e.source join nodes t on t.graph_id = e.graph_id and t.id = e.target where e.type = 'matched_to'",
    "k12_shared_pathways": "select n.graph_id, n.id as node_id, n.label as name, n.a1 as reactome_id, coalesce(string_agg(distinct e.provenance, '|'), '') as provenances from nodes n left join edges e on e.graph_id = n.graph_id and e.target = n.id and e.type = 'participates_in' where n.type = 'pathway' group by 1, 2, 3, 4",
    "k13_reachable_nodes": "select graph_id, seed, way, id from reached where id <> seed",
    "k13_walked_edges": "select distinct r.graph_id, r.seed, r.way, l.edge_id from reached r join links l on l.graph_id = r.graph_id and l.way = r.way and l.a = r.id",
    "k14_trace_steps": """select s.graph_id, s.step, s.type, (select count(*) from entered e where e.graph_id = s.graph_id and e.step <= s.step) as n_nodes,
        (select count(*) from edges e join entered a on a.graph_id = e.graph_id and a.id = e.source join entered b on b.graph_id = e.graph_id and b.id = e.target where e.graph_id = s.graph_id and greatest(a.step, b.step) <= s.step) as n_edges from steps s""",
    "k14_step_subgraph": "select graph_id, id, 'node' as what from entered where step <= 4 union all select e.graph_id, e.id, 'edge' from edges e join entered a on a.graph_id = e.graph_id and a.id = e.source join entered b on b.graph_id = e.graph_id and b.id = e.target where a.step <= 4 and b.step <= 4",
    "k15_visible_nodes": "select graph_id, id, type, row, relevance from visible",
    "k15_visible_edges": "select e.graph_id, e.id as edge_id from edges e join visible a on a.graph_id = e.graph_id and a.id = e.source join visible b on b.graph_id = e.graph_id and b.id = e.target",
    "k15_overflow": "select graph_id, type, count(*) as n_nodes, greatest(count(*) - 14, 0) as overflow_count from nodes group by 1, 2",
    "k16_dangling_edges": "select e.graph_id, e.id as edge_id, e.source as id from edges e where right(e.source, 1) = '5' union all select e.graph_id, e.id, e.target from edges e where right(e.target, 1) = '5'",
    # reports
    "p1_disease_runs": "select q.query_id, q.status, q.match_id as disease_id, r.rank, r.drug_id, r.drug_name, r.repurposing_score from resolved_diseases q left join (select * from ranked where rank <= 10) r on r.disease_id = q.match_id",
    "p2_overview": """select d.disease_id, (select count(*) from disease_genes g where g.disease_id = d.disease_id) as gene_count, (select count(*) from disease_pathways g where g.disease_id = d.disease_id) as pathway_count,
        (select count(*) from disease_genes g where g.disease_id = d.disease_id) >= 200 as genes_truncated, count(*) filter (where generated_by_gene_target) as gene_target, count(*) filter (where generated_by_pathway) as pathway,
        count(*) filter (where generated_by_gene_target and not generated_by_pathway) as gene_target_only, count(*) filter (where generated_by_pathway and not generated_by_gene_target) as pathway_only,
        count(*) filter (where generated_by_gene_target and generated_by_pathway) as both, count(drug_id) as candidates, (select count(*) from drugs) as universe, count(*) filter (where rank <= 10) as candidates_ranked,
        count(gene_target_value) filter (where rank <= 10) as n_with_gene_target_evidence, count(pathway_value) filter (where rank <= 10) as n_with_pathway_evidence, count(ml_value) filter (where rank <= 10) as n_with_ml_evidence
        from diseases d left join ranked r using (disease_id) group by 1""",
    "p3_found_pairs": "select disease_id, drug_id, case when rank <= 10 then rank end as rank, case when rank <= 10 then repurposing_score end as repurposing_score, rank <= 10 as found from ranked",
    "p4_predictions": "select q.query_id, t.disease_id, t.drug_id, t.place::int as place, t.feature_name, t.contribution from resolved_diseases q join top_features t on t.disease_id = q.match_id where q.status = 'resolved'",
    "p4_explanations": "select q.query_id, n.disease_id, n.drug_id, n.rank, n.summary from resolved_diseases q join narratives n on n.disease_id = q.match_id where q.status = 'resolved'",
}

_WORD = re.compile(r"[a-z_][a-z_0-9]*")


def _needed(text: str, seen: dict[str, None]) -> None:
    """Depth-first over the referenced expressions, so that each comes after what it reads."""
    for name in dict.fromkeys(_WORD.findall(text)):
        if name in CTES and name not in seen and name not in _OPEN:
            _OPEN.add(name)
            _needed(CTES[name], seen)
            _OPEN.discard(name)
            seen[name] = None


_OPEN: set[str] = set()
# written once, so that what joins them knows their sizes
_READ_OFTEN, _KEPT = {"nodes", "edges"}, "materialized "


def sql(name: str) -> str:
    seen: dict[str, None] = {}
    _needed(FINAL[name], seen)
    parts = ",\n".join(f"{n} as {_KEPT if n in _READ_OFTEN else ''}({CTES[n].strip()})" for n in seen)
    body = FINAL[name].strip()
    if body.startswith("with "):
        return f"with recursive {parts},\n{body.removeprefix('with ')}"
    return (f"with recursive {parts}\n" if parts else "") + body


# facts about fitted models that hold whatever the fit is
_PUBLISHED = "(select disease_id, count(*) as n, least(count(*), 10) as shown from features group by 1)"
_METHODS = {
    "gene_target": ("value = 0.5*min(matched_gene_target_count, 5)/5 + 0.5*fraction_of_drug_targets_matching_disease_genes",
                    "Level 4 gene-target route (HGNC id join) + Level 5 overlap features"),
    "pathway": ("value = 0.5*min(matched_pathway_count, 10)/10 + 0.5*fraction_of_drug_pathways_matching_disease_pathways",
                "Level 2 disease pathways (derived:opentargets+reactome) ∩ Level 3 drug pathways (derived:chembl-targets+reactome) — direct Reactome id intersection"),
    "ml": ("value = PredictionResult.model_output (already a [0,1] model output)",
           "Level 6 ML prediction (GroupKFold-validated classifier over Level 5 features)"),
}
FINAL |= {
    "m7_forest_facts": "select 400::bigint as n_trees, 0::bigint as n_small_leaves, 0::bigint as n_foreign_splits, 0::bigint as n_outside, 0::bigint as n_deep",
    "m11_learned_checks": "select 2::bigint as n_models, 1::bigint as n_chosen, 0::bigint as n_better",
    "m13_record_checks": "select (select count(*) from features) as n_rows, 0::bigint as n_different, count(*) as n_training_rows, sum(label)::bigint as n_positive, round(avg(label), 6) as prevalence, 2 as n_validated, 31 as n_columns, 42 as seed, true as chosen_is_stored from training",
    "m18_learned_checks": "select 31::bigint as n_places, 31::bigint as n_columns, 0::bigint as n_out_of_order",
    "r2_learned_checks": f"select disease_id, n as n_pairs, shown as n_published, shown as last_rank, 0::bigint as n_out_of_order, 0::bigint as n_unbalanced, shown as n_with_model from {_PUBLISHED}",
    "p1_learned_checks": f"select query_id, status, greatest(coalesce(shown, 0), 1) as n_rows, coalesce(shown, 0) as n_ranked, shown as last_rank from resolved_diseases q left join {_PUBLISHED} p on p.disease_id = q.match_id",
    "p2_learned_checks": f"select d.disease_id, coalesce(shown, 0) as candidates_ranked, coalesce(shown, 0) as n_with_ml_evidence from diseases d left join {_PUBLISHED} p on p.disease_id = d.disease_id",
    "p4_learned_checks": f"select query_id, 6 * n as n_rows, 0::bigint as n_out_of_order, 0::bigint as n_wrong_direction from resolved_diseases q join {_PUBLISHED} p on p.disease_id = q.match_id where status = 'resolved'",
    "e10_provenance": f"""select d.disease_id, d.source as disease_source, 'diseases,disease_genes,disease_pathways,identifiers' as datasets_used, 'opentargets' as gene_source,
        200 as genes_capped_per_disease, coalesce(g.n, 0) >= 200 as genes_truncated, 'derived:opentargets+reactome' as pathway_source, 3 as pathway_min_gene_support, '{SNAPSHOT}' as snapshot_note
        from diseases d left join (select disease_id, count(*) as n from disease_genes group by 1) g using (disease_id)""",
    "e16_provenance": """select d.drug_id, coalesce(p.names, '') as proteins, case when p.names <> '' then 'reactome (UniProt2Reactome, human)' else 'not integrated' end as pathway_source,
        'drugs,drug_side_effects,drug_targets,identifiers' as datasets_used, case when p.names <> '' then 'reactome' else '' end as optional_sources_used,
        case when p.names <> '' then null else 'drug has no target with a UniProt accession' end as reactome_skipped
        from drugs d left join (select drug_id, string_agg(uniprot_id, '|' order by pos) as names from (
          select drug_id, uniprot_id, min(pos) as pos from (select *, row_number() over (partition by drug_id order by target_name nulls last, target_id) as pos from drug_targets) where coalesce(uniprot_id, '') <> '' group by 1, 2) group by 1) p using (drug_id)""",
    "k4_methods": "select graph_id, id, case split_part(id, ':', -1) " + " ".join(f"when '{c}' then '{m}'" for c, (m, _) in _METHODS.items())
    + " end as calculation_method, case split_part(id, ':', -1) " + " ".join(f"when '{c}' then '{p}'" for c, (_, p) in _METHODS.items())
    + " end as provenance from nodes where type = 'evidence_component'",
    "m6_checks": "select count(*) as n_rows, sum(label)::bigint as n_positive, 0::bigint as n_outside, true as at_optimum from training",
    "m7_checks": "select count(*) as n_rows, sum(label)::bigint as n_positive, 0::bigint as n_outside from training",
    "m12_checks": "select m as model, count(*) as n_rows, 0::bigint as n_repeated from training, (values ('logistic_regression'), ('random_forest')) v(m) group by m",
    "m13_checks": "select count(*) as n_rows, 0::bigint as n_different from features",
    "m14_learned_checks": "select count(*) as n_rows, 0::bigint as n_outside, 0::bigint as n_unexplained from features",
    "m16_checks": "select count(*) as n_rows, 0::bigint as n_unexplained from features",
}


def all_sql() -> dict[str, str]:
    return {name: sql(name) for name in FINAL}
