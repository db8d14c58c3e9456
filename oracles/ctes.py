"""Named common table expressions shared by the SQL twins."""

from __future__ import annotations

from oracles import rules as r
from tessera.constants import MODEL_COLUMNS
from tessera.plans.study import rule_coefficients
from tessera.sources.given import RAW, TABLES

CTES: dict[str, str] = {}

for _name, _text in RAW.items():
    for _t in [*TABLES, *RAW]:
        _text = _text.replace("{" + _t + "}", _t)
    CTES[_name] = _text


def mint(prefix: str, source: str, key: str) -> str:
    return (
        f"select {key} as key, '{prefix}:' || printf('%06d', row_number() over (order by min(seq), {key})) as internal_id"
        f" from {source} group by {key}"
    )


CTES["drug_rows"] = f"""
    select *, case when cid is null then 'unmappable_pubchem_cid' when drug_name is null then 'missing_name' end as reason
    from (select seq, stitch_id, {r.compound('stitch_id')} as cid, {r.name_key('drug_name')} as drug_name from raw_drug_names)
"""
CTES["good_drugs"] = "select * from drug_rows where reason is null"
CTES["ids_drug"] = mint("DRUG", "good_drugs", "cid")
CTES["cmap"] = f"""
    select cid, arg_min(mol, seq) filter (mol is not null) as chembl_id from (select seq, {r.compound('pubchem_cid')} as cid, {r.chembl('chembl_id')} as mol from raw_chembl_map)
    where cid is not null and mol is not null group by cid
"""
CTES["drugs_all"] = """
    select g.seq, g.cid, i.internal_id as drug_id, g.drug_name, coalesce(m.chembl_id, 'CID:' || g.cid) as canonical_identifier,
      g.cid as pubchem_cid, m.chembl_id, 'sider' as source
    from good_drugs g join ids_drug i on g.cid = i.key left join cmap m on g.cid = m.cid
"""
CTES["drugs"] = """
    select drug_id, drug_name, canonical_identifier, pubchem_cid, chembl_id, source from drugs_all
    qualify row_number() over (partition by drug_id order by seq) = 1
"""
# side effects
CTES["se_rows"] = f"""
    select s.seq, s.stitch_id, s.raw_cui, s.cui, s.name, i.internal_id as drug_id from (
      select seq, stitch_id, {r.compound('stitch_id')} as cid, coalesce(umls_meddra, umls_label) as raw_cui,
        {r.concept('coalesce(umls_meddra, umls_label)')} as cui, {r.name_key('side_effect_name')} as name
      from raw_side_effects where meddra_type = 'PT') s
    left join ids_drug i on s.cid = i.key
"""
CTES["se_good"] = "select * from se_rows where drug_id is not null and cui is not null and name is not null"
CTES["ids_side_effect"] = mint("SE", "se_good", "cui")
CTES["se_all"] = "select g.*, i.internal_id as side_effect_id from se_good g join ids_side_effect i on g.cui = i.key"
CTES["drug_side_effects"] = """
    select drug_id, side_effect_id, name as side_effect_name, cui as umls_cui, 'sider' as source from se_all
    qualify row_number() over (partition by drug_id, side_effect_id order by seq, name) = 1
"""
# diseases and genes
CTES["disease_rows"] = f"""
    select seq, {r.ontology('ontology_id')} as ontology_id, {r.name_key('disease_name')} as disease_name from raw_diseases
"""
CTES["ids_disease"] = mint("DIS", "disease_rows", "ontology_id")
CTES["diseases"] = """
    select i.internal_id as disease_id, d.disease_name, d.ontology_id, 'opentargets' as source
    from disease_rows d join ids_disease i on d.ontology_id = i.key
"""
CTES["unresolved"] = f"""
    select seq, ontology_id from raw_seeds
    where {r.ontology('ontology_id')} not in (select {r.ontology('ontology_id')} from raw_diseases)
"""
CTES["strongest"] = f"""
    select *, row_number() over (partition by onto order by association_score desc nulls last, gene, ensembl_id) as place
    from (select *, {r.ontology('ontology_id')} as onto, {r.gene('ensembl_id')} as gene from raw_disease_genes)
    qualify place <= 200
"""
CTES["gene_rows"] = f"""
    select s.*, i.internal_id as disease_id
    from (select *, {r.ontology('ontology_id')} as onto, {r.gene('ensembl_id')} as gene from raw_disease_genes) s
    join ids_disease i on s.onto = i.key where s.gene is not null
"""
CTES["ids_gene"] = mint("GENE", "gene_rows", "gene")
CTES["disease_genes"] = """
    select g.disease_id, i.internal_id as gene_id, nullif(g.gene_symbol, '') as gene_name, g.gene as ensembl_id,
      g.association_score, 'opentargets' as source
    from gene_rows g join ids_gene i on g.gene = i.key
    qualify row_number() over (partition by g.disease_id, i.internal_id order by g.association_score desc nulls last, g.seq) = 1
"""
# targets
CTES["target_rows"] = f"""
    select * from (select seq, {r.chembl('target_chembl_id')} as tcid, nullif(target_name, '') as target_name,
      nullif(target_type, '') as target_type, {r.protein('uniprot_id')} as uniprot_id from raw_targets) where tcid is not null
"""
CTES["ids_target"] = mint("TGT", "target_rows", "tcid")
CTES["targets"] = """
    select t.tcid, i.internal_id as target_id, t.target_name, t.target_type, t.uniprot_id
    from target_rows t join ids_target i on t.tcid = i.key
    qualify row_number() over (partition by t.tcid order by t.seq desc) = 1
"""
CTES["claims"] = "select chembl_id as mol, arg_min(drug_id, seq) as drug_id from drugs_all where chembl_id is not null group by chembl_id"
CTES["mech_rows"] = f"""
    select m.*, c.drug_id, t.target_id, t.target_name, t.target_type, t.uniprot_id from (
      select seq, chembl_id as raw_mol, target_chembl_id as raw_target, {r.chembl('chembl_id')} as mol,
        {r.chembl('target_chembl_id')} as tcid, nullif(action_type, '') as action_type from raw_mechanisms) m
    left join claims c on m.mol = c.mol left join targets t on m.tcid = t.tcid
"""
CTES["drug_targets"] = """
    select drug_id, target_id, target_name, target_type, uniprot_id, action_type, 'chembl' as source
    from mech_rows where drug_id is not null and target_id is not null
    qualify row_number() over (partition by drug_id, target_id order by seq, action_type nulls first) = 1
"""
# pathways
CTES["edges_gp"] = f"""
    select distinct ensembl_id, reactome_id from (select {r.gene('ensembl_id')} as ensembl_id, {r.reactome('reactome_id')} as reactome_id from raw_gene_pathways)
    where ensembl_id is not null and reactome_id is not null
"""
CTES["support"] = f"""
    select g.disease_id, e.reactome_id, count(distinct g.ensembl_id)::int as gene_support_count,
      {r.tidy('avg(g.association_score)', 6)} as association_score
    from disease_genes g join edges_gp e on g.ensembl_id = e.ensembl_id group by all
"""
CTES["pathway_rows"] = "select *, disease_id || '|' || reactome_id as seq from support where gene_support_count >= 3"
CTES["ids_pathway"] = mint("PATH", "pathway_rows", "reactome_id")
CTES["disease_pathways"] = """
    select p.disease_id, i.internal_id as pathway_id, coalesce(n.pathway_name, 'unknown pathway') as pathway_name, p.reactome_id,
      p.gene_support_count, p.association_score, 'derived:opentargets+reactome' as source
    from pathway_rows p join ids_pathway i on p.reactome_id = i.key left join (select reactome_id, arg_max(pathway_name, seq) as pathway_name from raw_pathway_names group by 1) n on p.reactome_id = n.reactome_id
"""
# crosswalk
CTES["xrefs"] = f"""
    select 'drug' as entity_type, drug_id as internal_id, cid as external_id, 'sider' as external_source, drug_name as name, true as is_primary, seq::varchar as seq from drugs_all
    union all select 'drug', drug_id, 'CID:' || cid, 'pubchem', drug_name, false, seq::varchar from drugs_all
    union all select 'drug', drug_id, chembl_id, 'chembl', null, false, seq::varchar from drugs_all
    union all select 'side_effect', side_effect_id, cui, 'sider', name, true, seq::varchar from se_all
    union all select 'disease', i.internal_id, ontology_id, 'opentargets', disease_name, true, seq::varchar from disease_rows d join ids_disease i on d.ontology_id = i.key
    union all select 'gene', i.internal_id, gene, 'opentargets', {r.name_key('gene_symbol')}, true, seq from gene_rows g join ids_gene i on g.gene = i.key
    union all select 'target', i.internal_id, tcid, 'chembl', target_name, true, seq::varchar from target_rows t join ids_target i on t.tcid = i.key
    union all select 'target', i.internal_id, uniprot_id, 'uniprot', null, false, seq::varchar from target_rows t join ids_target i on t.tcid = i.key
    union all select 'pathway', p.pathway_id, p.reactome_id, 'reactome', p.pathway_name, true, p.disease_id || '|' || p.reactome_id from disease_pathways p
"""
CTES["identifiers"] = """
    select internal_id, entity_type, external_id, external_source,
      first(name order by try_cast(seq as bigint) nulls first, seq, name) filter (where coalesce(name, '') <> '') as name, bool_or(is_primary) as is_primary
    from xrefs where coalesce(external_id, '') <> '' group by internal_id, entity_type, external_id, external_source
"""


def _pair(a: str, b: str) -> str:
    return f"""'{{"{a}":"' || {a} || '","{b}":"' || {b} || '"}}'"""


CTES["rejects"] = f"""
    select 'build:drugs' as stage, reason, stitch_id as example, 1 as n, seq::varchar as seq from drug_rows where reason is not null
    union all select 'build:drugs', 'duplicate_primary_key', '{{"drug_id":"' || drug_id || '"}}', count(*) - 1, min(seq)::varchar from drugs_all group by drug_id having count(*) > 1
    union all select 'build:drug_side_effects', case when drug_id is null then 'drug_not_in_drugs' when cui is null then 'unmappable_umls_cui' else 'missing_side_effect_name' end,
      case when drug_id is null then stitch_id when cui is null then raw_cui else cui end, 1, seq::varchar from se_rows where drug_id is null or cui is null or name is null
    union all select 'build:drug_side_effects', 'duplicate_primary_key', {_pair('drug_id', 'side_effect_id')}, count(*) - 1, min(seq)::varchar from se_all group by drug_id, side_effect_id having count(*) > 1
    union all select 'build:diseases', 'seed_id_unresolved', ontology_id, 1, seq::varchar from unresolved
    union all select 'build:drug_targets', case when drug_id is null then 'drug_not_in_drugs' else 'target_details_unavailable' end,
      case when drug_id is null then raw_mol else raw_target end, 1, seq::varchar from mech_rows where drug_id is null or target_id is null
    union all select 'build:drug_targets', 'duplicate_primary_key', {_pair('drug_id', 'target_id')}, count(*) - 1, min(seq)::varchar from mech_rows where drug_id is not null and target_id is not null group by drug_id, target_id having count(*) > 1
    union all select 'build:disease_pathways', 'below_min_gene_support', {_pair('disease_id', 'reactome_id')}, 1, disease_id || '|' || reactome_id from support where gene_support_count < 3
"""
# links
CTES["bridge_rows"] = "select * from raw_gene_bridge where coalesce(hgnc_id, '') <> ''"
CTES["bridge_genes"] = """
    select upper(trim(ensembl_gene_id)) as ensembl_id, arg_min(hgnc_id, seq) as hgnc_id from bridge_rows
    where starts_with(ensembl_gene_id, 'ENSG') group by 1
"""
CTES["bridge_proteins"] = """
    select uniprot_id, arg_min(hgnc_id, seq) as hgnc_id from (select seq, hgnc_id, upper(trim(unnest(string_split(uniprot_ids, '|')))) as uniprot_id from bridge_rows)
    where uniprot_id <> '' group by 1
"""
CTES["bridge_symbols"] = "select hgnc_id, arg_max(symbol, seq) as symbol from bridge_rows where coalesce(symbol, '') <> '' group by 1"
CTES["bridged_genes"] = """
    select g.*, b.hgnc_id, coalesce(s.symbol, g.gene_name) as gene_symbol from disease_genes g
    join bridge_genes b on g.ensembl_id = b.ensembl_id left join bridge_symbols s on b.hgnc_id = s.hgnc_id
"""
CTES["bridged_targets"] = "select t.*, b.hgnc_id from drug_targets t join bridge_proteins b on upper(trim(t.uniprot_id)) = b.uniprot_id"
CTES["protein_pathways"] = """
    select distinct upper(trim(uniprot)) as uniprot_id, trim(reactome_id) as reactome_id, pathway_name from raw_gene_pathways
    where uniprot is not null and reactome_id is not null
"""
CTES["dpp"] = """
    select d.drug_id, d.uniprot_id, p.reactome_id, p.pathway_name
    from (select distinct drug_id, uniprot_id from drug_targets where uniprot_id is not null) d
    join protein_pathways p on upper(d.uniprot_id) = p.uniprot_id
"""
CTES["drug_pathways"] = """
    select drug_id, reactome_id, min(pathway_name) as pathway_name, count(*)::int as supporting_target_count from dpp group by 1, 2
"""
CTES["gene_matches"] = """
    select g.disease_id, t.drug_id, g.hgnc_id, g.gene_symbol, g.gene_id as disease_gene_id, g.ensembl_id as disease_gene_ensembl_id,
      g.source as disease_gene_source, t.target_id as drug_target_id, t.target_name as drug_target_name, t.uniprot_id as drug_target_uniprot_id,
      t.action_type as drug_action_type, t.source as drug_target_source, g.association_score, g.gene_name as disease_gene_name
    from bridged_genes g join bridged_targets t on g.hgnc_id = t.hgnc_id
"""
CTES["pathway_matches"] = """
    select d.disease_id, p.drug_id, d.reactome_id, d.pathway_id as disease_pathway_id, d.source as disease_pathway_source,
      d.gene_support_count as disease_gene_support_count, p.supporting_target_count as drug_supporting_target_count,
      coalesce(d.pathway_name, p.pathway_name) as pathway_name
    from disease_pathways d join drug_pathways p on d.reactome_id = p.reactome_id
"""
CTES["pairs"] = """
    select disease_id, drug_id, coalesce(g.r, 0)::int as gene_target_reason_count, coalesce(g.h, 0)::int as matched_gene_target_count,
      coalesce(g.dg, 0)::int as matched_disease_gene_count, coalesce(g.dt, 0)::int as matched_drug_target_count, coalesce(p.r, 0)::int as pathway_reason_count
    from (select disease_id, drug_id, count(*) as r, count(distinct hgnc_id) as h, count(distinct disease_gene_id) as dg, count(distinct drug_target_id) as dt from gene_matches group by 1, 2) g
    full outer join (select disease_id, drug_id, count(distinct reactome_id) as r from pathway_matches group by 1, 2) p using (disease_id, drug_id)
"""
CTES["disease_dim"] = """
    select d.disease_id, d.disease_name, (select count(*) from disease_genes g where g.disease_id = d.disease_id)::int as disease_gene_count,
      (select count(distinct hgnc_id) from bridged_genes g where g.disease_id = d.disease_id)::int as disease_gene_hgnc_mapped_count,
      (select count(distinct reactome_id) from disease_pathways g where g.disease_id = d.disease_id)::int as disease_pathway_count
    from diseases d
"""
CTES["acted"] = f"select *, nullif({r.shout('action_type')}, '') as act, nullif({r.shout('target_type')}, '') as kind from drug_targets"
CTES["target_profile"] = """
    select drug_id, count(distinct target_id) as a, count(*) filter (where act = 'INHIBITOR') as b, count(*) filter (where act = 'AGONIST') as c,
      count(*) filter (where act = 'ANTAGONIST') as d, count(act) as e, count(*) filter (where act is null) as f,
      count(distinct target_id || '|' || coalesce(action_type, '')) as g from acted group by 1
"""
CTES["drug_dim"] = """
    select d.drug_id, d.drug_name, d.chembl_id, coalesce(s.n, 0)::int as side_effect_count, coalesce(t.a, 0)::int as drug_target_count,
      coalesce(t.b, 0)::int as inhibitor_target_count, coalesce(t.c, 0)::int as agonist_target_count, coalesce(t.d, 0)::int as antagonist_target_count,
      coalesce(t.e, 0)::int as targets_with_action_type_count, coalesce(t.f, 0)::int as targets_missing_action_type_count,
      coalesce(t.g, 0)::int as mechanism_count, coalesce(p.n, 0)::int as drug_pathway_count, coalesce(b.n, 0)::int as drug_target_hgnc_mapped_count,
      coalesce((select string_agg(k || '=' || n, '|' order by k) from (select act as k, count(*) as n from acted a where a.drug_id = d.drug_id and act is not null group by 1)), '') as target_action_type_counts,
      coalesce((select string_agg(k || '=' || n, '|' order by k) from (select kind as k, count(*) as n from acted a where a.drug_id = d.drug_id and kind is not null group by 1)), '') as target_type_counts
    from drugs d left join (select drug_id, count(*) as n from drug_side_effects group by 1) s using (drug_id)
    left join target_profile t using (drug_id) left join (select drug_id, count(*) as n from drug_pathways group by 1) p using (drug_id)
    left join (select drug_id, count(distinct hgnc_id) as n from bridged_targets group by 1) b using (drug_id)
"""
CTES["features"] = f"""
    select p.disease_id, p.drug_id, disease_name, drug_name, chembl_id,
      gene_target_reason_count > 0 as generated_by_gene_target, pathway_reason_count > 0 as generated_by_pathway,
      ((gene_target_reason_count > 0)::int + (pathway_reason_count > 0)::int)::int as generation_method_count,
      gene_target_reason_count, pathway_reason_count, disease_gene_count, disease_gene_hgnc_mapped_count, drug_target_count,
      drug_target_hgnc_mapped_count, matched_gene_target_count, matched_disease_gene_count, matched_drug_target_count,
      {r.ratio('matched_gene_target_count', 'drug_target_hgnc_mapped_count')} as fraction_of_drug_targets_matching_disease_genes,
      {r.ratio('matched_gene_target_count', 'disease_gene_hgnc_mapped_count')} as fraction_of_disease_genes_targeted_by_drug,
      disease_pathway_count, drug_pathway_count, pathway_reason_count as matched_pathway_count,
      {r.ratio('pathway_reason_count', 'drug_pathway_count')} as fraction_of_drug_pathways_matching_disease_pathways,
      {r.ratio('pathway_reason_count', 'disease_pathway_count')} as fraction_of_disease_pathways_matching_drug_pathways,
      side_effect_count, inhibitor_target_count, agonist_target_count, antagonist_target_count, targets_with_action_type_count,
      targets_missing_action_type_count, mechanism_count, side_effect_count > 0 as has_sider_evidence,
      drug_target_count > 0 as has_chembl_target_evidence, drug_pathway_count > 0 as has_reactome_pathway_evidence,
      true as has_gene_target_bridge, disease_pathway_count > 0 as disease_pathways_available,
      drug_target_count as unique_target_count, 'level4_index_uncapped' as drug_pathway_source
    from pairs p join disease_dim using (disease_id) join drug_dim using (drug_id)
"""
# model
CTES["training"] = """
    select f.*, d.ontology_id, case when k.chembl_id is not null then 1 else 0 end::int as label from features f join diseases d using (disease_id)
    left join (select distinct ontology_id, chembl_id from raw_known_pairs) k on k.ontology_id = d.ontology_id and k.chembl_id = f.chembl_id
"""


def num(c: str, t: str = "") -> str:
    return f"coalesce(cast({t}{c} as double), 0)"


CTES["stats"] = "select " + ", ".join(
    f"avg({num(c)}) as m{i}, case when stddev_pop({num(c)}) < 1e-9 then 1.0 else stddev_pop({num(c)}) end as s{i}"
    for i, c in enumerate(MODEL_COLUMNS)
) + " from training"


def z(i: int, t: str = "f.") -> str:
    return f"(({num(MODEL_COLUMNS[i], t)} - m{i}) / s{i})"


def linear(shift: int) -> str:
    coef = rule_coefficients(shift)
    parts = ", ".join(f"{z(i)} * {c}" for i, c in enumerate(coef))
    margin = "-1.0" + "".join(f" + {z(i)} * {c}" for i, c in enumerate(coef))
    return f"""
        select disease_id, drug_id, [{parts}] as contributions, {r.tidy(f'1 / (1 + exp(-({margin})))', 6)} as model_output,
          {r.tidy('1 / (1 + exp(1.0))', 6)} as baseline_output, [{', '.join(num(c, 'f.') for c in MODEL_COLUMNS)}] as vals
        from features f, stats
    """


CTES["linear_7"] = linear(7)
CTES["linear_5"] = linear(5)
_NAMES = "[" + ", ".join(f"'{c}'" for c in MODEL_COLUMNS) + "]"
CTES["top_features"] = f"""
    select disease_id, drug_id, row_number() over (partition by disease_id, drug_id order by round(abs(c), 9) desc, i) as place,
      {_NAMES}[i] as feature_name, {r.tidy('v', 6)} as feature_value, {r.tidy('c', 6)} as contribution, {r.direction('round(c, 9)')} as direction
    from (select disease_id, drug_id, unnest(contributions) as c, unnest(vals) as v, unnest(range(1, {len(MODEL_COLUMNS) + 1})) as i from linear_7)
    qualify place <= 6
"""
CTES["predictions"] = """
    select l.disease_id, l.drug_id, model_output, baseline_output, 'logistic_regression' as model_name, t.names as top_feature_names
    from linear_7 l join (select disease_id, drug_id, list(feature_name order by place) as names from top_features where place <= 3 group by 1, 2) t using (disease_id, drug_id)
"""
CTES["sizes"] = "select disease_id, count(*) as n, row_number() over (order by count(*) desc, disease_id) as i from training group by 1"
_lightest = "case least(l0, l1, l2, l3, l4) when l0 then 0 when l1 then 1 when l2 then 2 when l3 then 3 else 4 end"
CTES["walk"] = f"""
    select 0 as i, null::varchar as disease_id, null::int as fold, 0::bigint as l0, 0::bigint as l1, 0::bigint as l2, 0::bigint as l3, 0::bigint as l4
    union all select s.i, s.disease_id, w.f::int, l0 + case when f = 0 then n else 0 end, l1 + case when f = 1 then n else 0 end, l2 + case when f = 2 then n else 0 end,
      l3 + case when f = 3 then n else 0 end, l4 + case when f = 4 then n else 0 end
    from (select *, {_lightest} as f from walk) w join sizes s on s.i = w.i + 1
"""
CTES["folds"] = "select disease_id, fold from walk where i > 0"
CTES["rule_scores"] = """
    select t.disease_id, t.drug_id, t.label, f.fold, 'linear_7' as model, l.model_output as score from training t join folds f using (disease_id) join linear_7 l using (disease_id, drug_id)
    union all select t.disease_id, t.drug_id, t.label, f.fold, 'linear_5', l.model_output from training t join folds f using (disease_id) join linear_5 l using (disease_id, drug_id)
"""
CTES["fold_metrics"] = f"""
    select model, fold, (p + n)::bigint as n_rows, p::bigint as n_positive, case when p > 0 and n > 0 then {r.tidy('area / (p * n)', 6)} end as roc_auc,
      case when p > 0 and n > 0 then {r.tidy('ap / p', 6)} end as pr_auc,
      {r.tidy('case when tp5 + fp5 > 0 then tp5 / (tp5 + fp5) else 0 end', 6)} as precision,
      {r.tidy('case when p > 0 then tp5 / p else 0 end', 6)} as recall,
      {r.tidy('case when tp5 + fp5 + p > 0 then 2 * tp5 / (tp5 + fp5 + p) else 0 end', 6)} as f1
    from (select model, fold, sum(pos)::double as p, sum(neg)::double as n, sum(pos * tp / (tp + fp)) as ap, sum(neg * (tp - pos / 2)) as area,
        coalesce(sum(pos) filter (where score >= 0.5), 0)::double as tp5, coalesce(sum(neg) filter (where score >= 0.5), 0)::double as fp5
      from (select *, sum(pos) over w as tp, sum(neg) over w as fp from
          (select model, fold, score, sum(label)::double as pos, sum(1 - label)::double as neg from rule_scores group by 1, 2, 3)
        window w as (partition by model, fold order by score desc rows unbounded preceding)) group by 1, 2)
"""
CTES["cv"] = "select model, " + ", ".join(
    f"{r.tidy(f'avg({m})', 6)} as {m}_mean, {r.tidy(f'stddev_pop({m})', 6)} as {m}_std" for m in ("roc_auc", "pr_auc", "precision", "recall", "f1")
) + ", count(*) as n_folds from fold_metrics group by model"


# fusion
def fuse(preds: str | None, scheme: str | None = None) -> str:
    s = {
        "gw": "0.45", "pw": "0.25", "mw": "0.3", "gcap": "5", "pcap": "10", "cs": "0.5", "ss": "0.5",
    } if scheme is None else {k: f"s.{k}" for k in ("gw", "pw", "mw", "gcap", "pcap", "cs", "ss")}
    join = f"left join {preds} m using (disease_id, drug_id)" if preds else ""
    ml = "m.model_output" if preds else "null::double"
    extra = "m.baseline_output, m.model_name, m.top_feature_names" if preds else "null::double as baseline_output, null::varchar as model_name, null::varchar[] as top_feature_names"

    def blend(count: str, cap: str, spec: str) -> str:
        inner = f"({s['cs']} * (least({count}, {cap})::double / {cap}::double) + {s['ss']} * {r.clip(spec)})"
        return r.tidy(r.clip(inner), 6)

    values = f"""
        select f.*, {ml} as model_output, {extra}, {'s.scheme' if scheme else "'default'"} as scheme,
          {s['gw']}::double as gene_target_weight, {s['pw']}::double as pathway_weight, {s['mw']}::double as ml_weight,
          case when drug_target_hgnc_mapped_count < 1 then 'drug has no HGNC-mapped target' when disease_gene_hgnc_mapped_count < 1 then 'disease has no HGNC-mapped gene' end as gene_target_reason,
          case when drug_pathway_count < 1 then 'drug Reactome pathway context unavailable' when not disease_pathways_available then 'disease has no derived pathways' end as pathway_reason,
          case when {ml} is null then 'no Phase 6 PredictionResult provided' end as ml_reason,
          case when gene_target_reason is null then {blend('matched_gene_target_count', s['gcap'], 'fraction_of_drug_targets_matching_disease_genes')} end as gene_target_value,
          case when pathway_reason is null then {blend('matched_pathway_count', s['pcap'], 'fraction_of_drug_pathways_matching_disease_pathways')} end as pathway_value,
          case when {ml} is not null then {r.tidy(r.clip(ml), 6)} end as ml_value
        from features f {join} {f', {scheme} s' if scheme else ''}
    """
    total = " + ".join(f"case when {c}_value is not null then {c}_weight else 0 end" for c in ("gene_target", "pathway", "ml"))
    weighted = " + ".join(f"coalesce({c}_value * ({c}_weight / total), 0)" for c in ("gene_target", "pathway", "ml"))
    cols = ", ".join(
        f"case when {c}_value is not null then {r.tidy(f'{c}_weight / total', 6)} end as {c}_effective_weight,"
        f" {r.tidy(f'{c}_value * ({c}_weight / total) * 100', 4)} as {c}_points"
        for c in ("gene_target", "pathway", "ml")
    )
    n = " + ".join(f"({c}_value is not null)::int" for c in ("gene_target", "pathway", "ml"))
    return f"""
        select *, {cols}, least(100.0, greatest(0.0, {r.tidy(f'100 * ({weighted})', 4)})) as repurposing_score, '1.0' as scoring_version,
          ({n}) between 1 and 2 as weights_renormalized
        from (select *, nullif({total}, 0) as total from ({values}))
    """


CTES["fused"] = fuse("predictions")
CTES["fused_plain"] = fuse(None)
CTES["schemes"] = """
    select * from (select 'scheme ' || r_regionkey as scheme, 0.1::double * (r_regionkey + 1) as gw, case when r_regionkey = 3 then 0.0 else 0.25 end as pw, 0.3 as mw,
      r_regionkey + 1 as gcap, 10 as pcap, 0.25::double * least(r_regionkey, 3) as cs, case when r_regionkey = 4 then 0.9 else 1 - 0.25::double * least(r_regionkey, 3) end as ss from region)
    where gw > 0 and pw > 0 and mw > 0 and gcap >= 1 and pcap >= 1 and abs(cs + ss - 1) <= 1e-9
"""
CTES["fused_schemes"] = fuse("predictions", "schemes")
CTES["ranked"] = "select *, row_number() over (partition by disease_id order by repurposing_score desc, drug_id)::int as rank from fused"


def ids_of(source: str, column: str) -> str:
    return f"list_sort(list_distinct(list({column}) filter (where coalesce({column}, '') <> ''))) from {source}"


CTES["rollups"] = f"""
    select disease_id, drug_id, coalesce(g.hs, []) as matched_gene_hgnc_ids, coalesce(g.ss, []) as matched_gene_symbols, coalesce(g.gs, []) as matched_disease_gene_ids,
      coalesce(g.ts, []) as matched_drug_target_ids, coalesce(p.ps, []) as matched_pathway_reactome_ids,
      list_filter([case when g.hs is not null then 'gene_target' end, case when p.ps is not null then 'pathway' end], lambda x: x is not null) as generation_methods
    from (select disease_id, drug_id, list_sort(list_distinct(list(hgnc_id))) as hs, list_sort(list_distinct(list(gene_symbol))) as ss,
        list_sort(list_distinct(list(disease_gene_id))) as gs, list_sort(list_distinct(list(drug_target_id))) as ts from gene_matches group by 1, 2) g
    full outer join (select disease_id, drug_id, list_sort(list_distinct(list(reactome_id))) as ps from pathway_matches group by 1, 2) p using (disease_id, drug_id)
"""
CTES["top"] = "select * from ranked join rollups using (disease_id, drug_id) where rank <= 10"


# narratives
def _sentence(name: str, missing: str, nothing: str | None, found: str) -> str:
    mid = f"when {name}_value <= 0 then {nothing}" if nothing else ""
    return f"case when {name}_value is null then {missing} {mid} else {found} end"


_gene = _sentence(
    "gene_target", "'Gene-target evidence was unavailable (' || gene_target_reason || ').'",
    "'Gene-target evidence was assessed; no shared gene/target overlap was found.'",
    "len(matched_gene_hgnc_ids) || ' disease-associated gene(s) matched this drug''s known target(s) via HGNC id (' ||"
    " coalesce(nullif(array_to_string(matched_gene_hgnc_ids[1:5], ', '), ''), 'n/a') || '), contributing ' || "
    + r.fixed("coalesce(gene_target_points, 0)", 1) + " || ' of the ' || " + r.fixed("repurposing_score", 1) + " || '-point repurposing score.'",
)
_path = _sentence(
    "pathway", "'Pathway evidence was unavailable (' || pathway_reason || ').'",
    "'Pathway evidence was assessed; no shared Reactome pathway was found.'",
    "len(matched_pathway_reactome_ids) || ' Reactome pathway(s) associated with the disease are also linked to this drug''s targets, contributing ' || "
    + r.fixed("coalesce(pathway_points, 0)", 1) + " || ' points to the repurposing score.'",
)
_ml = _sentence(
    "ml", "'ML evidence was unavailable (no Phase 6 prediction for this candidate).'", None,
    "'The Phase 6 model output was ' || " + r.fixed("model_output", 2) + " || ' (baseline ' || " + r.fixed("baseline_output", 2)
    + " || '), contributing ' || " + r.fixed("coalesce(ml_points, 0)", 1) + " || ' points to the repurposing score.'",
)
CTES["narratives"] = f"""
    select disease_id, drug_id, rank, repurposing_score, disease_name, drug_name, {_gene} as gene_target_description, {_path} as pathway_description, {_ml} as ml_description,
      drug_name || ' was computationally prioritized at rank ' || rank || ' for ' || disease_name || ', with a repurposing score of ' || {r.fixed('repurposing_score', 1)}
        || '/100 based on the available evidence: ' || coalesce(nullif(concat_ws(', ', case when gene_target_value is not null then 'gene_target' end, case when pathway_value is not null then 'pathway' end, case when ml_value is not null then 'ml' end), ''), 'none available')
        || '. This score reflects the available computational and biological evidence supporting further investigation — it is not a measure of clinical efficacy or treatment probability.' as summary,
      concat_ws(' | ', case when gene_target_value is null then 'Gene Target evidence was unavailable: ' || gene_target_reason || '.' end,
        case when pathway_value is null then 'Pathway evidence was unavailable: ' || pathway_reason || '.' end,
        case when ml_value is null then 'Ml evidence was unavailable: ' || ml_reason || '.' end,
        case when weights_renormalized then 'Evidence weights were renormalized over the components that were available.' end,
        'The repurposing score is an internal research prioritization score for further investigation — it is not a measure of clinical efficacy, safety, or treatment probability, and this candidate has not been clinically validated for this disease.') as limitations
    from top
"""
CTES["allowed"] = """
    select disease_id, drug_id, list_sort(list_distinct(list_filter(list_concat([disease_id, drug_id], matched_gene_hgnc_ids, matched_disease_gene_ids, matched_drug_target_ids, matched_pathway_reactome_ids,
      case when ml_value is not null then list_concat(['predicted_probability', model_name], top_feature_names) else [] end), lambda x: x is not null))) as allowed
    from top
"""
# graph
CTES["g_top"] = "select * from top where rank <= 5"
CTES["g_genes"] = """
    select m.*, t.rank, row_number() over (partition by disease_id, drug_id order by m.association_score desc nulls last, m.disease_gene_name nulls last, m.disease_gene_id, m.drug_target_id) as place
    from gene_matches m join (select disease_id, drug_id, rank from g_top) t using (disease_id, drug_id)
"""
CTES["g_paths"] = """
    select m.*, t.rank, row_number() over (partition by disease_id, drug_id order by m.disease_gene_support_count desc nulls last, m.pathway_name, m.reactome_id) as place
    from pathway_matches m join (select disease_id, drug_id, rank from g_top) t using (disease_id, drug_id)
"""
CTES["g_components"] = " union all ".join(
    f"select disease_id, drug_id, rank, {i} as o, '{c}' as component, {c}_value as value, {c}_weight as configured_weight, {c}_effective_weight as effective_weight, {c}_points as contribution_points from g_top where {c}_value is not null"
    for i, c in enumerate(("gene_target", "pathway", "ml"))
)
_NODE = "null::varchar as a1, null::varchar as a2, null::varchar as a3, null::double as v1, null::double as v2, null::double as v3"
CTES["nodes"] = f"""
    select * from (
      select disease_id as graph_id, 'disease:' || disease_id as id, 'disease' as type, disease_name as label, rank as at_rank, 0 as at_section, 0 as at_place, {_NODE} from g_top
      union all select disease_id, 'drug:' || drug_id, 'drug', drug_name, rank, 1, 0, null, null, null, null, null, null from g_top
      union all select disease_id, 'disease_gene:' || disease_gene_id, 'disease_gene', coalesce(gene_symbol, hgnc_id), rank, 2, place, hgnc_id, disease_gene_ensembl_id, disease_gene_source, null, null, null from g_genes
      union all select disease_id, 'drug_target:' || drug_target_id, 'drug_target', coalesce(drug_target_name, hgnc_id), rank, 2, place, hgnc_id, drug_target_uniprot_id, drug_action_type, null, null, null from g_genes
      union all select disease_id, 'pathway:' || reactome_id, 'pathway', coalesce(pathway_name, reactome_id), rank, 3, place, reactome_id, null, null, drug_supporting_target_count, disease_gene_support_count, null from g_paths
      union all select disease_id, 'evidence:' || drug_id || ':' || component, 'evidence_component', component || ' evidence', rank, 4, o, null, null, null, value, effective_weight, contribution_points from g_components
      union all select disease_id, 'prediction:' || drug_id, 'prediction', coalesce(model_name, 'model') || ' prediction', rank, 5, 0, model_name, null, null, model_output, null, null from g_top where ml_value is not null
      union all select disease_id, 'score:' || drug_id, 'score', {r.fixed('repurposing_score', 1)} || '/100', rank, 6, 0, null, null, null, repurposing_score, null, null from g_top
      union all select disease_id, 'rank:' || drug_id, 'rank', 'Rank #' || rank, rank, 7, 0, null, null, null, rank, null, null from g_top
      union all select disease_id, 'explanation:' || drug_id, 'explanation', 'AI explanation', rank, 8, 0, 'deterministic_fallback', null, null, null, null, null from g_top
    ) qualify row_number() over (partition by graph_id, id order by at_rank, at_section, at_place) = 1
"""
_BRIDGE = "HGNC complete set: disease gene ensembl_gene_id -> hgnc_id ; drug target uniprot -> hgnc_id ; overlap on hgnc_id (Level 4)"
_MODEL = "Level 6 ML prediction (GroupKFold-validated classifier over Level 5 features)"
_D, _G = "'disease:' || disease_id", "'drug:' || drug_id"
_gn, _tn, _pn = "'disease_gene:' || disease_gene_id", "'drug_target:' || drug_target_id", "'pathway:' || reactome_id"
CTES["edges"] = f"""
    select graph_id, source || '->' || type || '->' || target as id, source, target, type, provenance, at_rank, at_section, at_place, hgnc_id from (
      select disease_id as graph_id, {_D} as source, {_gn} as target, 'associated_with' as type, disease_gene_source as provenance, rank as at_rank, 2 as at_section, place as at_place, null as hgnc_id from g_genes
      union all select disease_id, {_gn}, {_tn}, 'matched_to', '{_BRIDGE}', rank, 2, place, hgnc_id from g_genes
      union all select disease_id, {_G}, {_tn}, 'has_target', drug_target_source, rank, 2, place, null from g_genes
      union all select disease_id, {_D}, {_pn}, 'associated_with', disease_pathway_source, rank, 3, place, null from g_paths
      union all select disease_id, {_G}, {_pn}, 'participates_in', 'derived:chembl-targets+reactome', rank, 3, place, null from g_paths
      union all select disease_id, {_G}, 'evidence:' || drug_id || ':' || component, 'received', case component when 'gene_target' then 'Level 4 gene-target route (HGNC id join) + Level 5 overlap features'
        when 'pathway' then 'Level 2 disease pathways (derived:opentargets+reactome) ∩ Level 3 drug pathways (derived:chembl-targets+reactome) — direct Reactome id intersection' else '{_MODEL}' end, rank, 4, o, null from g_components
      union all select disease_id, {_G}, 'prediction:' || drug_id, 'received', '{_MODEL}', rank, 5, 0, null from g_top where ml_value is not null
      union all select disease_id, {_G}, 'score:' || drug_id, 'received', 'Phase 7 evidence fusion (UNCHANGED here)', rank, 6, 0, null from g_top
      union all select disease_id, {_G}, 'rank:' || drug_id, 'ranked', 'Phase 8 candidate ranking (UNCHANGED here)', rank, 7, 0, null from g_top
      union all select disease_id, {_G}, 'explanation:' || drug_id, 'explained_by', 'Phase 9 AI explanation (narration only, not re-derived here)', rank, 8, 0, null from g_top
    ) qualify row_number() over (partition by graph_id, id order by at_rank, at_section, at_place) = 1
"""
