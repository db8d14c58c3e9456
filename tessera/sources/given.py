"""The given tables as raw sources.

Suppliers play the drugs, nations the diseases, parts the genes and targets,
brand and size groups the pathways. The views are plain SQL over the given
tables and keep their dirt: bad ids, repeats, blanks. Ids are neither normalised
nor minted here; that is the work of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_CONCEPT = "'c' || lpad(cast(cast(regexp_extract(p_brand,'([0-9]+)',1) as int)*100+length(p_type)*10+p_size%5 as string),7,'0')"
_PROTEIN = "case when p_partkey % 10 = 9 then null else 'P' || lpad(cast(p_partkey as string),5,'0') end"

RAW = {
    "raw_drug_names": """
        select s_suppkey*10 as seq, 'CID1' || lpad(cast(s_suppkey+1 as string),8,'0') as stitch_id,
          case when s_suppkey % 5 = 4 then '  Shared   Salt ' || cast(cast(floor(s_suppkey/10) as int) as string)
               else '  ' || s_name || '  Salt ' end as drug_name
        from {supplier}
        union all select s_suppkey*10+1, 'bad' || cast(s_suppkey as string), s_name from {supplier} where s_suppkey % 17 = 0
        union all select s_suppkey*10+2, 'CID0' || lpad(cast(s_suppkey+1 as string),8,'0'), 'dup ' || s_name from {supplier} where s_suppkey % 11 = 0
        union all select s_suppkey*10+3, 'CID1' || lpad(cast(s_suppkey+900001 as string),8,'0'), '   ' from {supplier} where s_suppkey % 19 = 0
    """,
    "raw_chembl_map": """
        select s_suppkey*2 as seq, cast(s_suppkey+1 as string) as pubchem_cid, 'chembl' || cast(s_suppkey+1 as string) as chembl_id
        from {supplier} where s_suppkey % 3 <> 0
        union all select s_suppkey*2+1, cast(s_suppkey+1 as string), 'chembl0' || cast(s_suppkey+1 as string) from {supplier} where s_suppkey % 15 = 1
    """,
    "raw_side_effects": f"""
        select l_orderkey*10+l_linenumber as seq, 'CID1' || lpad(cast(l_suppkey+1 as string),8,'0') as stitch_id,
          case when p_size % 7 = 0 then null else {_CONCEPT} end as umls_meddra,
          {_CONCEPT} as umls_label,
          case when (l_orderkey+l_linenumber) % 2 = 0 then 'PT' else 'LLT' end as meddra_type,
          p_brand || ' ' || p_type as side_effect_name
        from {{lineitem}} join {{part}} on l_partkey=p_partkey
    """,
    "raw_diseases": """
        select n_nationkey as seq, 'mondo:' || lpad(cast(n_nationkey+1 as string),7,'0') as ontology_id, n_name as disease_name
        from {nation}
    """,
    "raw_disease_genes": """
        select 'mondo:' || lpad(cast(c_nationkey+1 as string),7,'0') || '|' || lpad(cast(l_partkey+1 as string),11,'0') as seq,
          'mondo:' || lpad(cast(c_nationkey+1 as string),7,'0') as ontology_id,
          'ensg' || lpad(cast(l_partkey+1 as string),11,'0') || '.2' as ensembl_id,
          'G' || cast(l_partkey as string) as gene_symbol,
          least(cast(1.0 as double), sum(l_quantity)/250) as association_score
        from {lineitem} join {orders} on l_orderkey=o_orderkey join {customer} on o_custkey=c_custkey
        group by c_nationkey, l_partkey
    """,
    "raw_targets": """
        select p_partkey as seq, 'CHEMBL' || cast(p_partkey+1000000 as string) as target_chembl_id, p_name as target_name,
          p_type as target_type, case when p_partkey % 10 = 9 then null else 'p' || lpad(cast(p_partkey as string),5,'0') end as uniprot_id
        from {part}
    """,
    "raw_mechanisms": """
        select l_orderkey*10+l_linenumber as seq, 'CHEMBL' || cast(l_suppkey+1 as string) as chembl_id,
          'CHEMBL' || cast(l_partkey+1000000 as string) as target_chembl_id,
          case l_returnflag when 'R' then 'INHIBITOR' when 'A' then 'ANTAGONIST'
            else case when l_linestatus='O' then 'AGONIST' else null end end as action_type
        from {lineitem}
    """,
    "raw_gene_pathways": f"""
        select 'ENSG' || lpad(cast(p_partkey+1 as string),11,'0') as ensembl_id, {_PROTEIN} as uniprot,
          'R-HSA-' || cast(cast(regexp_extract(p_brand,'([0-9]+)',1) as int)*10+length(p_type) as string) as reactome_id,
          p_brand as pathway_name from {{part}}
        union all select 'ENSG' || lpad(cast(p_partkey+1 as string),11,'0'), {_PROTEIN},
          'R-HSA-' || cast(900000+p_size as string), 'size ' || cast(p_size as string) from {{part}} where p_partkey % 4 = 0
    """,
    # pathway names as a file of their own; some had another name before, one group has none
    "raw_pathway_names": """
        select 2 as seq, reactome_id, max(pathway_name) as pathway_name from {raw_gene_pathways}
        where pathway_name <> 'size 7' group by reactome_id
        union all select 1, reactome_id, max('~ former ' || pathway_name) from {raw_gene_pathways}
        where pathway_name <> 'size 7' and length(reactome_id) % 2 = 0 group by reactome_id
    """,
    "raw_gene_bridge": """
        select p_partkey as seq, 'HGNC:' || cast(p_partkey+1 as string) as hgnc_id, 'SYM' || cast(p_partkey as string) as symbol,
          'ENSG' || lpad(cast(p_partkey+1 as string),11,'0') as ensembl_gene_id,
          'P' || lpad(cast(p_partkey as string),5,'0') || '|Q' || lpad(cast(p_partkey as string),5,'0') as uniprot_ids
        from {part} where p_partkey % 20 <> 0
    """,
    "raw_known_pairs": """
        select 'MONDO_' || lpad(cast(a.n_nationkey+1 as string),7,'0') as ontology_id, 'CHEMBL' || cast(s_suppkey+1 as string) as chembl_id
        from {nation} a join {nation} b on a.n_regionkey=b.n_regionkey join {supplier} on s_nationkey=b.n_nationkey
    """,
    # requested disease ids; every fifth nation has a twin that no payload answers
    "raw_seeds": """
        select n_nationkey*2 as seq, 'MONDO:' || lpad(cast(n_nationkey+1 as string),7,'0') as ontology_id from {nation}
        union all select n_nationkey*2+1, 'MONDO:' || lpad(cast(n_nationkey+5001 as string),7,'0') from {nation} where n_nationkey % 5 = 0
    """,
    # name synonyms of diseases; regions also serve as loose synonyms of their first nation
    "raw_aliases": """
        select n_nationkey as seq, 'Land ' || cast(n_nationkey as string) as alias, 'MONDO_' || lpad(cast(n_nationkey+1 as string),7,'0') as ontology_id from {nation}
        union all select n_nationkey+1000, 'LAND  ' || cast(n_nationkey as string) || '.', 'mondo:' || lpad(cast((n_nationkey+1)%25+1 as string),7,'0') from {nation} where n_nationkey % 6 = 0
        union all select r_regionkey+2000, r_name || ' area', 'MONDO_' || lpad(cast(r_regionkey+7001 as string),7,'0') from {region}
    """,
    # free-text questions about diseases and drugs
    "raw_disease_queries": """
        select n_nationkey*10 as query_id, '  "' || lower(n_name) || '". ' as query from {nation}
        union all select n_nationkey*10+1, 'MONDO_' || lpad(cast(n_nationkey*2+1 as string),7,'0') from {nation}
        union all select n_nationkey*10+2, 'dis:' || lpad(cast(n_nationkey*2+1 as string),6,'0') from {nation}
        union all select n_nationkey*10+3, case when n_nationkey % 5 = 0 then null else repeat(' ', n_nationkey % 3) end from {nation}
        union all select n_nationkey*10+4, '(land ' || cast(n_nationkey*2 as string) || ')' from {nation}
        union all select n_nationkey*10+5, substring(n_name, 1, 1 + n_nationkey % length(n_name)) || case when n_nationkey % 4 = 0 then ' unknown' else '' end from {nation}
    """,
    "raw_drug_queries": """
        select s_suppkey*10 as query_id, '[' || upper(s_name) || ' SALT]' as query from {supplier}
        union all select s_suppkey*10+1, case when s_suppkey % 2 = 0 then 'chembl' else 'CID:' end || cast(s_suppkey*2+1 as string) from {supplier}
        union all select s_suppkey*10+2, 'drug:' || lpad(cast(s_suppkey*2+1 as string),6,'0') from {supplier}
        union all select s_suppkey*10+3, 'shared salt ' || cast(cast(floor(s_suppkey/10) as int) as string) from {supplier}
        union all select s_suppkey*10+4, case when s_suppkey % 3 = 0 then '' when s_suppkey % 3 = 1 then cast(s_suppkey+1 as string) else 'salt ' || cast(s_suppkey as string) || ' of supplier' end from {supplier}
        union all select s_suppkey*10+5, substring(s_name, 1 + s_suppkey % 8, 6 + s_suppkey % 7) from {supplier}
    """,
}


class GivenTables:
    """The given parquet tables of one folder and the raw views over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        text = RAW[name]
        used = {t: self[t] for t in [*TABLES, *RAW] if "{" + t + "}" in text}
        return self.spark.sql(text, **used)
