"""Ids, thresholds, weights and texts that results must agree on."""

# --- fixed values: id prefixes and width ------------------------------------
ID_PREFIX = {
    "drug": "DRUG",
    "disease": "DIS",
    "gene": "GENE",
    "target": "TGT",
    "pathway": "PATH",
    "side_effect": "SE",
}
ID_WIDTH = 6

# --- fixed values: thresholds -----------------------------------------------
GENES_PER_DISEASE = 200
MIN_PATHWAY_GENES = 3
NULL_WARN_FRACTION = 0.60
PROFILE_TOP = 15
SUMMARY_TOP = 10
SUMMARY_PATHWAYS = 8
PROFILE_PATHWAY_CAP = 100
SUGGESTION_LIMIT = 5
EXAMPLES_PER_REASON = 5
EXAMPLE_CHARS = 200
TOP_FEATURES = 6
VISIBLE_PER_TYPE = 14
SCORE_TOLERANCE = 0.05
DEAD_BAND = 1e-6
ZERO_STD = 1e-9
CV_FOLDS = 5
TREES = 400
MAX_DEPTH = 6
LEAF_ROWS = 10
MAX_ITERATIONS = 2000
SEED = 42
HUMAN = "Homo sapiens"
SNAPSHOT = (
    "SIDER 4.1 (2015-10) static release; ChEMBL current REST release; "
    "Open Targets Platform current GraphQL API; Reactome current release."
)

# --- fixed values: table contracts (column order, required, keys) -------------
# name -> [(column, type, required)]
TABLES = {
    "drugs": [
        ("drug_id", "string", True),
        ("drug_name", "string", True),
        ("canonical_identifier", "string", False),
        ("pubchem_cid", "string", False),
        ("chembl_id", "string", False),
        ("source", "string", True),
    ],
    "diseases": [
        ("disease_id", "string", True),
        ("disease_name", "string", True),
        ("ontology_id", "string", False),
        ("source", "string", True),
    ],
    "drug_targets": [
        ("drug_id", "string", True),
        ("target_id", "string", True),
        ("target_name", "string", False),
        ("target_type", "string", False),
        ("uniprot_id", "string", False),
        ("action_type", "string", False),
        ("source", "string", True),
    ],
    "drug_side_effects": [
        ("drug_id", "string", True),
        ("side_effect_id", "string", True),
        ("side_effect_name", "string", True),
        ("umls_cui", "string", False),
        ("source", "string", True),
    ],
    "disease_genes": [
        ("disease_id", "string", True),
        ("gene_id", "string", True),
        ("gene_name", "string", False),
        ("ensembl_id", "string", False),
        ("association_score", "double", False),
        ("source", "string", True),
    ],
    "disease_pathways": [
        ("disease_id", "string", True),
        ("pathway_id", "string", True),
        ("pathway_name", "string", True),
        ("reactome_id", "string", False),
        ("gene_support_count", "int", False),
        ("association_score", "double", False),
        ("source", "string", True),
    ],
}
PRIMARY_KEY = {
    "drugs": ["drug_id"],
    "diseases": ["disease_id"],
    "drug_targets": ["drug_id", "target_id"],
    "drug_side_effects": ["drug_id", "side_effect_id"],
    "disease_genes": ["disease_id", "gene_id"],
    "disease_pathways": ["disease_id", "pathway_id"],
}
FOREIGN_KEY = {
    "drug_targets": ("drug_id", "drugs"),
    "drug_side_effects": ("drug_id", "drugs"),
    "disease_genes": ("disease_id", "diseases"),
    "disease_pathways": ("disease_id", "diseases"),
}
UNIT_RANGE = {"disease_genes": ["association_score"]}
CORE_TABLES = ["drugs", "diseases"]

# --- fixed values: evidence weights -------------------------------------------
COMPONENTS = ["gene_target", "pathway", "ml"]
DEFAULT_SCHEME = {
    "gene_target_weight": 0.45,
    "pathway_weight": 0.25,
    "ml_weight": 0.30,
    "gene_target_cap": 5,
    "pathway_cap": 10,
    "count_share": 0.5,
    "specificity_share": 0.5,
}
SCORING_VERSION = "1.0"
RANKING_VERSION = "1.0"

# --- fixed values: model columns, in order ------------------------------------
MODEL_COLUMNS = [
    "generated_by_gene_target",
    "generated_by_pathway",
    "generation_method_count",
    "gene_target_reason_count",
    "pathway_reason_count",
    "disease_gene_count",
    "disease_gene_hgnc_mapped_count",
    "drug_target_count",
    "drug_target_hgnc_mapped_count",
    "matched_gene_target_count",
    "matched_disease_gene_count",
    "matched_drug_target_count",
    "fraction_of_drug_targets_matching_disease_genes",
    "fraction_of_disease_genes_targeted_by_drug",
    "disease_pathway_count",
    "drug_pathway_count",
    "matched_pathway_count",
    "fraction_of_drug_pathways_matching_disease_pathways",
    "fraction_of_disease_pathways_matching_drug_pathways",
    "side_effect_count",
    "inhibitor_target_count",
    "agonist_target_count",
    "antagonist_target_count",
    "targets_with_action_type_count",
    "targets_missing_action_type_count",
    "mechanism_count",
    "has_sider_evidence",
    "has_chembl_target_evidence",
    "has_reactome_pathway_evidence",
    "has_gene_target_bridge",
    "disease_pathways_available",
]

# --- fixed values: language checks --------------------------------------------
BANNED_PHRASES = [
    "effective",
    "will treat",
    "treats",
    "cure",
    "cures",
    "curing",
    "treatment probability",
    "safe",
    "safely",
    "clinically proven",
    "proven",
    "guarantee",
    "guaranteed",
]
MENTION_SHAPES = ["HGNC:", "TGT:", "GENE:", "DIS:", "DRUG:", "R-HSA-"]
ONTOLOGY_PREFIXES = ["EFO", "MONDO", "DOID", "ORPHANET", "ORDO", "HP", "NCIT", "OMIM"]
RESPONSE_KEYS = ["disease_id", "drug_id", "rank", "repurposing_score", "summary", "limitations"]

# --- fixed values: graph reading order ----------------------------------------
NODE_ORDER = [
    "disease",
    "disease_gene",
    "drug_target",
    "pathway",
    "drug",
    "prediction",
    "evidence_component",
    "score",
    "rank",
    "explanation",
]
