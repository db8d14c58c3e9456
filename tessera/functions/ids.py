"""Identifier and name rules as column expressions, applied by table jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.constants import ONTOLOGY_PREFIXES

# --- fixed values: character classes and patterns -----------------------------
# every character that counts as white space in a Unicode text
SPACE = r"\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE_POINTS = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WORD = r"\p{L}\p{N}_"
EDGE = rf"""^[{SPACE}"'`(\[{{]+|[{SPACE}"'`)\]}}.,;:!?]+\z"""
PROTEIN = r"^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})\z"
CONCEPT = r"^C[0-9]{6,}\z"
COMPOUND = r"^CID[01][0-9]+\z"
DIGITS = r"^[0-9]+\z"
DISEASE_ID = r"(?i)^DIS:[0-9]{1,9}\z"
DRUG_ID = r"(?i)^DRUG:[0-9]{1,9}\z"
ONTOLOGY_ID = rf"(?i)^(?:{'|'.join(ONTOLOGY_PREFIXES)})[:_][{WORD}]+\z"
CHEMBL_ID = r"(?i)^CHEMBL[0-9]+\z"
CID_QUERY = r"(?i)^(?:CID[:_]?)?([0-9]+)\z"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit("".join(map(chr, SPACE_POINTS))))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def no_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def no_leading_zeros(c: Column) -> Column:
    return F.regexp_replace(c, "^0+(?=[0-9])", "")


def _shout(c: Column) -> Column:
    """Upper case without white space at both ends. Most ids have none there: their first and last
    character tell, which costs far less than trimming by a list of characters."""
    c = c.cast("string")
    ends = [F.substr(c, F.lit(at), F.lit(1)).between("!", "~") for at in (1, -1)]
    return F.upper(F.when(ends[0] & ends[1], c).otherwise(strip(c)))


def name_key(c: Column) -> Column:
    return no_blank(F.lower(squeeze(c)))


def compound_key(c: Column) -> Column:
    s = _shout(c)
    digits = F.when(s.rlike(COMPOUND), F.substr(s, F.lit(5))).when(s.rlike(DIGITS), s)
    return no_leading_zeros(digits)


def ontology_key(c: Column) -> Column:
    return no_blank(F.translate(_shout(c), ":", "_"))


def gene_key(c: Column) -> Column:
    s = F.substring_index(_shout(c), ".", 1)
    return F.when(s.startswith("ENSG"), s)


def chembl_key(c: Column) -> Column:
    s = _shout(c)
    return F.when(s.startswith("CHEMBL"), s)


def reactome_key(c: Column) -> Column:
    s = _shout(c)
    return F.when(s.startswith("R-"), s)


def concept_key(c: Column) -> Column:
    s = _shout(c)
    return F.when(s.rlike(CONCEPT), s)


def protein_key(c: Column) -> Column:
    s = _shout(c)
    return F.when(s.rlike(PROTEIN), s)


KINDS = {
    "name": name_key,
    "compound": compound_key,
    "ontology": ontology_key,
    "gene": gene_key,
    "chembl": chembl_key,
    "reactome": reactome_key,
    "concept": concept_key,
    "protein": protein_key,
}


def worked_out(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The named columns, each worked out once a row. Filters on them stay above: Spark would copy all
    that stands behind a column into the filter otherwise, once for every use of it."""
    return df.select(F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def normalize_ids(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add ``<column>_key`` per entry and the first column without a key as ``reject_reason``."""
    keyed = df.withColumns({f"{c}_key": KINDS[kind](F.col(c)) for c, kind in columns.items()})
    reason = F.lit(None).cast("string")
    for c, kind in reversed(list(columns.items())):
        reason = F.when(F.col(f"{c}_key").isNull(), F.lit(f"no_{kind}_key:{c}")).otherwise(reason)
    return keyed.withColumn("reject_reason", reason)


# --- query text -----------------------------------------------------------------
def query_text(c: Column) -> Column:
    once = F.regexp_replace(c, EDGE, "")
    return F.coalesce(name_key(F.regexp_replace(once, EDGE, "")), F.lit(""))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def disease_query_kind(c: Column) -> Column:
    s = strip(c)
    return (
        F.when(is_blank(c), "empty")
        .when(s.rlike(DISEASE_ID), "internal_id")
        .when(s.rlike(ONTOLOGY_ID), "ontology_id")
        .otherwise("name")
    )


def drug_query_kind(c: Column) -> Column:
    s = strip(c)
    return (
        F.when(is_blank(c), "empty")
        .when(s.rlike(DRUG_ID), "internal_id")
        .when(s.rlike(CHEMBL_ID) | s.rlike(CID_QUERY), "external_id")
        .otherwise("name")
    )


def cid_in_query(c: Column) -> Column:
    """The compound number of ``2244`` / ``CID2244`` / ``CID:2244``, else null."""
    return no_leading_zeros(no_blank(F.regexp_extract(strip(c), CID_QUERY, 1)))


def chembl_in_query(c: Column) -> Column:
    s = F.upper(strip(c))
    return F.when(s.rlike(CHEMBL_ID), s)


# --- missing values ---------------------------------------------------------------
def clean_missing(df: DataFrame) -> DataFrame:
    """NaN and blank text become null; text is stripped at both ends."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "string":
            out[name] = no_blank(strip(F.col(name)))
        elif kind in ("double", "float"):
            out[name] = F.when(~F.isnan(name), F.col(name))
    return df.withColumns(out) if out else df
