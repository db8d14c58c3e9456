"""SQL fragments for the scalar rules, in DuckDB's dialect."""

from __future__ import annotations

from tessera.constants import BANNED_PHRASES, MENTION_SHAPES, ONTOLOGY_PREFIXES
from tessera.functions.ids import SPACE

_EDGE = (rf"""^[{SPACE}"'`(\[{{]+|[{SPACE}"'`)\]}}.,;:!?]+$""").replace("'", "''")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def shout(x: str) -> str:
    return f"upper({strip(x)})"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


def name_key(x: str) -> str:
    return f"nullif(lower({squeeze(x)}), '')"


def unzero(x: str) -> str:
    return f"regexp_replace({x}, '^0+([0-9])', '\\1')"


def compound(x: str) -> str:
    s = shout(x)
    return unzero(
        f"(case when regexp_full_match({s}, 'CID[01][0-9]+') then substr({s}, 5) when regexp_full_match({s}, '[0-9]+') then {s} end)"
    )


def ontology(x: str) -> str:
    return f"nullif(replace({shout(x)}, ':', '_'), '')"


def gene(x: str) -> str:
    s = f"split_part({shout(x)}, '.', 1)"
    return f"(case when starts_with({s}, 'ENSG') then {s} end)"


def chembl(x: str) -> str:
    return f"(case when starts_with({shout(x)}, 'CHEMBL') then {shout(x)} end)"


def reactome(x: str) -> str:
    return f"(case when starts_with({shout(x)}, 'R-') then {shout(x)} end)"


def concept(x: str) -> str:
    return f"(case when regexp_full_match({shout(x)}, 'C[0-9]{{6,}}') then {shout(x)} end)"


def protein(x: str) -> str:
    p = "[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2}"
    return f"(case when regexp_full_match({shout(x)}, '(?:{p})') then {shout(x)} end)"


def query_text(x: str) -> str:
    once = f"regexp_replace({x}, '{_EDGE}', '', 'g')"
    twice = f"regexp_replace({once}, '{_EDGE}', '', 'g')"
    return f"coalesce({name_key(twice)}, '')"


def blank(x: str) -> str:
    return f"(coalesce({strip(x)}, '') = '')"


def disease_kind(x: str) -> str:
    s = strip(x)
    onto = "|".join(ONTOLOGY_PREFIXES)
    return (
        f"(case when {blank(x)} then 'empty' when regexp_full_match({s}, '(?i)DIS:[0-9]{{1,9}}') then 'internal_id'"
        f" when regexp_full_match({s}, '(?i)(?:{onto})[:_][\\p{{L}}\\p{{N}}_]+') then 'ontology_id' else 'name' end)"
    )


_CID = "(?i)^(?:CID[:_]?)?([0-9]+)$"


def drug_kind(x: str) -> str:
    s = strip(x)
    return (
        f"(case when {blank(x)} then 'empty' when regexp_full_match({s}, '(?i)DRUG:[0-9]{{1,9}}') then 'internal_id'"
        f" when regexp_full_match({s}, '(?i)CHEMBL[0-9]+') or regexp_matches({s}, '{_CID}') then 'external_id' else 'name' end)"
    )


def cid_query(x: str) -> str:
    return unzero(f"nullif(regexp_extract({strip(x)}, '{_CID}', 1), '')")


def chembl_query(x: str) -> str:
    return f"(case when regexp_full_match({shout(x)}, 'CHEMBL[0-9]+') then {shout(x)} end)"


def tidy(x: str, n: int) -> str:
    return f"cast(round(cast(({x}) as decimal(28,12)), {n}) as double)"


def ratio(n: str, d: str) -> str:
    return tidy(f"cast({n} as double) / nullif(cast({d} as double), 0)", 6)


def clip(x: str) -> str:
    return f"(case when {x} is null or isnan({x}) or isinf({x}) then 0.0 else least(1.0, greatest(0.0, {x})) end)"


def mentions(x: str) -> str:
    shapes = "|".join(s + r"\d+" for s in MENTION_SHAPES)
    return rf"regexp_extract_all({x}, '\b(?:{shapes})\b')"


def banned(x: str) -> str:
    cases = []
    for p in BANNED_PHRASES:
        words = rf"[{SPACE}]+".join(p.split())
        cases.append(rf"when regexp_matches({x}, '(?i)(?:^|[^\p{{L}}\p{{N}}_]){words}(?:$|[^\p{{L}}\p{{N}}_])') then '{p}'")
    return f"(case {' '.join(cases)} end)"


def direction(x: str) -> str:
    return f"(case when {x} > 1e-6 then 'increases' when {x} < -1e-6 then 'decreases' else 'neutral' end)"


def status(x: str) -> str:
    return f"(case when {x} is null then 'not_assessed' when {x} > 0 then 'supported' else 'assessed_no_support' end)"


def fixed(x: str, n: int) -> str:
    return f"format('{{:.{n}f}}', {x})"
