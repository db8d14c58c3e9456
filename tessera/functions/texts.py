"""Text rules as column expressions: phrases, mentions, banned language, display formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.constants import BANNED_PHRASES, MENTION_SHAPES
from tessera.functions.ids import SPACE, WORD, no_blank, strip

DASH = "—"


def mechanism_phrase(action: Column, name: Column, target_id: Column) -> Column:
    act = F.lower(strip(F.coalesce(action, F.lit(""))))
    what = F.coalesce(no_blank(name), target_id)
    return F.when(act != "", F.concat(act, F.lit(" of "), what)).otherwise(
        F.concat(F.lit("acts on "), what)
    )


# --- identifiers and banned language ------------------------------------------------
_SHAPES = "|".join(s + r"\p{Nd}+" for s in MENTION_SHAPES)
MENTION = rf"(?<![{WORD}])(?:{_SHAPES})(?![{WORD}])"


def mentions(c: Column) -> Column:
    """All identifiers a text mentions, in order."""
    return F.regexp_extract_all(c, F.lit(MENTION), F.lit(0))


def _phrase(phrase: str) -> str:
    words = rf"[{SPACE}]+".join(phrase.split())
    return rf"(?iu)(?<![{WORD}]){words}(?![{WORD}])"


_ANY_BANNED = (
    rf"(?iu)(?<![{WORD}])(?:"
    + "|".join(rf"[{SPACE}]+".join(p.split()) for p in BANNED_PHRASES)
    + rf")(?![{WORD}])"
)


def banned_phrase(c: Column) -> Column:
    """The first phrase of the list that occurs as whole words, else null.

    One pass finds all occurrences. A longer phrase that hides a shorter one comes
    first in the list, so the earliest listed occurrence is the answer. Letters that
    only fold to a phrase's letters are left to one search per phrase."""
    found = F.regexp_extract_all(c, F.lit(_ANY_BANNED), F.lit(0))
    plain = F.transform(found, lambda m: F.lower(F.regexp_replace(m, rf"[{SPACE}]+", " ")))
    listed = F.array(*[F.lit(p) for p in BANNED_PHRASES])
    first = F.get(F.array_intersect(listed, plain), F.lit(0))
    one_by_one = reduce(
        lambda acc, p: F.when(c.rlike(_phrase(p)), F.lit(p)).otherwise(acc),
        reversed(BANNED_PHRASES),
        F.lit(None).cast("string"),
    )
    odd = F.size(F.array_except(plain, listed)) > 0
    return F.when(_may_hold_banned(c), F.when(odd, one_by_one).otherwise(first))


def _may_hold_banned(c: Column) -> Column:
    """Cheap and never wrong the other way: every phrase holds one of these stems. A
    text with a letter that lower-casing does not fold is always searched."""
    low = F.lower(c)
    # fixed values: a stem of every phrase, and the long s
    stems = ["effective", "treat", "cure", "curing", "safe", "proven", "guarantee"]
    return reduce(lambda a, s: a | F.contains(low, F.lit(s)), stems, F.contains(c, F.lit("\u017f")))


# --- numbers in text ------------------------------------------------------------------
def fixed(c: Column, places: int) -> Column:
    """Decimal text, exact halves to even."""
    return F.regexp_replace(F.format_number(c, places), ",", "")


def shown_score(c: Column) -> Column:
    """One decimal, exact halves upwards."""
    half = F.abs(c * 4) % 2 == 1
    return F.when(half, F.format_number(F.ceil(c * 10) / 10, 1)).otherwise(F.format_number(c, 1))


def shown_points(c: Column) -> Column:
    return F.coalesce(shown_score(c), F.lit(DASH))


def shown_percent(c: Column) -> Column:
    pct = F.floor(c * 100 + 0.5).cast("string")
    return F.coalesce(F.concat(pct, F.lit("%")), F.lit(DASH))


def shown_status(c: Column) -> Column:
    # fixed values: status labels
    return (
        F.when(c == "supported", "Supported by evidence")
        .when(c == "assessed_no_support", "Assessed — no overlap found")
        .when(c == "not_assessed", "Not assessable")
    )


def title_case(c: Column) -> Column:
    words = F.split(F.translate(c, "_", " "), " ")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))),
        " ",
    )
