"""Text rules that several operators share, as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the white space that separates words, and the letters that are lower-cased
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def strip(text: Column) -> Column:
    """``text`` without white space at both ends."""
    return F.btrim(text, F.lit(SPACE))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else. Pure ASCII takes the built-in, which is much faster."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Maximal runs without white space; none for null or blank text."""
    bare = strip(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, r"[\x20\x09-\x0D]+", -1)
    )


def lines(text: Column) -> Column:
    r"""The parts between ``\n``; one empty line for null or empty text."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)
