"""Personal data: patterns propose spans, checksums confirm them, nearby words weigh them.

Everything is a projection of the row's own text. Built-ins give the matches of a pattern
and the pieces between them; running sums of both lengths are the positions. Patterns are
possessive and start only where a run starts, so no text makes them try a run twice; they
match what the plain forms match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points on either side of a span in which context words count.
REACH = 40
#: Spans of the added kinds need this score.
LEAST_SCORE = 0.5
_BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """A pattern, a cheap test that a text can hold it, and words that speak for it."""

    name: str
    pattern: str
    hint: str
    base: bool
    context: str
    prior: float


def _near(*words: str) -> str:
    """A pattern that finds one of these words, in any case."""
    return rf"(?i)(?:^|[^a-z])(?:{'|'.join(words)})(?:[^a-z]|$)"


# fixed values: base kinds in their order, then the added kinds
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@", True, _near("e-?mail", "mail", "contact", "write"), 0.9,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]", True, _near("ip", "address", "host", "server"), 0.7,
    ),
    Kind(
        "card",
        r"[0-9](?:[ -]?[0-9])++",
        r"[0-9](?:[ -]?[0-9]){13}", True, _near("card", "visa", "credit", "payment", "account"), 0.7,
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        r"\+[0-9]", True, _near("phone", "tel", "call", "mobile", "fax"), 0.7,
    ),
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
        r"[A-Z]{2}[0-9]{2}", False, _near("iban", "bank", "account", "transfer"), 0.6,
    ),
    Kind(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"[0-9]{3}-[0-9]{2}-", False, _near("ssn", "social", "security", "insurance"), 0.3,
    ),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
        r"[0-9][A-Za-z]|[A-Za-z][0-9]", False,
        _near("token", "secret", "key", "apikey", "password", "passwd", "pwd", "credentials?", "bearer", "auth"), 0.3,
    ),
    Kind(
        "access_key",
        r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}",
        r"AKIA|ASIA|gh[oprsu]_|xox[abprs]-", False, _near("token", "secret", "key"), 0.7,
    ),
    Kind(
        "private_key",
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
        r"PRIVATE KEY-----", False, _near("key"), 0.9,
    ),
)
BASE = tuple(k.name for k in KINDS if k.base)
#: The kinds that give access, and what a run of signs needs to be one without a known shape.
SECRETS = ("secret", "access_key", "private_key")
LONGEST_SECRET, LEAST_SIGNS = 256, 8


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's test of a string of at most a few dozen digits."""
    back = F.reverse(digits)
    values = F.transform(
        F.sequence(F.lit(1), F.length(digits)), lambda i: F.substr(back, i, F.lit(1)).cast("int")
    )
    doubled = lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)
    return F.aggregate(F.transform(values, doubled), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(iban: Column) -> Column:
    """The remainder test of an account number without blanks."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    values = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: _letter(F.substr(moved, i, F.lit(1))))
    step = lambda a, v: F.when(v < 10, (a * 10 + v) % 97).otherwise((a * 100 + v) % 97)
    return F.aggregate(values, F.lit(0), step) == 1


def _letter(c: Column) -> Column:
    return F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        small = lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))
        return F.forall(F.split(match, r"\."), lambda p: small(bare(p)))
    digits = _digits(match)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        bare = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(F.lit(False))
    if kind == "secret":  # letters among digits, and not a few signs over and over
        signs = F.size(F.array_distinct(F.split(match, "")))
        mixed = match.rlike("[0-9][A-Za-z]|[A-Za-z][0-9]")
        return F.when((F.length(match) <= LONGEST_SECRET) & mixed, signs >= LEAST_SIGNS).otherwise(F.lit(False))
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def running_sums(lengths: Column) -> Column:
    """Sum of all earlier values for each place. Blocks keep it far from quadratic."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    block = lambda v, b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))

    def summed(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / _BLOCK).cast("int")
        blocks = F.when(F.size(v) > 0, F.sequence(F.lit(0), last)).otherwise(
            F.array().cast("array<int>")
        )
        sums = F.transform(blocks, lambda b: total(block(v, b)))
        before = _bound(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
        inside = lambda x, b: _bound(
            block(v, b), lambda w: F.transform(w, lambda _, i: x + total(F.slice(w, F.lit(1), i)))
        )
        return F.flatten(F.transform(before, inside))

    return _bound(lengths, summed)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: as the only element of an array."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _spans(rank: int, kind: Kind) -> tuple[Column, Callable[[], Column]]:
    """Where matches begin without their own piece, and the confirmed spans of one kind."""
    found, pieces = F.col(f"_found_{kind.name}"), F.col(f"_pieces_{kind.name}")
    lengths = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(pieces, i)))
    starts = running_sums(lengths)

    def span(m: Column, i: Column) -> Column:
        start = F.get(F.col("_at"), i) + F.length(F.get(pieces, i))
        near = F.right(F.get(pieces, i), F.lit(REACH)).rlike(kind.context) | F.left(
            F.get(pieces, i + 1), F.lit(REACH)
        ).rlike(kind.context)
        score = F.least(F.lit(1.0), F.lit(kind.prior) + F.when(near, 0.3).otherwise(0.0))
        good = _confirmed(kind.name, m)
        if not kind.base:  # stands alone, and likely enough
            joined = F.right(F.get(pieces, i), F.lit(1)).rlike("[A-Za-z0-9]") | F.left(
                F.get(pieces, i + 1), F.lit(1)
            ).rlike("[A-Za-z0-9]")
            good = good & ~joined & (score >= LEAST_SCORE)
        return F.when(
            good,
            F.struct(
                start.alias("start"),
                F.lit(rank).alias("rank"),
                (start + F.length(m)).alias("end"),
                F.lit(kind.name).alias("kind"),
                score.alias("score"),
            ),
        )

    return starts, lambda: F.filter(F.transform(found, span), lambda s: s.isNotNull())


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``spans``: array of (start, rank, end, kind, score) by start, then kind.

    Positions count code points, ends are exclusive. Null and empty texts have no spans.
    Each row is judged alone: repeated rows repeat, an empty table stays empty, and
    columns other than key and text are not read.
    """
    rows = docs.select(
        F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    none = F.array().cast("array<string>")
    for k in KINDS:
        possible = F.contains("text", F.lit("@")) if k.hint == "@" else F.col("text").rlike(k.hint)
        rows = rows.withColumn(
            f"_found_{k.name}",
            F.when(possible, F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).otherwise(none),
        )
    for k in KINDS:
        hit = F.size(f"_found_{k.name}") > 0
        rows = rows.withColumn(
            f"_pieces_{k.name}", F.when(hit, F.split("text", k.pattern, -1)).otherwise(none)
        )
    rows = rows.drop("text")
    for rank, k in enumerate(KINDS):
        starts, spans = _spans(rank, k)
        hit = F.size(f"_found_{k.name}") > 0
        empty = F.array().cast("array<int>")
        rows = rows.withColumn("_at", F.when(hit, starts).otherwise(empty)).withColumn(
            f"_spans_{k.name}",
            F.when(hit, spans()).otherwise(F.array().cast(_SPAN)).cast(_SPAN),
        )
    every = reduce(F.concat, [F.col(f"_spans_{k.name}") for k in KINDS])
    return rows.select(F.col("key").alias(key), F.sort_array(every).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; a span that begins inside
    an earlier one widens it."""
    grown = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= a["at"],
                F.concat(
                    a["out"],
                    F.substr(text, a["at"] + 1, s["start"] - a["at"]),
                    F.concat(F.lit("["), s["kind"], F.lit("]")),
                ),
            )
            .otherwise(a["out"])
            .alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)),
    )
    return grown
