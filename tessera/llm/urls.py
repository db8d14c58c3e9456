"""URL filter: host suffixes and path prefixes joined with a rule list by hash prefix.

Each distinct pair of host and path is expanded into the expressions that a rule could
have: every suffix of the host at a dot, with every prefix of the path, no longer than
the rules' own. Expressions meet rules on the first bytes of their digest; the full
digest confirms, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import lower_ascii

#: Hex digits of the digest on which expressions and rules meet.
PREFIX_DIGITS = 8


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``.
    ``listed`` rules are named in the result; the others only decide the verdict."""

    host: str
    path: str
    verdict: str
    listed: bool = True


# fixed values: the base rules
BASE_RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
#: Hosts that decide where no base rule fits: names of unwanted trades.
OWN_RULES = tuple(
    Rule(f"{name}.example.{top}", "/", "block", listed=False)
    for name in ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "org", "net")
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.substr(u, at + 3)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return (
        F.when(at > 0, lower_ascii(host)).otherwise(empty),
        F.when(at > 0, path).otherwise(empty),
    )


def rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    """Rules with digest and precedence: longer expressions first, then longer hosts, then block."""
    rows = [
        (i, r.host, r.path, r.host + r.path, r.verdict, r.listed, len(r.host), len(r.host + r.path))
        for i, r in enumerate(rules)
    ]
    t = spark.createDataFrame(
        rows,
        "rule_id long, rule_host string, rule_path string, expression string, verdict string, "
        "listed boolean, host_chars int, chars int",
    )
    digest = F.sha2("expression", 256)
    return t.withColumns({"digest": digest, "short": F.substring(digest, 1, PREFIX_DIGITS)})


def judge(
    pages: DataFrame,
    rules: Sequence[Rule] = BASE_RULES,
    own_rules: Sequence[Rule] = OWN_RULES,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per page: key, host, path, rule, verdict.

    ``rule`` is the winning one of ``rules`` (null if none fits) and decides; else the
    longest of ``own_rules`` decides; else ``default``. Null urls and urls without ``://``
    have an empty host and path. Repeated rows stay, each with its own result; other
    columns are not read. Caller-given rule lists are small local tables, so the joins
    with them move no page, whatever host they share.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(
        F.col(f"`{key}`").alias("key"),
        host.alias("host"),
        path.alias("path"),
        F.monotonically_increasing_id().alias("row"),
    )
    table = rule_table(spark, [*rules, *own_rules])
    labels = max((r.host.count(".") + 1 for r in [*rules, *own_rules]), default=0)
    lengths = sorted({len(r.path) for r in [*rules, *own_rules]})
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.array_join(F.slice(parts, -n, n), "."),
    )
    fitting = F.filter(
        F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")
    )
    expressions = F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(fitting, lambda n: F.concat(s, F.substr(F.col("path"), F.lit(1), n))),
        )
    )
    # one row more per page, so that pages without any expression keep one
    asked = rows.select(
        "*", F.explode(F.concat(F.array(F.lit(None).cast("string")), expressions)).alias("asked")
    )
    digest = F.sha2("asked", 256)
    asked = asked.withColumns({"asked_digest": digest, "short": F.substring(digest, 1, PREFIX_DIGITS)})
    met = asked.join(table, "short", "left")
    right = F.col("asked_digest") == F.col("digest")
    # sorts by: named rule, expression length, host length, block before allow, rule number
    rank = F.when(
        right,
        F.struct(
            F.col("listed"),
            F.col("chars"),
            F.col("host_chars"),
            (F.col("verdict") == "block").alias("block"),
            (-F.col("rule_id")).alias("first"),
            F.col("expression"),
            F.col("verdict"),
        ),
    )
    best = met.groupBy("row", "key", "host", "path").agg(F.max(rank).alias("best"))
    return best.select(
        F.col("key").alias(key),
        "host",
        "path",
        F.when(F.col("best.listed"), F.col("best.expression")).alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
