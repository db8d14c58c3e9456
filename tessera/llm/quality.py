"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in expression over the row's own text, so the filter adds
no shuffle and no worker process. Rules are data: a measure, a bound on either side
and a name. ``measured`` adds the measures, ``judge`` compiles the table into one
boolean per row and the list of rules that failed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import SPACE, lines, words

# fixed values: symbols that are counted
SYMBOLS = "[#*$%&|<>]"
# length of the windows in which repetition is looked for
WINDOW = 8
# fixed values: frequent function words of the four languages
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "it", "that", "for", "with", "as", "on", "was", "be", "by",
    "der", "die", "das", "und", "den", "von", "mit", "sich", "des", "auf", "ist", "ein", "eine", "nicht", "zu",
    "le", "la", "les", "de", "et", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "du",
    "el", "los", "las", "en", "y", "por", "con", "para", "no", "su", "del", "se",
]

_STOPS = [form for w in STOP_WORDS for form in (w, w.capitalize())]


@dataclass(frozen=True)
class Rule:
    """A document passes while ``least <= measure <= most``; a missing bound is open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None

    def holds(self) -> Column:
        value, test = F.col(self.measure), F.lit(True)
        if self.least is not None:
            test = test & (value >= self.least)
        if self.most is not None:
            test = test & (value <= self.most)
        return test


#: Bounds on ratios: each is far from what running prose in a natural language shows.
RULES = (
    Rule("word length", "mean_word_chars", 2.0, 16.0),
    Rule("symbols", "symbol_ratio", most=0.10),
    Rule("stop words", "stop_word_ratio", least=0.02),
    Rule("repeated lines", "dup_line_ratio", most=0.50),
)
# names of what is added to a row
RESULTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "mean_word_chars", "symbol_ratio", "stop_word_ratio", "dup_line_ratio",
    "base_failed", "failed", "kept",
)
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts and ratios that rules may use.

    Null and empty texts have zero words, zero counts and zero ratios. A word that lies
    in an eight-word window found twice is a repeated word; windows are compared word
    by word, their hash only tells quickly that none repeats. Input columns that bear
    the name of a result give way to it; rows are judged alone, so ties and repeated rows
    change nothing and an empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULTS]).alias("_row")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    first = docs.select(
        row,
        words(t).alias("_w"),
        F.filter(lines(t), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("_l"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    second = first.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "_windows": F.when(F.size("_w") >= WINDOW, _window_hashes(F.col("_w"))).otherwise(
                F.array().cast("array<long>")
            ),
            "_stops": F.size(F.filter("_w", lambda w: w.isin(_STOPS))),
            "_n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        }
    )
    third = second.withColumn(
        "_again",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"), _repeated_starts()
        ).otherwise(F.array().cast("array<int>")),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return third.select(
        "_row.*",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        _covered(F.col("_again")).cast("long").alias("n_repeat_words"),
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("_stops", "n_words").alias("stop_word_ratio"),
        ratio("n_dup_lines", "_n_lines").alias("dup_line_ratio"),
    )


def _window_hashes(w: Column) -> Column:
    """One hash for each run of eight words, from hashes of one, two and four words.
    Runs of equal words have equal hashes."""

    def doubled(by: int) -> Callable[[Column], Column]:
        return lambda h: F.zip_with(
            F.slice(h, F.lit(1), F.size(h) - by),
            F.slice(h, F.lit(by + 1), F.size(h)),
            lambda a, b: F.xxhash64(a, b),
        )

    h = F.transform(w, lambda x: F.xxhash64(x))
    for by in (1, 2, 4):
        h = _bound(h, doubled(by))
    return h


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: as the only element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated_starts() -> Column:
    """Starts of the windows that occur more than once, ascending. The windows are sorted
    with their words, so equal ones are neighbours; only texts with a repeat come here."""
    run = F.sort_array(
        F.transform(
            F.col("_windows"),
            lambda h, i: F.struct(
                h.alias("h"), F.slice("_w", i + 1, WINDOW).alias("w"), i.alias("i")
            ),
        )
    )
    same = lambda a, b: (a["h"] == b["h"]) & (a["w"] == b["w"])

    def starts(s: Column) -> Column:
        twice = lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(
            same(x, F.get(s, k + 1)), F.lit(False)
        )
        flagged = F.transform(s, lambda x, k: F.when(twice(x, k), x["i"]))
        return F.sort_array(F.filter(flagged, lambda i: i.isNotNull()))

    return _bound(run, starts)


def _covered(starts: Column) -> Column:
    """Words covered by windows at ``starts``: each adds what the next does not cover."""
    step = lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - x, F.lit(WINDOW)))
    return F.aggregate(F.transform(starts, step), F.lit(0), lambda a, x: a + x)


def judge(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    text: str = "text",
    least_words: int = LEAST_WORDS,
    most_repeated_percent: int = MOST_REPEATED_PERCENT,
) -> DataFrame:
    """``measured`` with ``base_failed``, ``failed`` (names of broken rules) and ``kept``.

    A text fails the base test with fewer than ``least_words`` words or more than
    ``most_repeated_percent`` of its words repeated. Null and empty texts fail it.
    """
    base = (F.col("n_words") < least_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated_percent
    )
    broken = F.filter(
        F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()
    )
    m = measured(docs, text).withColumns({"base_failed": base, "failed": broken})
    # the row number, always true, ties the verdict to this projection: a filter on it would
    # else be copied through all projections below, with everything that they compute
    here = F.monotonically_increasing_id() >= 0
    return m.withColumn("kept", here & ~F.col("base_failed") & (F.size("failed") == 0))
