r"""Line dedup: keep one copy of lines that many documents share.

Lines become 128-bit hashes with document and position. The hashes are range
partitioned and sorted by document (last first) and position within a hash, so
that one pass streams the first line of every document under a hash. A hash held by a
large share of all documents is spread over ``SPREAD`` ranges, whose counts are summed;
its lines meet the verdict range by range as well.
The result is one keep bitmap per document, run-length coded; the text does not travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.words import lines, lower_ascii, strip

#: Ranges over which the documents of one hash are spread.
SPREAD = 64
LEAST_CHARS = 40
LEAST_DOCS = 5
_HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return lower_ascii(strip(line))


def keep_bitmaps(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """(doc, content, dropped): for documents that lose lines, the run-length coded bitmap of
    kept lines as ``keep`` (array of start and length) and ``n_dropped``.

    ``content`` is a hash of the text: repeated rows of a document share a bitmap, and
    two texts under one id keep their own. Rows with a null key neither count nor lose.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("doc"), t.alias("text")).filter(F.col("doc").isNotNull())
    at = F.transform(
        lines(F.col("text")), lambda x, i: F.struct(line_key(x).alias("k"), i.alias("position"))
    )
    long_lines = F.filter(at, lambda x: F.length(x["k"]) >= least_chars)
    lined = rows.select("doc", F.xxhash64("text").alias("content"), F.explode(long_lines).alias("x")).select(
        "doc",
        "content",
        F.xxhash64("x.k").alias("h1"),
        F.xxhash64(F.lit(1), "x.k").alias("h2"),
        "x.position",
        F.pmod(F.hash("doc"), F.lit(SPREAD)).alias("part"),
    )
    order = [*_HASH, "part", F.desc("doc"), "position"]
    ranged = lined.repartitionByRange(*_HASH, "part").sortWithinPartitions(*order)
    streamed = Window.partitionBy(*_HASH, "part").orderBy(F.desc("doc"), "position")
    is_first = ~F.lag("doc").over(streamed).eqNullSafe(F.col("doc"))
    firsts = ranged.withColumn("first", is_first)
    slices = firsts.groupBy(*_HASH, "part").agg(
        F.sum(F.col("first").cast("long")).alias("n"), F.max("doc").alias("last")
    )
    shared = (
        slices.groupBy(*_HASH)
        .agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.collect_set("part").alias("parts"))
        .filter(F.col("n") >= least_docs)
        .select(*_HASH, F.explode("parts").alias("part"), "last")
    )
    lost = lined.join(shared, [*_HASH, "part"]).filter(F.col("doc") < F.col("last"))
    per_doc = lost.groupBy("doc", "content").agg(F.sort_array(F.collect_set("position")).alias("lost"))
    return per_doc.select(
        "doc", "content", _runs(F.col("lost")).alias("keep"), F.size("lost").alias("n_dropped")
    )


def _runs(lost: Column) -> Column:
    """Kept runs between the lost positions; the last is open and has length null."""
    return F.transform(
        F.sequence(F.lit(0), F.size(lost)),
        lambda k: F.struct(
            (F.coalesce(F.get(lost, k - 1), F.lit(-1)) + 1).alias("start"),
            (F.get(lost, k) - F.coalesce(F.get(lost, k - 1), F.lit(-1)) - 1).alias("length"),
        ),
    )


def kept_lines(all_lines: Column, keep: Column) -> Column:
    """The lines a bitmap keeps; all of them without a bitmap."""
    run = lambda r: F.slice(
        all_lines,
        r["start"] + 1,
        F.coalesce(r["length"], F.size(all_lines) - r["start"]),
    )
    return F.when(keep.isNull(), all_lines).otherwise(F.flatten(F.transform(keep, run)))


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text", **bounds: int) -> DataFrame:
    """``docs`` with the shared lines taken out of ``text``, and ``n_lines``, ``n_dropped``.

    Null and empty texts have one empty line and stay as they are (null becomes empty).
    Input columns with the names of results give way to them.
    """
    bitmaps = keep_bitmaps(docs, key, text, **bounds)
    results = ("n_lines", "n_dropped")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (*results, text)]).alias("_row"),
        F.col(f"`{key}`").alias("doc"),
        t.alias("_text"),
        F.xxhash64(t).alias("content"),
    )
    joined = row.join(bitmaps, ["doc", "content"], "left").withColumn("_lines", lines(F.col("_text")))
    changed = F.when(F.col("keep").isNull(), F.col("_text")).otherwise(
        F.array_join(kept_lines(F.col("_lines"), F.col("keep")), "\n")
    )
    out = joined.select(
        "_row.*",
        changed.alias(text),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.col("n_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return out.select(*[f"`{c}`" for c in docs.columns if c not in results], *results)
