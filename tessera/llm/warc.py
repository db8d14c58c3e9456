"""WARC derivatives: metadata and plain-text conversion records for response records.

A response record is read from its serialised form: record headers, then the HTTP message.
Each gives one metadata record and one conversion record that refer to it and keep its
target, its date, its own header lines and the digest of its payload. All of it is column
expressions over one row, so nothing is shuffled and large tables only stream through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
#: Date of records whose source tells none.
NO_DATE = "1970-01-01T00:00:00Z"
# fixed values: line ends of the format, and the entities that are resolved
END = "\r\n"
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&#160;", " "), ("&amp;", "&"),
]
#: Parts of an HTML text that are dropped: comments and elements up to their own closing tag, then heads. As
#: ``</head>`` may be omitted, a head also ends before the first tag that is not one of its own.
PAIRED = (
    r"(?is)<(?:!--(?:.*?-->|.*+)"
    r"|(script|style|nav|noscript|template)(?=[\s/>])(?:.*?</\1\s*+>|.*+))"
)
HEADS = (
    r"(?is)<head(?=[\s/>])[^>]*+>(?:[^<]++|<title(?=[\s/>]).*?</title\s*+>"
    r"|<(?:title|meta|link|base|basefont|bgsound|noframes)(?=[\s/>])|<(?![a-z]|/head\s*+>))*+(?:</head\s*+>)?"
)
#: The same in one pattern without back-references, for pages that close every part; the SQL twin reads it.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style|head|nav|noscript|template)\b.*?(?:</(?:script|style|head|nav|noscript|template)\s*>|\z)"
#: Patterns that end a line and that are left out.
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>"
TAGS = r"<[a-zA-Z/!?][^>]*>"

COLUMNS = (
    "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_headers",
    "source_payload_digest", "block_digest", "content_length", "block",
)


def uuid_of(text: Column) -> Column:
    """A record id that depends on the text only."""
    h = F.md5(text)
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(
        F.lit("<urn:uuid:"),
        F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)),
        F.lit(">"),
    )


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def as_responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, record): each page as a serialised response record. Null html is an empty
    payload; a null url leaves the target out. Line ends in a url are percent-encoded, as
    they would end its header line."""
    body = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    http = F.concat_ws(
        END,
        F.lit("HTTP/1.1 200 OK"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
        F.lit(""),
        body,
    )
    target = F.col(f"`{url}`")
    name = F.concat_ws("|", F.lit("response"), F.col(f"`{key}`").cast("string"), target)
    rows = pages.select(
        F.col(f"`{key}`").alias("key"),
        F.replace(F.replace(target, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("_url"),
        digest(body).alias("_payload"),
        http.alias("_http"),
        uuid_of(name).alias("_id"),
    )
    headers = [
        ("WARC-Type", F.lit("response")),
        ("WARC-Record-ID", F.col("_id")),
        ("WARC-Date", F.lit(NO_DATE)),
        ("WARC-Target-URI", F.col("_url")),
        ("WARC-Payload-Digest", F.col("_payload")),
        ("WARC-Block-Digest", digest(F.col("_http"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    return rows.select(F.col("key").alias(key), serialised(headers, F.col("_http")).alias("record"))


def serialised(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record in the format's own form; headers without a value are left out."""
    lines = [F.concat(F.lit(f"{n}: "), c) for n, c in headers]
    return F.concat(
        F.concat_ws(
            END,
            F.lit(VERSION),
            *lines,
            F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        ),
        F.lit(END + END),
        block,
        F.lit(END + END),
    )


def _before(text: Column, mark: str) -> Column:
    at = F.instr(text, F.lit(mark))
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)


def _after(text: Column, mark: str) -> Column:
    at = F.instr(text, F.lit(mark))
    return F.when(at > 0, F.substr(text, at + len(mark))).otherwise(F.lit(""))


def header(lines: Column, name: str) -> Column:
    """Value of the first header line of this name, in any case; null if there is none."""
    start = name.lower() + ":"
    of = F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit(start)))
    return F.trim(F.substr(F.get(of, F.lit(0)), F.lit(len(start) + 1)))


def parsed(records: DataFrame, key: str = "page_id", record: str = "record") -> DataFrame:
    """(key, headers, http_headers, payload) of serialised records. The block ends where
    its last line ends; text without a blank line has headers only."""
    text = F.coalesce(F.col(f"`{record}`"), F.lit(""))
    rows = records.select(
        F.col(f"`{key}`").alias(key),
        _before(text, END + END).alias("_head"),
        F.regexp_replace(_after(text, END + END), r"\r\n\r\n\z", "").alias("_block"),
    )
    return rows.select(
        key,
        F.split("_head", END, -1).alias("headers"),
        F.split(_before(F.col("_block"), END + END), END, -1).alias("http_headers"),
        _after(F.col("_block"), END + END).alias("payload"),
    )


def plain_text(html: Column) -> Column:
    """Visible text: hidden parts out, one line per block, entities resolved, blanks joined."""
    t = F.regexp_replace(F.regexp_replace(html, PAIRED, " "), HEADS, " ")
    t = F.regexp_replace(t, r"[ \t\r\n]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, BREAKS, "\n"), TAGS, "")
    for name, sign in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(t, r" *\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+\z", "")


def derive(records: DataFrame, key: str = "page_id", record: str = "record") -> DataFrame:
    """Two rows per response record: key and COLUMNS.

    Records of other types give no rows. A response without id gets one from its text. An
    empty payload gives an empty conversion block. Repeated records give repeated
    derivatives with the same ids; an empty table gives an empty one.
    """
    p = parsed(records, key, record)
    h = F.col("headers")
    read = p.select(
        key,
        F.coalesce(header(h, "WARC-Record-ID"), uuid_of(F.array_join(h, END))).alias("_of"),
        header(h, "WARC-Type").alias("_type"),
        header(h, "WARC-Target-URI").alias("_target"),
        F.coalesce(header(h, "WARC-Date"), F.lit(NO_DATE)).alias("_date"),
        F.coalesce(header(F.col("http_headers"), "Content-Type"), F.lit("application/octet-stream")).alias("_kind"),
        F.array_join(F.concat(F.slice(h, F.lit(2), F.size(h)), F.col("http_headers")), "\n").alias("_lines"),
        digest(F.col("payload")).alias("_payload"),
        F.octet_length("payload").alias("_size"),
        plain_text(F.col("payload")).alias("_text"),
    ).filter("_type = 'response'")
    facts = F.concat_ws(
        END,
        F.concat(F.lit("source-content-type: "), F.col("_kind")),
        F.concat(F.lit("source-payload-length: "), F.col("_size").cast("string")),
        F.concat(F.lit("source-payload-digest: "), F.col("_payload")),
        F.concat(F.lit("text-digest: "), digest(F.col("_text"))),
        F.concat(F.lit("text-length: "), F.length("_text").cast("string")),
    )
    made = lambda kind, content, block: F.struct(
        F.lit(kind).alias("record_type"),
        uuid_of(F.concat(F.lit(f"{kind}|"), F.col("_of"))).alias("record_id"),
        F.col("_of").alias("refers_to"),
        F.col("_target").alias("target_uri"),
        F.col("_date").alias("date"),
        F.lit(content).alias("content_type"),
        F.col("_lines").alias("source_headers"),
        F.col("_payload").alias("source_payload_digest"),
        digest(block).alias("block_digest"),
        F.octet_length(block).cast("long").alias("content_length"),
        block.alias("block"),
    )
    read = read.withColumn("_facts", facts)
    both = F.array(
        made("metadata", "application/warc-fields", F.col("_facts")),
        made("conversion", "text/plain; charset=utf-8", F.col("_text")),
    )
    return read.select(key, F.inline(both)).select(key, *COLUMNS)


def written(derived: DataFrame) -> DataFrame:
    """``derived`` with ``record``, the serialised form of every row."""
    headers = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.col("record_id")),
        ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Date", F.col("date")),
        ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("content_type")),
    ]
    return derived.withColumn("record", serialised(headers, F.col("block")))
