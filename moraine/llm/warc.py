"""WARC derivatives: responses to linked metadata and plain-text conversion records.

A response record's block is an HTTP message. Its headers are split off, the
payload is converted to text by an ordered list of replacements, and two records
come of it, each naming the response in ``refers_to``: ``metadata``, in
application/warc-fields, with the source's status, headers, digests, title and
outlinks, and ``conversion``, in text/plain. Everything is a DataFrame expression
on one row, so nothing is shuffled and a record costs what its bytes cost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import table

CRLF = "\r\n"
CAPTURED = "2024-01-01T00:00:00Z"

#: Patterns and what replaces them, in order.
REMOVE = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
BREAK = (
    r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p"
    r"|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
)
TAG = r"(?s)</?[A-Za-z!][^>]*>"
BLANKS = r"[ \t\f\r\x{A0}]+"
LINES = r" ?\n[ \n]*"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
HREF = r"(?is)<a\b[^>]*?\bhref\s*=\s*\"([^\"]*)\""

#: Character references resolved, the ampersand's last.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#34;": '"',
    "&#160;": " ", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&ndash;": "–", "&mdash;": "—",
    "&hellip;": "…", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&euro;": "€", "&amp;": "&",
}


def _urn(kind: str, key: Column) -> Column:
    """A stable record id: the digest of kind and key, written as a UUID."""
    d = F.md5(F.concat(F.lit(f"{kind}:"), key))
    parts = [F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def responses(pages: DataFrame, captured: str = CAPTURED) -> DataFrame:
    """Response records of crawled pages; a null page is an empty payload."""
    html = F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(html).cast("string"),
        F.lit(CRLF + CRLF),
    )
    return pages.select(
        "page_id",
        _urn("response", F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(captured).alias("warc_date"),
        F.concat(head, html).alias("block"),
    )


def to_text(html: Column) -> Column:
    """Plain text of a page: one line for each block element."""
    text = F.regexp_replace(html, REMOVE, "")
    text = F.regexp_replace(F.regexp_replace(text, BREAK, "\n"), TAG, "")
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)
    text = F.regexp_replace(F.regexp_replace(text, BLANKS, " "), LINES, "\n")
    return F.trim(F.btrim(text, F.lit("\n ")))


def derive(records: DataFrame) -> DataFrame:
    """Two records a response: metadata first, then the conversion.

    ``records`` are responses (page_id, record_id, target_uri, warc_date, block). A
    block without a blank line is all header, with an empty payload; a null block
    is empty. Repeated responses give repeated records with equal ids. Extra
    columns are ignored. Empty input, empty result.
    """
    block = F.coalesce("block", F.lit(""))
    split = F.instr("message", CRLF + CRLF)
    parts = records.select("page_id", "record_id", "target_uri", "warc_date", block.alias("message")).select(
        "*",
        F.when(split > 0, F.expr("substring(message, 1, instr(message, '\\r\\n\\r\\n') - 1)")).otherwise(F.col("message")).alias("head"),
        F.when(split > 0, F.expr("substring(message, instr(message, '\\r\\n\\r\\n') + 4)")).otherwise(F.lit("")).alias("payload"),
    )
    status = F.regexp_extract("head", r"^HTTP/[0-9.]+ ([0-9]+)", 1)
    headers = F.regexp_replace("head", r"^HTTP/[^\r\n]*(?:\r\n)?", "")
    facts = parts.select(
        "page_id",
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        status.alias("status"),
        headers.alias("source_headers"),
        _digest(F.col("message")).alias("source_block_digest"),
        _digest(F.col("payload")).alias("payload_digest"),
        F.trim(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"\s+", " ")).alias("title"),
        F.regexp_extract_all("payload", F.lit(HREF), F.lit(1)).alias("links"),
        to_text(F.col("payload")).alias("text"),
    )
    outlinks = F.array_join(F.transform("links", lambda u: F.concat(F.lit("outlink: "), u, F.lit(f" L a/@href{CRLF}"))), "")
    fields = F.concat(
        F.lit("http-status: "), F.col("status"),
        F.lit(f"{CRLF}source-block-digest: "), F.col("source_block_digest"),
        F.lit(f"{CRLF}source-payload-digest: "), F.col("payload_digest"),
        F.lit(f"{CRLF}title: "), F.col("title"),
        F.lit(f"{CRLF}text-length: "), F.octet_length("text").cast("string"), F.lit(CRLF), outlinks,
    )

    def record(kind: str, mime: str, body: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("warc_type"),
            _urn(kind, F.col("refers_to")).alias("record_id"),
            F.lit(mime).alias("content_type"),
            body.alias("block"),
        )

    both = F.array(record("metadata", "application/warc-fields", fields), record("conversion", "text/plain", F.col("text")))
    out = facts.withColumn("r", F.explode(both))
    return out.select(
        "page_id", "r.warc_type", "r.record_id", "refers_to", "target_uri", "warc_date", "r.content_type",
        F.octet_length("r.block").cast("long").alias("content_length"), _digest(F.col("r.block")).alias("block_digest"),
        "payload_digest", "source_headers", "r.block",
    )


def render(records: DataFrame) -> DataFrame:
    """(record_id, warc string): derived records as WARC/1.1 text, ready to be written.

    The response's own headers stand in ``WARC-Source-Header`` fields, one each; its
    payload's digest and its URI and date in the fields that the standard names.
    """

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))

    each = F.filter(F.split(F.coalesce("source_headers", F.lit("")), "\r?\n"), lambda h: h != "")
    source = F.array_join(F.transform(each, lambda h: F.concat(F.lit("WARC-Source-Header: "), h, F.lit(CRLF))), "")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Refers-To-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To-Date", F.col("warc_date")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("warc_date")), line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Payload-Digest", F.col("payload_digest")), source,
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
    )
    return records.select("record_id", F.concat(head, F.lit(CRLF), F.col("block"), F.lit(CRLF + CRLF)).alias("warc"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return derive(responses(table(spark, sf_dir, "pages")))


def oracle() -> str:
    """DuckDB SQL over the pages, built from the same fixed values."""

    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def urn(kind: str, key: str) -> str:
        d = f"md5({lit(kind + ':')} || {key})"
        cut = " || '-' || ".join(f"substr({d}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        return f"'<urn:uuid:' || {cut} || '>'"

    def sub(x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {lit(pattern)}, {to}, 'g')"

    nl = "chr(13) || chr(10)"
    text = sub(sub(sub("payload", REMOVE, "''"), BREAK, "chr(10)"), TAG, "''")
    for name, to in ENTITIES.items():
        text = f"replace({text}, {lit(name)}, {lit(to)})"
    text = sub(sub(text, BLANKS, "' '"), LINES, "chr(10)")
    text = f"trim({text}, chr(10) || ' ')"
    title = f"trim({sub(f'regexp_extract(payload, {lit(TITLE)}, 1)', '[ \\t\\n\\x0B\\f\\r]+', chr(39) + ' ' + chr(39))})"
    links = f"array_to_string(list_transform(regexp_extract_all(payload, {lit(HREF)}, 1), lambda u: 'outlink: ' || u || ' L a/@href' || {nl}), '')"
    return f"""
WITH source AS (
  SELECT page_id, {urn("response", "coalesce(CAST(page_id AS VARCHAR), 'null')")} AS refers_to, url AS target_uri,
    'Content-Type: text/html; charset=utf-8' || {nl} || 'Content-Length: ' || strlen(coalesce(html, '')) AS source_headers,
    coalesce(html, '') AS payload FROM pages
), facts AS (
  SELECT *, 'sha256:' || sha256('HTTP/1.1 200 OK' || {nl} || source_headers || {nl} || {nl} || payload) AS source_block_digest,
    'sha256:' || sha256(payload) AS payload_digest, {title} AS title, {links} AS outlinks, {text} AS text FROM source
), records AS (
  SELECT *, 'metadata' AS warc_type, {urn("metadata", "refers_to")} AS record_id, 'application/warc-fields' AS content_type,
    'http-status: 200' || {nl} || 'source-block-digest: ' || source_block_digest || {nl} || 'source-payload-digest: ' || payload_digest
    || {nl} || 'title: ' || title || {nl} || 'text-length: ' || strlen(text) || {nl} || outlinks AS block FROM facts
  UNION ALL
  SELECT *, 'conversion', {urn("conversion", "refers_to")}, 'text/plain', text FROM facts
)
SELECT page_id, warc_type, record_id, refers_to, target_uri, '{CAPTURED}' AS warc_date, content_type,
  CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, payload_digest,
  source_headers, block
FROM records"""
