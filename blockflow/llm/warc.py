"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

``responses`` makes response records of crawled pages, ``derive`` turns every response into two
records that refer to it: a metadata record (application/warc-fields) with the source's headers,
digests, title and links, and a conversion record (text/plain) with the visible text. Identifiers
are made from content, so running again gives the same ones. ``write_warc`` writes records as WARC
files. Each response is handled by itself: nothing is shuffled and no Python runs.

Text: comments, scripts, styles and the title go, block tags become line ends, other tags nothing,
the named entities below are decoded (numeric ones stay as they are), blanks are folded.

Defined results: a null page is an empty one, a null address an empty one; repeated rows give
repeated records; extra columns are not read; an empty table gives no records. Patterns take time
linear in the page; tags and comments that are never closed reach to the end.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockflow.llm.common import table

# Named entities and their characters; the ampersand comes last.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "middot": "·",
            "copy": "©", "reg": "®", "hellip": "…", "ndash": "–", "mdash": "—", "laquo": "«",
            "raquo": "»", "amp": "&"}
BLOCK_TAGS = ["address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt",
              "figcaption", "figure", "footer", "form", "h[1-6]", "head", "header", "hr", "html",
              "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"]
CRAWLED = "2024-01-01T00:00:00Z"  # date of responses whose source has none

# What goes, in this order, and what takes its place.
_STEPS = [(r"(?s)<!--.*?(-->|\z)", ""),
          *((rf"(?is)<{t}\b[^<>]*>.*?(</{t}\s*>|\z)", "") for t in ("script", "style", "title")),
          (r"(?i)</?(" + "|".join(BLOCK_TAGS) + r")\b[^<>]*>", "\n"), (r"<[/!?a-zA-Z][^<>]*>", "")]
_FOLDS = [(r"[ \t\r\f\x0b]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", "")]
_TITLE = r"(?is)<title\b[^<>]*>(.*?)</title"
_LINK = r"(?i)<a\s[^<>]*?href=\"([^\"<>]*)\""


def _decoded(text: Column) -> Column:
    for name, character in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(character))
    return text


def _replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def plain_text(html: Column) -> Column:
    """The visible text of a page."""
    return _replaced(_decoded(_replaced(html, _STEPS)), _FOLDS)


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def _record_id(*parts: Column) -> Column:
    """A URN made of content."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
        F.substring(F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256), 1, 32),
        "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def responses(pages: DataFrame, date: str = CRAWLED) -> DataFrame:
    """Response records of pages (page_id, url, html)."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                          "Content-Length: "), F.octet_length(html).cast("string"))
    return pages.select(
        "page_id", _record_id(F.lit("response"), url, html).alias("record_id"),
        url.alias("target_uri"), F.lit(date).alias("date"), http.alias("http_headers"),
        html.alias("payload"))


def derive(records: DataFrame, key: str) -> DataFrame:
    """A metadata and a conversion record for each response record; ``key`` names a column that
    goes along."""
    source = records.select(
        F.col(key).alias("key"), "record_id", "target_uri", "date", "http_headers", "payload",
        plain_text(F.col("payload")).alias("text"),
        _replaced(_decoded(F.regexp_extract("payload", _TITLE, 1)),
                  [(r"[ \t\r\f\x0b\n]+", " "), (r"^ | $", "")]).alias("title"),
        F.regexp_extract_all("payload", F.lit(_LINK), F.lit(1)).alias("links"))
    source = source.select(
        "*", _record_id(F.lit("conversion"), F.col("record_id"), F.col("text")).alias("text_id"),
        _digest(F.col("payload")).alias("source_payload_digest"),
        _digest(F.concat("http_headers", F.lit("\r\n\r\n"), "payload")).alias("source_digest"))
    fields = F.concat(
        F.lit("sourceBlockDigest: "), "source_digest", F.lit("\r\nsourcePayloadDigest: "),
        "source_payload_digest", F.lit("\r\nconversion: "), "text_id", F.lit("\r\ntitle: "),
        "title", F.concat_ws("", F.transform("links", lambda x: F.concat(F.lit("\r\noutlink: "),
                                                                         x))),
        F.lit("\r\n"), F.concat_ws("", F.transform(
            F.split("http_headers", "\r\n"),
            lambda x: F.concat(F.lit("sourceHeader: "), x, F.lit("\r\n")))))
    source = source.withColumn("fields", fields)

    def record(kind: str, record_id: Column, content_type: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), record_id.alias("record_id"),
                        F.lit(content_type).alias("content_type"), block.alias("block"),
                        _digest(block).alias("block_digest"),
                        F.octet_length(block).cast("long").alias("content_length"))

    both = F.array(
        record("metadata", _record_id(F.lit("metadata"), F.col("record_id"), F.col("fields")),
               "application/warc-fields", F.col("fields")),
        record("conversion", F.col("text_id"), "text/plain; charset=utf-8", F.col("text")))
    made = source.select("key", F.col("record_id").alias("refers_to"), "target_uri", "date",
                         "source_payload_digest", F.explode(both).alias("r"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("r.record_type"), F.lit("\r\nWARC-Record-ID: "),
        F.col("r.record_id"), F.lit("\r\nWARC-Refers-To: "), F.col("refers_to"),
        F.lit("\r\nWARC-Target-URI: "), F.col("target_uri"), F.lit("\r\nWARC-Date: "),
        F.col("date"), F.lit("\r\nWARC-Block-Digest: "), F.col("r.block_digest"),
        F.lit("\r\nContent-Type: "), F.col("r.content_type"), F.lit("\r\nContent-Length: "),
        F.col("r.content_length").cast("string"))
    return made.select(F.col("key").alias(key), "r.record_type", "r.record_id", "refers_to",
                       "target_uri", "source_payload_digest", "r.block_digest",
                       "r.content_length", header.alias("header"), "r.block")


def write_warc(records: DataFrame, path: str) -> None:
    """Records (header, block) as WARC files, one per task, gzipped."""
    records.select(F.concat("header", F.lit("\r\n\r\n"), "block")).write.option(
        "lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both records of every page."""
    return derive(responses(table(spark, sf_dir, "pages")), "page_id")


def _sql(value: str) -> str:
    plain = value.replace("'", "''")
    for character in "\r\n\t":
        plain = plain.replace(character, f"' || chr({ord(character)}) || '")
    return f"('{plain}')"


def _sql_replaced(text: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        text = f"regexp_replace({text}, {_sql(pattern)}, {_sql(by)}, 'g')"
    return text


def _sql_decoded(text: str) -> str:
    for name, character in ENTITIES.items():
        text = f"replace({text}, '&{name};', {_sql(character)})"
    return text


def _sql_id(*parts: str) -> str:
    digest = f"sha256({' || chr(10) || '.join(parts)})"
    cuts = " || '-' || ".join(f"substr({digest}, {a}, {n})" for a, n in
                              [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)])
    return f"('<urn:uuid:' || {cuts} || '>')"


_NL = "chr(13) || chr(10)"
_TITLE_SQL = _sql_replaced(_sql_decoded(f"regexp_extract(payload, {_sql(_TITLE)}, 1)"),
                           [(r"[ \t\r\f\x0b\n]+", " "), (r"^ | $", "")])
ORACLE = f"""
with p as (select page_id, coalesce(url, '') as target_uri, coalesce(html, '') as payload
           from pages),
r as (select *, {_sql_id("'response'", "target_uri", "payload")} as refers_to,
        {_sql("HTTP/1.1 200 OK" + chr(13) + chr(10) + "Content-Type: text/html; charset=utf-8"
              + chr(13) + chr(10) + "Content-Length: ")} || strlen(payload) as http,
        {_sql_replaced(_sql_decoded(_sql_replaced("payload", _STEPS)), _FOLDS)} as text,
        {_TITLE_SQL} as title,
        regexp_extract_all(payload, {_sql(_LINK)}, 1) as links from p),
s as (select *, {_sql_id("'conversion'", "refers_to", "text")} as text_id,
        'sha256:' || sha256(payload) as source_payload_digest from r),
t as (select *, 'sourceBlockDigest: sha256:' || sha256(http || {_NL} || {_NL} || payload)
        || {_NL} || 'sourcePayloadDigest: ' || source_payload_digest || {_NL} || 'conversion: '
        || text_id || {_NL} || 'title: ' || title
        || array_to_string(list_transform(links, lambda x: {_NL} || 'outlink: ' || x), '')
        || {_NL} || array_to_string(list_transform(string_split(http, {_NL}),
             lambda x: 'sourceHeader: ' || x || {_NL}), '') as fields from s),
u as (select page_id, refers_to, target_uri, source_payload_digest, 'metadata' as record_type,
        {_sql_id("'metadata'", "refers_to", "fields")} as record_id,
        'application/warc-fields' as content_type, fields as block from t
      union all
      select page_id, refers_to, target_uri, source_payload_digest, 'conversion', text_id,
        'text/plain; charset=utf-8', text from t)
select page_id, record_type, record_id, refers_to, target_uri, source_payload_digest,
  'sha256:' || sha256(block) as block_digest, strlen(block)::bigint as content_length,
  'WARC/1.1' || {_NL} || 'WARC-Type: ' || record_type || {_NL} || 'WARC-Record-ID: ' || record_id
  || {_NL} || 'WARC-Refers-To: ' || refers_to || {_NL} || 'WARC-Target-URI: ' || target_uri
  || {_NL} || 'WARC-Date: {CRAWLED}' || {_NL} || 'WARC-Block-Digest: sha256:' || sha256(block)
  || {_NL} || 'Content-Type: ' || content_type || {_NL} || 'Content-Length: ' || strlen(block)
    as header, block
from u"""

QUERIES = {"op1_warc_derivatives": op1_warc_derivatives}
ORACLES = {"op1_warc_derivatives": ORACLE}
