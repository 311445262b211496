"""Operator 5, WARC derivatives: every response record gives a linked metadata
record and a plain-text conversion record. Both refer to the response by its
record id and keep its target URI, date, HTTP headers and digests.

The records are columns (named fields and the block) and whole serialised
records; ``write_records`` writes them as WARC files. Text is taken from HTML
by pattern: comments, scripts, styles and the head go, block elements end a
line, other tags go, white space is folded. Character references, numeric and
of the whole HTML set of names, are resolved in the text, the title and the
outlinks; in outlinks only those that end in a semicolon, so that a query
string keeps its ``&copy=``. No-break spaces count as spaces.

Defined results: a null URL gives records without a target URI; null or empty
HTML gives an empty payload and an empty conversion block; repeated rows give
repeated records of the same ids, rows of one id and URL but other payloads
records of their own; a null page id counts as an empty one in the record id;
a reference that names nothing stays as it is; an empty table gives none. Columns besides the named ones are not
read."""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import array_udf, prepare

VERSION = "WARC/1.1"
#: capture date of pages that carry none
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: patterns taken out or replaced, in this order (they read alike in both engines)
STEPS = [(r"(?is)<!--.*?-->", ""), (r"(?is)<head\b.*?</head\s*>", ""), (r"(?is)<script\b.*?</script\s*>", ""), (r"(?is)<style\b.*?</style\s*>", ""),
         (r"(?i)<(?:/?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|nav|header|footer|blockquote|pre)\b|br\b)[^>]*>", "\n"), (r"(?s)<[^>]*>", "")]
_REFERENCE = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_FOLDS = [(r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", "")]


def sha1_digest(data: Column) -> Column:
    """``sha1:`` and the digest in base 32, as archives label it."""
    hexa = F.sha1(data)
    groups = [F.conv(F.substring(hexa, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    letters = [F.substring(F.lit(_BASE32), F.shiftright(g, 15 - 5 * i).bitwiseAND(F.lit(31)) + F.lit(1), F.lit(1)) for g in groups for i in range(4)]
    return F.concat(F.lit("sha1:"), *letters)


def record_id(*parts: Column) -> Column:
    """A urn made from a digest of the parts, so that a rerun repeats it."""
    h = F.md5(F.concat_ws("\x00", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def resolve_text(text: str) -> str:
    """Character references in running text, the old names without a
    semicolon too."""
    return markup.unescape(text) if "&" in text else text


def resolve_attribute(text: str) -> str:
    """Those that end in a semicolon."""
    return _REFERENCE.sub(lambda m: markup.unescape(m[0]), text) if "&" in text else text


def fold(text: str) -> str:
    """A run of blanks to one, lines without end blanks, blank lines gone."""
    for blank in "\t\r\f\u00a0":
        text = text.replace(blank, " ")
    lines = (" ".join(filter(None, line.split(" "))) for line in text.split("\n"))
    return "\n".join(filter(None, lines))


def _resolved(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Arrays of a text, a title and links -> the same without references, the
    text folded, the title without no-break spaces."""
    for batch in batches:
        rows = []
        for text, title, *links in batch.to_pylist():
            rows.append([fold(resolve_text(text)), resolve_text(title).replace("\u00a0", " "), *map(resolve_attribute, links)])
        yield pa.array(rows, pa.list_(pa.string()))


def _without_tags(html: Column) -> Column:
    for pattern, put in STEPS:
        html = F.regexp_replace(html, pattern, put)
    return html


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """Response records of raw pages: ``page_id, record_id, target_uri, date,
    http, payload, payload_digest, block_digest``."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    http = F.concat(F.lit(HTTP + "Content-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n"))
    base = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("target_uri"), payload.alias("payload"), http.alias("http"))
    base = base.withColumn("payload_digest", sha1_digest(F.col("payload")))
    name = record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("target_uri", F.lit("")), F.col("payload_digest"))
    return base.select("page_id", name.alias("record_id"), "target_uri", F.lit(date).alias("date"), "http", "payload", "payload_digest",
                       sha1_digest(F.concat("http", F.lit("\r\n"), "payload")).alias("block_digest"))


def _named(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise(F.lit(""))


def derivatives(response: DataFrame) -> DataFrame:
    """Two records for each response (columns as ``responses`` gives them):
    ``page_id, warc_type, record_id, refers_to, target_uri, date,
    content_type, block, block_digest, source_payload_digest, record``."""
    prepare(response.sparkSession)
    title = F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    language = F.regexp_extract("payload", r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    links = F.regexp_extract_all("payload", F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    read = array_udf(_resolved, T.ArrayType(T.StringType()))
    response = response.withColumn("__read", read(F.concat(F.array(_without_tags(F.col("payload")), title), links)))
    title = F.col("__read")[1]
    links = F.array_distinct(F.transform(F.slice("__read", 3, F.size("__read")), lambda x: F.regexp_replace(x, r"[\x00-\x20]+", "")))
    outlinks = F.concat_ws("", F.transform(links, lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n"))))
    source = F.concat_ws("", F.transform(F.filter(F.split("http", "\r\n"), lambda x: x != ""), lambda x: F.concat(F.lit("source-header: "), x, F.lit("\r\n"))))
    fields = F.concat(_named("title", F.when(title != "", F.regexp_replace(title, r"[\r\n]+", " "))), _named("language", F.when(language != "", language)), source,
                      _named("source-payload-digest", F.col("payload_digest")), _named("source-block-digest", F.col("block_digest")),
                      _named("source-length", F.octet_length("payload").cast("string")), outlinks)
    kinds = F.array(F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
                    F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("__read")[0].alias("block")))
    made = response.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.inline(kinds))
    made = made.select("page_id", "warc_type", record_id("warc_type", "refers_to").alias("record_id"), "refers_to", "target_uri", "date", "content_type", "block",
                       sha1_digest(F.col("block")).alias("block_digest"), F.col("payload_digest").alias("source_payload_digest"))
    record = F.concat(F.lit(VERSION + "\r\n"), _named("WARC-Type", F.col("warc_type")), _named("WARC-Record-ID", F.col("record_id")),
                      _named("WARC-Refers-To", F.col("refers_to")), _named("WARC-Refers-To-Target-URI", F.col("target_uri")), _named("WARC-Refers-To-Date", F.col("date")),
                      _named("WARC-Target-URI", F.col("target_uri")), _named("WARC-Date", F.col("date")), _named("WARC-Block-Digest", F.col("block_digest")),
                      _named("Content-Type", F.col("content_type")), _named("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), "block")
    return made.withColumn("record", record)


def write_records(records: DataFrame, path: str) -> None:
    """Write the serialised records as WARC files, one a task: records end
    with two line breaks."""
    records.select("record").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def digests(records: DataFrame) -> DataFrame:
    """What identifies each record, without its text."""
    return records.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type",
                          F.octet_length("block").cast("long").alias("content_length"), "block_digest", "source_payload_digest",
                          F.sha2("record", 256).alias("record_sha256"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _crlf(s: str) -> str:
    """A DuckDB text literal with its line breaks escaped."""
    return "e'" + s.replace("\\", "\\\\").replace("'", "''").replace("\r", "\\r").replace("\n", "\\n") + "'"


def _sql_digest(column: str) -> str:
    g = [f"('0x' || substr(sha1({column}), {5 * i + 1}, 5))::INT" for i in range(8)]
    return "'sha1:' || " + " || ".join(f"substr('{_BASE32}', (({x} >> {15 - 5 * i}) & 31) + 1, 1)" for x in g for i in range(4))


def _sql_id(*parts: str) -> str:
    joined = " || chr(0) || ".join(parts)
    cut = " || '-' || ".join(f"substr(md5({joined}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {cut} || '>'"


# fixed values: the names of the characters 160 to 255, in order, and some others; SQL has no
# function for references, so its names are stated here apart from those the operator uses
_LATIN = ("nbsp iexcl cent pound curren yen brvbar sect uml copy ordf laquo not shy reg macr deg plusmn sup2 sup3 acute micro para middot cedil sup1 ordm raquo "
          "frac14 frac12 frac34 iquest Agrave Aacute Acirc Atilde Auml Aring AElig Ccedil Egrave Eacute Ecirc Euml Igrave Iacute Icirc Iuml ETH Ntilde Ograve "
          "Oacute Ocirc Otilde Ouml times Oslash Ugrave Uacute Ucirc Uuml Yacute THORN szlig agrave aacute acirc atilde auml aring aelig ccedil egrave eacute "
          "ecirc euml igrave iacute icirc iuml eth ntilde ograve oacute ocirc otilde ouml divide oslash ugrave uacute ucirc uuml yacute thorn yuml").split()
_OTHERS = {"amp": 38, "lt": 60, "gt": 62, "quot": 34, "apos": 39, "ndash": 8211, "mdash": 8212, "lsquo": 8216, "rsquo": 8217, "ldquo": 8220, "rdquo": 8221,
           "bull": 8226, "hellip": 8230, "euro": 8364, "trade": 8482}


def _sql_resolved(column: str) -> str:
    """Cut at ampersands; each piece begins with a reference or with none."""
    names = {n: 160 + i for i, n in enumerate(_LATIN)} | _OTHERS
    known = "MAP {" + ", ".join(f"'{n}': {c}" for n, c in names.items()) + "}"
    name, rest = "regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*);', 1)", "substr(p, instr(p, ';') + 1)"
    piece = (f"CASE WHEN regexp_matches(p, '^#[0-9]+;') THEN chr(regexp_extract(p, '^#([0-9]+);', 1)::INT) || {rest} "
             f"WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]+;') THEN chr(('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]+);', 1))::INT) || {rest} "
             f"WHEN {known}[{name}] IS NOT NULL THEN chr({known}[{name}]) || {rest} ELSE '&' || p END")
    return f"(string_split({column}, '&')[1] || coalesce(list_aggregate([{piece} for p in string_split({column}, '&')[2:]], 'string_agg', ''), ''))"


def _sql_text(column: str) -> str:
    for pattern, put in STEPS:
        column = f"regexp_replace({column}, {_quoted(pattern)}, {_crlf(put)}, 'g')"
    column = f"replace({_sql_resolved(column)}, chr(160), ' ')"
    for pattern, put in _FOLDS:
        column = f"regexp_replace({column}, {_quoted(pattern)}, {_crlf(put)}, 'g')"
    return column


def _line(name: str, value: str) -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN '{name}: ' || {value} || e'\\r\\n' ELSE '' END"


#: the rows of ``digests(derivatives(responses(pages)))`` in DuckDB SQL
ORACLE_SQL = f"""
WITH r AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS payload,
    {_crlf(HTTP + 'Content-Length: ')} || strlen(coalesce(html, '')) || e'\\r\\n' AS http FROM pages),
d AS MATERIALIZED (SELECT *, {_sql_id("'response'", "coalesce(page_id::VARCHAR, '')", "coalesce(target_uri, '')", _sql_digest('payload'))} AS refers_to,
    {_sql_digest('payload')} AS payload_digest, {_sql_digest("(http || e'" + chr(92) + "r" + chr(92) + "n' || payload)")} AS source_block,
    regexp_replace(replace({_sql_resolved("regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title" + chr(92) + "s*>', 1)")}, chr(160), ' '), '[\\r\\n]+', ' ', 'g') AS title,
    regexp_extract(payload, '(?is)<html\\b[^>]*\\blang\\s*=\\s*["'']?([A-Za-z-]+)', 1) AS lang,
    [regexp_replace({_sql_resolved('h')}, '[\\x00-\\x20]+', '', 'g') for h in regexp_extract_all(payload, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)] AS hrefs FROM r),
k AS (SELECT page_id, target_uri, refers_to, payload_digest, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    CASE WHEN title <> '' THEN 'title: ' || title || e'\\r\\n' ELSE '' END || CASE WHEN lang <> '' THEN 'language: ' || lang || e'\\r\\n' ELSE '' END
    || list_aggregate(list_transform(list_filter(string_split(http, e'\\r\\n'), lambda x: x <> ''), lambda x: 'source-header: ' || x || e'\\r\\n'), 'string_agg', '')
    || {_line('source-payload-digest', 'payload_digest')} || {_line('source-block-digest', 'source_block')} || 'source-length: ' || strlen(payload) || e'\\r\\n'
    || coalesce(list_aggregate(list_transform(list_filter(hrefs, lambda x, i: list_position(hrefs, x) = i), lambda x: 'outlink: ' || x || e'\\r\\n'), 'string_agg', ''), '') AS block FROM d
  UNION ALL SELECT page_id, target_uri, refers_to, payload_digest, 'conversion', 'text/plain; charset=utf-8', {_sql_text('payload')} FROM d),
w AS (SELECT *, {_sql_id('warc_type', 'refers_to')} AS record_id, {_sql_digest('block')} AS block_digest FROM k)
SELECT page_id, warc_type, record_id, refers_to, target_uri, content_type, strlen(block) AS content_length, block_digest, payload_digest AS source_payload_digest,
    sha256({_crlf(VERSION + chr(13) + chr(10))} || {_line('WARC-Type', 'warc_type')} || {_line('WARC-Record-ID', 'record_id')} || {_line('WARC-Refers-To', 'refers_to')}
    || {_line('WARC-Refers-To-Target-URI', 'target_uri')} || {_line('WARC-Refers-To-Date', _quoted(DATE))} || {_line('WARC-Target-URI', 'target_uri')} || {_line('WARC-Date', _quoted(DATE))}
    || {_line('WARC-Block-Digest', 'block_digest')} || {_line('Content-Type', 'content_type')} || 'Content-Length: ' || strlen(block) || e'\\r\\n' || e'\\r\\n' || block) AS record_sha256
FROM w
"""
