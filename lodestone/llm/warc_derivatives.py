"""WARC derivatives: from each response a metadata record and a plain-text conversion record, both of which refer to it.

Responses come from WARC files (read_warc, then responses) or from a table of pages. Records are made by DataFrame functions. Derived records carry the response's target address, date, HTTP headers and payload digest, and refer to its record id. Where a response has no id of its own, one is made from page, address, date and payload; derived ids are made from the response's id and their kind, so reruns give the same ids, the links hold between files, and two captures of one address differ.

A null or empty page gives records with empty blocks, a null address an empty target, null headers or date empty ones. Line ends and other control characters in an address are percent-encoded, so a header stays a line. Repeated rows give equal records. Columns other than those named aren't read. An empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import releasing

HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
DATE = "2024-01-01T00:00:00Z"
BLOCK_TAGS = "address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
#: What plain text is made of: these before entities are read, and those after.
CUTS = ((r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " "), (rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n"), (r"<[^>]*>", ""))
SPACING = ((r"[\t\r\f ]+", " "), (r" ?\n[ \n]*", "\n"))
# Entities and what they stand for.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "amp": "&", "ndash": "–", "mdash": "—", "hellip": "…", "copy": "©", "reg": "®", "trade": "™", "euro": "€", "pound": "£", "middot": "·", "bull": "•", "laquo": "«", "raquo": "»", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "deg": "°", "sect": "§",
}


def unescaped(text: Column) -> Column:
    """The text with its entities read once: it is cut before each &, and what stands up to the next ; is looked up. Others stay as they are."""
    known = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def read(part: Column, i: Column) -> Column:
        name = F.substring_index(part, ";", 1)
        sign = F.when((i > 0) & F.contains(part, F.lit(";")), F.try_element_at(known, name))
        return F.when(i == 0, part).when(sign.isNotNull(), F.concat(sign, F.substr(part, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), part))

    return F.array_join(F.transform(F.split(text, "&"), read), "")


def plain_text(html: Column) -> Column:
    out = html
    for pattern, by in CUTS:
        out = F.regexp_replace(out, pattern, by)
    out = unescaped(out)
    for pattern, by in SPACING:
        out = F.regexp_replace(out, pattern, by)
    return F.btrim(out, F.lit(" \n"))


def _uuid(name: Column) -> Column:
    h = F.md5(name.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("3"), h.substr(14, 3)), F.concat(F.lit("8"), h.substr(18, 3)), h.substr(21, 12)), F.lit(">"))


def one_line(value: Column) -> Column:
    """A header's value with control characters percent-encoded."""
    out = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "%20")


def derive(df: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", headers: str | None = None, date: str | None = None, record: str | None = None) -> DataFrame:
    """page_id, record_type, record_id, refers_to, target_uri, date, content_type, source_headers, source_digest, block, digest: two rows for each page. headers, date, record: columns with the response's own; without them all have HEADERS and DATE, and ids are made."""
    empty = F.lit("")
    rows = df.select(
        F.col(page).alias("page_id"),
        one_line(F.coalesce(F.col(url), empty)).alias("target_uri"),
        F.coalesce(F.col(html), empty).alias("_html"),
        (F.coalesce(F.col(headers), empty) if headers else F.lit(HEADERS)).alias("source_headers"),
        (F.coalesce(F.col(date).cast("string"), empty) if date else F.lit(DATE)).alias("date"),
        (F.col(record) if record else F.lit(None).cast("string")).alias("_record"),
    )
    rows = rows.withColumns({
        "source_digest": F.concat(F.lit("sha256:"), F.sha2(F.col("_html").cast("binary"), 256)),
        "_title": F.btrim(F.regexp_replace(F.regexp_extract("_html", r"(?is)<title[^>]*>([^<]*)</title", 1), r"[ \n\r\t]+", " "), F.lit(" ")),
        "_links": F.regexp_count("_html", F.lit(r"(?i)<a\b[^>]*\bhref")),
        "_bytes": F.octet_length("_html"),
        "_text": plain_text(F.col("_html")),
    }).drop("_html")
    made = _uuid(F.concat_ws(" ", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), empty), "target_uri", "date", "source_digest"))
    rows = rows.withColumn("refers_to", F.coalesce(F.nullif("_record", empty), made))
    about = F.concat(F.lit("title: "), F.col("_title"), F.lit("\r\noutlinks: "), F.col("_links").cast("string"), F.lit("\r\nsource-length: "), F.col("_bytes").cast("string"), F.lit("\r\nsource-digest: "), F.col("source_digest"), F.lit("\r\n"))

    def derived(kind: str, content_type: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), _uuid(F.concat_ws(" ", F.lit(kind), "refers_to")).alias("record_id"), F.lit(content_type).alias("content_type"), block.alias("block"))

    both = F.explode(F.array(derived("metadata", "application/warc-fields", about), derived("conversion", "text/plain", F.col("_text"))))
    rows = rows.select("page_id", "target_uri", "date", "source_headers", "refers_to", "source_digest", both.alias("r"))
    return rows.select("page_id", "r.record_type", "r.record_id", "refers_to", "target_uri", "date", "r.content_type", "source_headers", "source_digest", "r.block", F.concat(F.lit("sha256:"), F.sha2(F.col("r.block").cast("binary"), 256)).alias("digest"))


#: A gzip member with nothing in it. It stands between records, so each of them is a member of its own that a reader can seek.
NOTHING = bytes.fromhex("1f8b08000000000000ff03000000000000000000")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for record in batch.column(0):
            made = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.append(made.compress(record.as_buffer()) + made.flush())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes records as WARC 1.1 files by Spark's text writer, each gzipped by itself, or plain with compression "none". The source headers are one field, in which \\r, \\n and \\\\ stand for line ends and backslashes; read_warc gives them back as they were."""
    line = F.lit("\r\n")
    http = F.coalesce("source_headers", F.lit(""))
    for plain, by in (("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n")):
        http = F.replace(http, F.lit(plain), F.lit(by))
    head = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("Content-Type", "content_type"), ("WARC-Block-Digest", "digest"), ("WARC-Source-Payload-Digest", "source_digest")]
    parts = [x for name, c in head for x in (F.lit(f"{name}: "), one_line(F.coalesce(F.col(c), F.lit(""))), line)]
    block = F.coalesce("block", F.lit(""))
    value = F.concat(F.lit("WARC/1.1\r\n"), *parts, F.lit("WARC-Source-Headers: "), http, line, F.lit("Content-Length: "), F.octet_length(block).cast("string"), line, line, block, F.lit("\r\n\r\n"))
    if compression == "gzip":
        members = records.select(value.cast("binary").alias("value")).mapInArrow(releasing(_members), "value binary")
        # a binary cast to string keeps its bytes, and the writer puts them down as they are
        members.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).text(path)
    else:
        records.select(F.regexp_replace(value, r"\r\n\r\n\z", "").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


#: What a record begins with.
VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
PIECE = 1 << 20


def _unpacked(data: memoryview) -> Iterator[bytes]:
    """The content in pieces; gzip members follow each other."""
    if bytes(data[:2]) != b"\x1f\x8b":
        for i in range(0, len(data), PIECE):
            yield bytes(data[i : i + PIECE])
        return
    at = 0
    while at < len(data):
        member, rest, end = zlib.decompressobj(31), b"", at
        while not member.eof:
            if not rest:
                if end >= len(data):
                    yield member.flush()
                    if member.eof:
                        break
                    raise ValueError("a gzip member ends early")
                rest, end = data[end : end + PIECE], min(end + PIECE, len(data))
            yield member.decompress(rest, PIECE)
            rest = member.unconsumed_tail
        at = end - len(member.unused_data)


def parse_warc(data) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers in order, repeated ones too, and block of each record of a WARC 1.0 or 1.1 file, plain or gzipped. No more than a record and a piece of the file are unpacked at once. Content without a record is an error, and so is what stands between records."""
    pieces, held, n = _unpacked(memoryview(data)), b"", 0

    def more() -> bool:
        nonlocal held
        piece = next(pieces, None)
        if piece is None:
            return False
        held += piece
        return True

    while True:
        while (held := held.lstrip(b"\r\n")) == b"" and more():
            pass
        if not held:
            break
        while not (end := re.search(rb"\r?\n\r?\n", held)):
            if not more():
                raise ValueError(f"record {n} has no end of its headers")
        if not VERSION.match(held):
            raise ValueError(f"no WARC 1.0 or 1.1 record at {held[:20]!r}")
        lines = held[: end.start()].decode("utf-8", "replace").splitlines()[1:]
        fields: list[tuple[str, str]] = []
        for text in lines:
            if text[:1] in (" ", "\t") and fields:
                fields[-1] = (fields[-1][0], f"{fields[-1][1]} {text.strip()}")
            else:
                name, _, value = text.partition(":")
                fields.append((name, value.strip(" ")))
        size = next((int(v) for k, v in fields if k.lower() == "content-length"), None)
        if size is None:
            raise ValueError(f"record {n} has no Content-Length")
        parts, have = [held[end.end() :]], len(held) - end.end()
        while have < size:
            piece = next(pieces, None)
            if piece is None:
                raise ValueError(f"record {n} ends early")
            parts.append(piece)
            have += len(piece)
        whole = b"".join(parts)
        held, n = whole[size:], n + 1
        yield fields, whole[:size]
    if not n and len(data):
        raise ValueError("no WARC record")


def _told(fields: list[tuple[str, str]]) -> list[tuple[str, str]]:
    unescaped = lambda v: re.sub(r"\\(.)", lambda m: {"r": "\r", "n": "\n"}.get(m[1], m[1]), v)
    return [(k, unescaped(v) if k == "WARC-Source-Headers" else v) for k, v in fields]


PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files: headers (an array of name and value, as they stand), fields (a map with the first value of each name), content (the block's bytes), and block (its text, with the sign for unreadable bytes where there are any). A file without records, or with a broken one, is an error that names it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows) -> pa.RecordBatch:
            heads = pa.array([[{"name": k, "value": v} for k, v in fields] for fields, _ in rows], PAIRS)
            return pa.RecordBatch.from_arrays([heads, pa.array([block for _, block in rows], pa.binary())], ["headers", "content"])

        for files in batches:
            for at, content in zip(files.column(0), files.column(1), strict=True):
                rows, size = [], 0
                try:
                    for fields, block in parse_warc(content.as_buffer()):
                        rows.append((_told(fields), block))
                        size += len(block)
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{at}: {e}") from e
                if rows:
                    yield batch_of(rows)

    records = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(releasing(read), "headers array<struct<name:string,value:string>>, content binary")
    first = F.aggregate("headers", F.create_map().cast("map<string,string>"), lambda m, h: F.when(F.map_contains_key(m, h["name"]), m).otherwise(F.map_concat(m, F.create_map(h["name"], h["value"]))))
    return records.select("headers", first.alias("fields"), "content", F.make_valid_utf8(F.col("content").cast("string")).alias("block"))


def responses(records: DataFrame) -> DataFrame:
    """Rows for derive() from what read_warc gives: record_id, url, date, headers and html of each response. The HTTP message is cut at its first empty line; its body counts as UTF-8, and other bytes in it as the sign for unreadable ones."""
    own = records.where(F.lower(F.col("fields")["WARC-Type"]) == "response")
    # bytes as characters of one byte each, so places can be counted
    message = F.decode("content", "ISO-8859-1")
    crlf, lf = F.instr(message, "\r\n\r\n"), F.instr(message, "\n\n")
    short = (lf > 0) & ((crlf == 0) | (lf < crlf))
    head = F.when(short, lf).when(crlf > 0, crlf + 1).otherwise(F.octet_length("content"))
    body = F.when(short, lf + 2).when(crlf > 0, crlf + 4).otherwise(F.octet_length("content") + 1)
    made = lambda begin, n: F.substring(F.col("content"), begin, n)
    text = F.make_valid_utf8(made(body, F.octet_length("content")).cast("string"))
    return own.select(
        F.col("fields")["WARC-Record-ID"].alias("record_id"), F.col("fields")["WARC-Target-URI"].alias("url"), F.col("fields")["WARC-Date"].alias("date"), F.make_valid_utf8(made(F.lit(1), head).cast("string")).alias("headers"), text.alias("html")
    )


def derive_warc(spark: SparkSession, path: str) -> DataFrame:
    """The derived records of all responses in WARC files."""
    return derive(responses(read_warc(spark, path)), page="record_id", headers="headers", date="date", record="record_id")


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return rows.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_headers", "source_digest", F.octet_length("block").cast("long").alias("n_bytes"), "digest")


#: Written apart from the operator: text is cut by other patterns in another order, and ids and blocks are put together anew.
OP6_SQL = r"""
with p as (
    select page_id, regexp_replace(replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '%20', 'g') as uri, coalesce(html, '') as html from pages
), parts as (
    select *, strlen(html) as size, 'sha256:' || sha256(html) as payload,
        trim(regexp_replace(coalesce(nullif(regexp_extract(html, '<[tT][iI][tT][lL][eE][^>]*>([^<]*)</[tT][iI][tT][lL][eE]', 1), ''), ''), '[ \t\r\n]+', ' ', 'g')) as title,
        len(regexp_extract_all(html, '<[aA]\b[^>]*\b[hH][rR][eE][fF]')) as links,
        regexp_replace(regexp_replace(html, '<(?i:script)\b[^>]*>(?s:.)*?</(?i:script)\s*>|<(?i:style)\b[^>]*>(?s:.)*?</(?i:style)\s*>', ' ', 'g'), '<!--(?s:.)*?-->', ' ', 'g') as bare
    from p
), lines as (
    select *, regexp_replace(regexp_replace(bare, '</?(?i:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') as marked from parts
), read as (
    select *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(marked, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)),
        '&ndash;', '–'), '&mdash;', '—'), '&hellip;', '…'), '&copy;', '©'), '&middot;', '·'), '&euro;', '€'), '&amp;', '&') as unescaped
    from lines
), blocks as (
    select *, trim(array_to_string(list_filter(list_transform(string_split(regexp_replace(unescaped, '[\t\r\f ]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10)), ' ') as plain,
        concat_ws(chr(13) || chr(10), 'title: ' || title, 'outlinks: ' || links, 'source-length: ' || size, 'source-digest: ' || payload, '') as about
    from read
), named as (
    select *, md5(concat_ws(' ', 'response', coalesce(page_id::varchar, ''), uri, '2024-01-01T00:00:00Z', payload)) as h from blocks
), linked as (
    select *, format('<urn:uuid:{}-{}-3{}-8{}-{}>', h[1:8], h[9:12], h[14:16], h[18:20], h[21:32]) as response from named
), records as (
    select page_id, uri, payload, response, 'metadata' as kind, 'application/warc-fields' as type, about as block, md5('metadata ' || response) as h from linked
    union all select page_id, uri, payload, response, 'conversion', 'text/plain', plain, md5('conversion ' || response) from linked
)
select page_id, kind as record_type, format('<urn:uuid:{}-{}-3{}-8{}-{}>', h[1:8], h[9:12], h[14:16], h[18:20], h[21:32]) as record_id, response as refers_to, uri as target_uri, '2024-01-01T00:00:00Z' as date, type as content_type,
    concat('HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: text/html; charset=utf-8', chr(13), chr(10)) as source_headers, payload as source_digest, cast(strlen(block) as bigint) as n_bytes, 'sha256:' || sha256(block) as digest
from records
"""
