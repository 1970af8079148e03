"""Queries along the way of a file: encodings, archives and books built from the driver's tables and read back, imports, views.

Each query builds its files in Spark from rows of a table, so that SQL can say from the same rows what must come out.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import display, encoding, files, reading, text
from lectern.functions.columns import arrow_udf
from lectern.operators import chapters, containers, decoding, library
from lectern.plans import sql
from lectern.plans.registry import query
from lectern.plans.tables import library as lib
from lectern.plans.tables import named, table
from lectern.shipping import scratch_path
from lectern.sources import files as sources
from lectern.sources import settings, store
from lectern.streaming import imports

# Bytes and encodings.


@query("SELECT doc_id, md5(text) AS digest, octet_length(encode(text)) :: INTEGER AS n_bytes FROM documents")
def base64_sources(spark, sf_dir):
    """Bytes that come as base64 text, as a data: address with line breaks in it, or as they are."""
    data = F.encode("text", "UTF-8")
    coded = F.base64(data)
    kind = F.col("doc_id") % 3
    uri = F.when(kind == 1, F.concat(F.lit("data:text/plain;base64,"), F.regexp_replace(coded, "(.{60})", "$1\n"))).otherwise("file:///x.txt")
    found = files.source_bytes(F.when(kind == 0, coded), uri, F.when(kind == 2, data))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(found).alias("digest"), F.octet_length(found).alias("n_bytes"))


@query(r"SELECT doc_id, regexp_replace(text, '[^\x00-\xFF]', '?', 'g') || '“€é' AS result, 2 + len(regexp_extract_all(text, '[\x80\x82-\x8C\x8E\x91-\x9C\x9E\x9F]')) :: INTEGER AS leads FROM documents")
def windows_1252_text(spark, sf_dir):
    """Latin-1 bytes with characters of Windows-1252 and a byte without one behind them."""
    plain = F.regexp_replace("text", r"[^\x{00}-\x{FF}]", "?")
    data = F.concat(F.encode(plain, "ISO-8859-1"), F.unhex(F.lit("938081E9")))
    return table(spark, sf_dir, "documents").select("doc_id", encoding.decode_windows_1252(data).alias("result"), encoding.windows_1252_leads(data).cast("int").alias("leads"))


@query("SELECT doc_id, text AS result FROM documents")
def utf16_text(spark, sf_dir):
    """UTF-16 of either byte order, with and without its mark, and a byte too many."""
    little = F.col("doc_id") % 2 == 0
    mark = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit(""))).when(little, F.unhex(F.lit("FFFE"))).otherwise(F.unhex(F.lit("FEFF")))
    data = F.concat(mark, F.when(little, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-16BE")), F.unhex(F.lit("41")))
    bare = F.when(little, encoding.without_mark(data, "utf-16le")).otherwise(encoding.without_mark(data, "utf-16be"))
    return table(spark, sf_dir, "documents").select("doc_id", encoding.decode_bytes(bare, F.when(little, "utf-16le").otherwise("utf-16be")).alias("result"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > length(text) THEN text END AS result FROM documents")
def repaired_texts(spark, sf_dir):
    """UTF-8 read as Latin-1, and read again by the lenient decoder; texts of ASCII only do not change."""
    wrong = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, sf_dir, "documents").select("doc_id", encoding.repaired_text(wrong).alias("result"))


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'windows-1252' WHEN 2 THEN 'utf-16le' WHEN 3 THEN 'utf-16be' END AS encoding, 65536 * 7 + n_nationkey AS number FROM nation")
def code_pages(spark, sf_dir):
    n = F.col("n_nationkey")
    code = F.get(F.array(*map(F.lit, (65001, 1252, 1200, 1201, 437))), (n % 5).cast("int"))
    data = F.unhex(F.concat(F.lit("FF0007"), F.lpad(F.hex(n.cast("long")), 4, "0")))
    kind = table(spark, sf_dir, "nation").schema["n_nationkey"].dataType
    return table(spark, sf_dir, "nation").select("n_nationkey", encoding.encoding_of_code(code).alias("encoding"), encoding.unsigned(data, 1, 4).cast(kind).alias("number"))


@query("""SELECT n_nationkey, list_filter([CASE WHEN n_nationkey % 3 = 0 THEN 'Detected mojibake in MOBI file. Text encoding repaired automatically.' END, CASE WHEN n_nationkey % 2 = 0 THEN 'MOBI metadata indicated Windows-1252 but UTF-8 content was detected. Text decoded automatically.' END,
CASE WHEN n_nationkey % 2 = 1 THEN 'MOBI metadata indicated UTF-8 but Windows-1252 content was detected. Text decoded automatically.' END], lambda w: w IS NOT NULL)[1] AS first_warning, n_name AS text FROM nation""")
def decoding_notes(spark, sf_dir):
    n, even = F.col("n_nationkey"), F.col("n_nationkey") % 2 == 0
    rows = table(spark, sf_dir, "nation").select(n.alias("doc_id"), F.col("n_name").alias("plain"), F.when(n % 3 == 0, "utf8-repair").otherwise("direct").alias("transform"), F.lit(0.9).alias("decoded_readability"), F.when(even, "utf-8").otherwise("windows-1252").alias("encoding"), F.when(even, 1252).otherwise(65001).alias("code_page"))
    return decoding.decoding_warnings(rows).select(F.col("doc_id").alias("n_nationkey"), F.get("warnings", F.lit(0)).alias("first_warning"), "text")


# Archives and books.


def _zipped(paths: pd.Series, texts: pd.Series) -> pd.Series:
    def one(names, bodies):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, body in zip(names, bodies, strict=True):
                archive.writestr(zipfile.ZipInfo(name), body)
        return out.getvalue()

    return pd.Series([one(p, t) for p, t in zip(paths, texts, strict=True)], dtype=object)


def archive(paths: Column, texts: Column) -> Column:
    """A zip archive with these entries."""
    return arrow_udf(_zipped, "binary", paths, texts)


_PARAGRAPH = r"(?i)<p>([^<]*)</p>"
_NOT_ZIP = "File is not a zip file"


@query(f"""WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '{_PARAGRAPH}', 1), lambda x: {sql.entities('x')}), lambda x: {sql.trim('x')} <> '') AS ps FROM pages)
SELECT page_id AS doc_id, CASE WHEN page_id % 5 < 3 THEN {sql.clean('array_to_string(ps, chr(10) || chr(10))')} END AS text, CASE WHEN page_id % 5 = 3 THEN 'DOCX archive is missing word/document.xml' WHEN page_id % 5 = 4 THEN '{_NOT_ZIP}' END AS error FROM p""")
def docx_archives(spark, sf_dir):
    """Paragraphs of pages in a word processor's archive; some archives lack the document, some are none."""
    xml = F.array_join(F.transform(F.regexp_extract_all("html", F.lit(_PARAGRAPH), F.lit(1)), lambda p: F.concat(F.lit("<w:p><w:r><w:t>"), p, F.lit("</w:t></w:r></w:p>"))), "")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), xml.alias("xml"), (F.col("page_id") % 5).alias("kind"))
    packed = archive(F.array(F.when(F.col("kind") == 3, "word/other.xml").otherwise("word/document.xml")), F.array("xml"))
    rows = rows.select("doc_id", F.when(F.col("kind") == 4, F.encode(F.lit("none"), "UTF-8")).otherwise(packed).alias("content"))
    return containers.docx_documents(rows).select("doc_id", "text", "error")


_CHAPTER = "'<html><head><title>x</title></head><body><p>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</p></body></html>'"
_BOOKS = f"""WITH c AS (SELECT conv_id AS doc_id, turn AS pos, {sql.normalize_unicode(sql.strip_html(_CHAPTER))} AS t FROM conversations WHERE turn % 5 <> 4),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM c WHERE t <> ''), b AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY pos) AS text FROM k GROUP BY doc_id), d AS (SELECT DISTINCT conv_id AS doc_id FROM conversations)"""


def _epubs(spark, sf_dir) -> DataFrame:
    """(doc_id, content): conversations as e-books, a turn for a chapter; every fifth is outside the reading order, even ones are in the contents."""
    body = F.concat(F.lit("<html><head><title>x</title></head><body><p>"), F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p></body></html>"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body"))
    n = F.col("turn").cast("string")
    rows = rows.select("conv_id", "turn", F.concat(F.lit("OEBPS/text/c"), n, F.lit(".xhtml")).alias("path"), "body", F.concat(F.lit('<item id="i'), n, F.lit('" href="text/c'), n, F.lit('.xhtml" media-type="application/xhtml+xml"/>')).alias("item"),
                       F.concat(F.lit('<itemref idref="i'), n, F.when(F.col("turn") % 5 == 4, '" linear="no"/>').otherwise('"/>')).alias("ref"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<navPoint><navLabel><text>Part &amp; "), n, F.lit('</text></navLabel><content src="text/c'), n, F.lit('.xhtml"/></navPoint>'))).alias("point"))
    books = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "path", "body", "item", "ref", "point"))).alias("c"))
    joined = lambda name: F.array_join(F.transform("c", lambda x: x[name]), "")
    opf = F.concat(F.lit("<package><metadata><dc:title>Talk "), F.col("conv_id").cast("string"), F.lit('</dc:title><dc:creator>A &amp; B</dc:creator></metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'), joined("item"), F.lit("</manifest><spine>"), joined("ref"), F.lit("</spine></package>"))
    container = F.lit('<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
    paths = F.concat(F.array(*map(F.lit, ("META-INF/container.xml", "OEBPS/content.opf", "OEBPS/toc.ncx"))), F.transform("c", lambda x: x["path"]))
    texts = F.concat(F.array(container, opf, F.concat(F.lit("<ncx><navMap>"), joined("point"), F.lit("</navMap></ncx>"))), F.transform("c", lambda x: x["body"]))
    return books.select(F.col("conv_id").alias("doc_id"), archive(paths, texts).alias("content"))


@query(_BOOKS + """ SELECT d.doc_id, CASE WHEN length(coalesce(text, '')) >= 500 THEN text END AS text, 'Talk ' || d.doc_id AS title, 'A & B' AS author, CASE WHEN length(coalesce(text, '')) < 500 THEN 'This EPUB doesn''t contain extractable text (may render text with scripts or images only).' END AS error FROM d LEFT JOIN b ON d.doc_id = b.doc_id""")
def epub_books(spark, sf_dir):
    return containers.epub_documents(_epubs(spark, sf_dir))[0].select("doc_id", "text", "title", "author", "error")


@query(_BOOKS + """ SELECT doc_id, pos :: INTEGER AS pos, 'i' || pos AS id, CASE WHEN pos % 2 = 0 THEN 'Part & ' || pos ELSE 'Chapter ' || n END AS title, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) :: BIGINT AS start_char FROM k""")
def epub_chapters(spark, sf_dir):
    return containers.epub_documents(_epubs(spark, sf_dir))[1].select("doc_id", "pos", "id", "title", "start_char")


def _number(value: Column | int, size: int) -> Column:
    value = F.lit(value) if isinstance(value, int) else value
    return F.unhex(F.lpad(F.hex(value.cast("long")), size * 2, "0"))


def _zeros(n: int) -> Column:
    return F.unhex(F.lit("00" * n))


def _literal_runs(data: Column) -> Column:
    """PalmDoc compression that knows runs of up to eight literal bytes only."""
    digits, whole = F.hex(data), F.floor(F.octet_length(data) / 8).cast("int") * 16
    rest = F.substring(digits, whole + 1, F.length(digits))
    tail = F.when(F.length(rest) > 0, F.concat(F.lpad((F.length(rest) / 2).cast("int").cast("string"), 2, "0"), rest)).otherwise("")
    return F.unhex(F.concat(F.regexp_replace(F.substring(digits, F.lit(1), whole), "([0-9A-F]{16})", "08$1"), tail))


#: A character beyond Latin-1, with which no text can be one that was wrongly read as Latin-1.
_SIGNED = "(text || ' €')"
_BOOK_TEXT = sql.markup_to_plain(sql.sanitize(sql.sanitize(_SIGNED)))


@query(f"SELECT doc_id, {sql.sanitize(_SIGNED)} AS text, 'utf-8' AS encoding, 'direct' AS transform FROM documents")
def decoded_signs(spark, sf_dir):
    """UTF-8 bytes of texts with a sign behind them, declared as Windows-1252: of all decodings tried the right one wins."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.concat("text", F.lit(" €")), "UTF-8").alias("data"), F.lit(1252).alias("code_page"))
    return decoding.best_decoding(rows).select("doc_id", "text", "encoding", "transform")


@query(f"SELECT doc_id, {_BOOK_TEXT} AS text, 'Title of ' || doc_id AS title, source AS author FROM documents WHERE {_BOOK_TEXT} <> ''")
def mobi_compressed(spark, sf_dir):
    """Documents as books of three compressed records with an extended header: cut anywhere, joined before they are decoded."""
    data = F.encode(F.concat("text", F.lit(" €")), "UTF-8")
    third = F.ceil(F.octet_length(data) / 3).cast("int")
    parts = [_literal_runs(F.substring(data, third * i + 1, third)) for i in range(3)]
    entry = lambda kind, c: F.concat(_number(kind, 4), _number(F.octet_length(c) + 8, 4), c)
    title, author = F.encode(F.concat(F.lit("Title of "), F.col("doc_id").cast("string")), "UTF-8"), F.encode("source", "UTF-8")
    more = F.concat(entry(503, title), entry(100, author), entry(999, title))
    head = F.concat(_number(2, 2), _zeros(2), _number(F.octet_length(data), 4), _number(3, 2), _zeros(6), F.encode(F.lit("MOBI"), "UTF-8"), _number(132, 4), _zeros(4), _number(65001, 4), _zeros(112), _number(0x40, 4), F.encode(F.lit("EXTH"), "UTF-8"), _number(F.octet_length(more) + 12, 4), _number(3, 4), more)
    start = 78 + 4 * 8
    rows = table(spark, sf_dir, "documents").select("doc_id", head.alias("head"), *[p.alias(f"p{i}") for i, p in enumerate(parts)])
    ends, at = [], F.lit(start) + F.octet_length("head")
    for i in range(3):
        ends.append(at)
        at = at + F.octet_length(f"p{i}")
    offsets = F.concat(_number(start, 4), _zeros(4), *[x for e in ends for x in (_number(e, 4), _zeros(4))])
    content = F.concat(_zeros(60), F.encode(F.lit("BOOKMOBI"), "UTF-8"), _zeros(8), _number(4, 2), offsets, "head", "p0", "p1", "p2")
    return containers.mobi_documents(rows.select("doc_id", content.alias("content"))).filter("text <> ''").select("doc_id", "text", "title", "author")


_MOBI_ERRORS = ("This file is too small to be a valid MOBI document.", "Invalid MOBI file format (type: TEXT, creator: READ). Expected BOOK/MOBI.", "This MOBI file does not contain any records.", "This book is DRM-protected and cannot be read. Please use a DRM-free version.",
                "This MOBI uses Huff/CDIC compression which is not supported yet. Please try a different version of the book.", "Invalid MOBI header signature")


@query("SELECT n_nationkey, [" + ", ".join(f"'{e}'" for e in _MOBI_ERRORS) + "][n_nationkey % 6 + 1] AS error FROM nation")
def mobi_errors(spark, sf_dir):
    """Broken books: each has the first error that is found in it."""
    kind = F.col("n_nationkey") % 6
    names = F.encode(F.when(kind == 1, "TEXTREAD").otherwise("BOOKMOBI"), "UTF-8")
    head = F.concat(F.when(kind == 4, _number(17480, 2)).otherwise(_number(1, 2)), _zeros(10), F.when(kind == 3, _number(2, 2)).otherwise(_zeros(2)), _zeros(2), F.encode(F.when(kind == 5, "MOBX").otherwise("MOBI"), "UTF-8"), _number(132, 4), _zeros(140))
    whole = F.concat(_zeros(60), names, _zeros(8), F.when(kind == 2, _number(0, 2)).otherwise(_number(1, 2)), _number(86, 4), _zeros(4), head)
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.when(kind == 0, _zeros(40)).otherwise(whole).alias("content"))
    return containers.mobi_documents(rows).select(F.col("doc_id").alias("n_nationkey"), "error")


@query(f"""WITH {sql.LIB}, f AS (SELECT doc_id, text, {sql.document_format('file_name', 'mime_type')} AS format FROM nm), t AS (SELECT doc_id, format, CASE WHEN format = 'TXT' THEN {sql.clean('text')} ELSE '' END AS t FROM f)
SELECT doc_id, format AS source_format, length({sql.trim('t')}) >= 24 AS is_readable, CASE WHEN length({sql.trim('t')}) >= 24 THEN t ELSE '' END AS text FROM t""")
def imported_texts(spark, sf_dir):
    """Documents as files of all formats with their text as bytes: only plain text can be read, and no other file stops the import."""
    rows = named(spark, sf_dir).select("doc_id", F.concat(F.lit("file:///"), "file_name").alias("uri"), F.col("file_name").alias("name"), "mime_type", F.lit(None).cast("string").alias("base64"), F.encode("text", "UTF-8").alias("content"))
    return sources.extract_texts(rows).select("doc_id", "source_format", "is_readable", "text")


@query("SELECT page_id, page_id % 3 <> 0 AS remote FROM pages")
def remote_addresses(spark, sf_dir):
    start = F.when(F.col("page_id") % 3 == 0, "file:///").when(F.col("page_id") % 3 == 1, "blob:").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", files.is_remote(F.concat(start, "url")).alias("remote"))


@query("SELECT doc_id, " + sql.cases("lang", files.RECOGNITION_LANGUAGES, "'eng'") + " AS language FROM documents")
def recognition_languages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", files.recognition_language(F.col("lang")).alias("language"))


@query("SELECT doc_id, doc_id || ' ' || source || ' ' || coalesce(lang, '') || ' [Image: ' || source || ']' AS result FROM documents")
def drawing_texts(spark, sf_dir):
    """Texts of drawings, alternative texts of images, and what is hidden from readers."""
    page = F.concat(F.lit("<svg><text>"), "source", F.lit("<tspan>"), F.col("doc_id").cast("string"), F.lit("</tspan></text></svg><p>"), F.coalesce("lang", F.lit("")), F.lit('</p><img src="a.png" alt="'), "source", F.lit('"><img alt=""><span aria-hidden="true">hidden</span>'))
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_html(page, respect_aria_hidden=True).alias("result"))


@query("SELECT doc_id, ord :: INTEGER AS ord, 'T' || ord || ' & ' || doc_id AS title, 'c' || ord || '.xhtml#x' AS href FROM documents, unnest(range(3)) AS u(ord)")
def ncx_entries(spark, sf_dir):
    """Navigation points of the older kind, the second within the first."""
    point = lambda i, inner: F.concat(F.lit(f'<navPoint id="{i}"><navLabel><text>T{i} &amp; '), F.col("doc_id").cast("string"), F.lit(f'</text></navLabel><content src="c{i}.xhtml#x"/>'), inner, F.lit("</navPoint>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(point(0, point(1, F.lit(""))), point(2, F.lit(""))).alias("text"))
    return chapters.ncx_contents(rows).select("doc_id", "ord", "title", "href")


@query("SELECT n_nationkey, n_nationkey % 3 = 1 AS protected, CASE WHEN n_nationkey % 2 = 0 THEN 'OPS/p' || n_nationkey || '.opf' END AS path FROM nation")
def protected_books(spark, sf_dir):
    """Encryption of hidden fonts alone is no protection; a container may not name its package."""
    kind = F.col("n_nationkey") % 3
    listed = F.when(kind == 1, '<encryption><EncryptedData><CipherReference URI="OPS/c1.xhtml"/></EncryptedData></encryption>').when(kind == 2, '<encryption><EncryptedData><EncryptionMethod Algorithm="http://www.idpf.org/2008/embedding"/></EncryptedData></encryption>')
    container = F.concat(F.lit("<container><rootfile "), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('full-path="OPS/p'), F.col("n_nationkey").cast("string"), F.lit('.opf"'))).otherwise(""), F.lit("/></container>"))
    return table(spark, sf_dir, "nation").select("n_nationkey", chapters.is_protected(listed).alias("protected"), chapters.package_path(container).alias("path"))


# The library's writes and views.


@query(f"""WITH d AS (SELECT doc_id, source || '-' || doc_id AS title, text FROM documents) SELECT left(sha256(title || chr(10) || text || chr(10) || '1000'), 16) AS id, title, CASE WHEN doc_id % 7 = 0 THEN 5 ELSE 0 END :: BIGINT AS chunk_index, CASE WHEN doc_id % 7 = 0 THEN 2000 ELSE 1000 END :: BIGINT AS updated_at,
CASE WHEN {sql.trim('text')} <> '' THEN len({sql.words('text')}) ELSE 0 END :: BIGINT AS word_count, {sql.trim('text')} <> '' AS is_readable FROM d WHERE doc_id % 5 <> 0 UNION ALL SELECT 'sample-document', 'Welcome', 0, 4000, {len(store.SAMPLE_TEXT.split())}, true""")
def stored_library(spark, sf_dir):
    """Documents imported into a library at a path, some touched again, some deleted, the sample restored twice, old versions left behind."""
    kept = store.Library(spark, scratch_path(spark, "library"))
    payloads = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("title"), F.lit("TXT").alias("source_format"), F.col("text").alias("content"), F.lit(True).alias("is_readable"), F.lit(None).cast("string").alias("unreadable_reason"), F.array().cast("array<string>").alias("conversion_warnings"))
    kept.add(payloads, 1000)
    number = F.regexp_extract("title", "-([0-9]+)$", 1).cast("long")
    kept.update(kept.documents().filter(number % 7 == 0).select("id", F.lit(5).cast("long").alias("chunk_index")), 2000)
    kept.delete(kept.documents().filter(number % 5 == 0).select("id"), 3000)
    kept.restore_sample(4000)
    kept.restore_sample(5000)
    return kept.documents().select("id", "title", "chunk_index", "updated_at", "word_count", "is_readable")


_LIBRARY = f"""d AS (SELECT doc_id, coalesce(source, 'none') || '_' || doc_id AS title, {sql.clean('text')} AS t FROM documents),
l AS (SELECT title, doc_id, CASE WHEN length({sql.trim('t')}) >= 24 THEN t ELSE '' END AS content, length({sql.trim('t')}) >= 24 AS is_readable FROM d)"""
_WORDS = f"CASE WHEN is_readable THEN len({sql.words('content')}) ELSE 0 END :: BIGINT"


def _folder_of_texts(spark, sf_dir) -> str:
    """Each document's text, a line end behind it, as a file of its own."""
    folder = scratch_path(spark, "texts")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")), "UTF-8").alias("content"))
    sources.write_files(rows, folder)
    return folder


@query(f"""WITH {_LIBRARY} SELECT title, 'TXT' AS source_format, is_readable, md5(content) AS digest, {_WORDS} AS word_count,
CASE WHEN NOT is_readable THEN 'This TXT file does not contain readable text content.' END AS unreadable_reason, 1000 :: BIGINT AS updated_at FROM l""")
def imported_library(spark, sf_dir):
    """A folder of files arrives as a stream and becomes a library; then the stream is run again from nothing, and every batch replaces itself."""
    folder, path = _folder_of_texts(spark, sf_dir), scratch_path(spark, "library")
    for _ in range(2):
        imports.import_stream(spark, folder, path, scratch_path(spark, "checkpoint"), glob="*.txt", name=sources.written_name, now=F.lit(1000), files_per_batch=4_000).trigger(availableNow=True).start().awaitTermination()
    rows = store.Library(spark, path).documents()
    return rows.select("title", "source_format", "is_readable", F.md5("content").alias("digest"), "word_count", "unreadable_reason", "updated_at")


def _payloads(spark, sf_dir) -> DataFrame:
    number = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(number.alias("id"), F.concat(F.lit("t"), number).alias("title"), F.lit("TXT").alias("source_format"), F.col("text").alias("content"), F.lit(True).alias("is_readable"), F.lit(None).cast("string").alias("unreadable_reason"), F.array().cast("array<string>").alias("conversion_warnings"))


_WRITTEN = """SELECT doc_id :: VARCHAR AS id, CASE WHEN doc_id % 6 = 0 THEN 'late' WHEN doc_id % 3 = 0 THEN 'first' ELSE 't' || doc_id END AS title, CASE WHEN doc_id % 2 = 0 THEN 7 ELSE 0 END :: BIGINT AS chunk_index,
CASE WHEN doc_id % 6 = 0 THEN 2500 WHEN doc_id % 3 = 0 OR doc_id % 2 = 0 THEN 2000 ELSE 1000 END :: BIGINT AS updated_at, md5(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 11 <> 0"""


def _written_together(spark, sf_dir) -> store.Library:
    """Two writers who saw the same library: one gives titles, the other positions; then a title comes that is older than one that is there."""
    path = scratch_path(spark, "library")
    one, two = store.Library(spark, path), store.Library(spark, path)
    one.add(_payloads(spark, sf_dir), 1000)
    seen = _payloads(spark, sf_dir).select("id", F.col("id").cast("long").alias("n"))
    one.update(seen.filter("n % 3 = 0").select("id", F.lit("first").alias("title")), 2000)
    two.update(seen.filter("n % 2 = 0").select("id", F.lit(7).cast("long").alias("chunk_index")), 2000)
    two.update(seen.filter("n % 6 = 0").select("id", F.lit("late").alias("title")), 2500)
    one.update(seen.filter("n % 6 = 0").select("id", F.lit("early").alias("title")), 2400)
    one.delete(seen.filter("n % 11 = 0").select("id"), 3000)
    return one


def _written_rows(kept: store.Library) -> DataFrame:
    return kept.documents().select("id", "title", "chunk_index", "updated_at", F.md5("content").alias("digest"))


@query(_WRITTEN)
def concurrent_changes(spark, sf_dir):
    """Of changes to different fields none is lost, and of one field the later one counts, whoever writes first."""
    return _written_rows(_written_together(spark, sf_dir))


@query(_WRITTEN)
def compacted_library(spark, sf_dir):
    """The same library with its live values only."""
    return _written_rows(_written_together(spark, sf_dir).compact(scratch_path(spark, "library")))


@query("""WITH d AS (SELECT doc_id, text, ['', 'A', 'q' || chr(233) || '(', chr(945) || '!'][(doc_id % 4 + 1) :: INT] AS more FROM documents WHERE text IS NOT NULL) SELECT doc_id, """ + sql.clean("'x' || more || ' ' || text") + """ AS text FROM d""")
def lenient_texts(spark, sf_dir):
    """Text files with what strict decoders refuse: bytes that lead nothing, an overlong form, a lead whose continuation is none, a lead at the end."""
    kinds = ("8081FE", "C181", "71C329" + "28", "CEB121")
    broken = F.unhex(F.get(F.array(*map(F.lit, kinds)), (F.col("doc_id") % 4).cast("int")))
    data = F.concat(F.encode(F.lit("x"), "UTF-8"), broken, F.encode(F.concat(F.lit(" "), "text"), "UTF-8"), F.unhex(F.when(F.col("doc_id") % 3 == 0, "E2").otherwise("")))
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", data.alias("data"))
    return rows.select("doc_id", text.clean_text(encoding.text_of_bytes(F.col("data"))).alias("text"))


@query(f"SELECT doc_id :: VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'Untitled Document' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'PDF' ELSE 'TXT' END AS format, CASE WHEN doc_id % 5 = 0 THEN 7 ELSE 99 END :: BIGINT AS created_at, CASE WHEN length({sql.trim('text')}) > 0 THEN len({sql.words('text')}) ELSE 0 END :: BIGINT AS word_count, '2D' AS last_mode FROM documents")
def normalized_rows(spark, sf_dir):
    """Stored rows with gaps, filled with defaults."""
    n = F.col("doc_id")
    gap = lambda kind: F.lit(None).cast(kind)
    rows = table(spark, sf_dir, "documents").select(n.cast("string").alias("id"), F.when(n % 2 == 0, F.col("source")).alias("title"), gap("string").alias("format"), F.when(n % 3 == 0, "PDF").alias("source_format"), F.col("text").alias("content"), F.when(n % 5 == 0, 7).cast("long").alias("created_at"), gap("long").alias("updated_at"), gap("long").alias("chunk_index"), gap("array<bigint>").alias("bookmarks"), gap("string").alias("last_mode"), gap("boolean").alias("is_readable"), gap("string").alias("unreadable_reason"), gap("array<string>").alias("conversion_warnings"))
    return library.normalized(rows, F.lit(99).cast("long")).select("id", "title", "format", "created_at", "word_count", "last_mode")


@query(f"WITH {sql.LIB}, u AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(title) ELSE title END AS title FROM lib) SELECT doc_id, title, row_number() OVER (ORDER BY lower(title), doc_id) - 1 AS rank FROM u")
def library_alpha_folded(spark, sf_dir):
    """Titles in an order that does not tell capitals from small letters."""
    rows = lib(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper("title")).otherwise(F.col("title")).alias("title"))
    return library.ranked(rows, "alpha", collation="UTF8_LCASE").select("doc_id", "title", "rank")


@query(f"WITH {sql.LIB}, r AS (SELECT doc_id, title, row_number() OVER (ORDER BY updated_ts DESC, doc_id) - 1 AS rank FROM lib WHERE contains(lower(title), 'src1')) SELECT * FROM r WHERE rank < 20")
def library_search_recent(spark, sf_dir):
    """The first twenty found, the newest first."""
    return library.ranked(library.searched(lib(spark, sf_dir).drop("text"), "SRC1"), "recent", first=20).select("doc_id", "title", "rank")


# Settings, presentation, geometry.


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 222 ELSE 333 END :: INTEGER AS wpm, CASE WHEN n_nationkey % 3 = 0 THEN 40 ELSE 55 END :: INTEGER AS depth FROM nation")
def settings_saved(spark, sf_dir):
    """Settings merged with others where they have nulls, written as JSON and read again."""
    wpm, depth = F.when(F.col("n_nationkey") % 2 == 0, '"wpm":222').otherwise('"wpm":null'), F.when(F.col("n_nationkey") % 3 == 0, '"threeD":{"depth":40}').otherwise('"threeD":null')
    stored = F.from_json(F.concat(F.lit("{"), wpm, F.lit(","), depth, F.lit("}")), settings.schema())
    other = F.from_json(F.lit('{"wpm":333,"threeD":{"depth":55}}'), settings.schema())
    rows = table(spark, sf_dir, "nation").select("n_nationkey", settings.saved(settings.merged(stored, other)).alias("settings"))
    return settings.load_settings(rows).select("n_nationkey", F.col("settings.wpm").alias("wpm"), F.col("settings.threeD.depth").alias("depth"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '3D' ELSE '2D' END AS mode, n_nationkey || CASE WHEN n_nationkey = 1 THEN ' page' ELSE ' pages' END AS pages, " + sql.cases("CASE n_nationkey % 2 WHEN 0 THEN '" + next(iter(reading.FONTS)) + "' ELSE 'none' END", reading.FONTS, "'system'") + " AS font, 'rgba(' || floor(((n_nationkey * 41) % 256) * 0.3 :: DOUBLE + 0.5 :: DOUBLE) :: INT || ', ' || floor(((n_nationkey * 97) % 256) * 0.3 :: DOUBLE + 0.5 :: DOUBLE) :: INT || ', ' || floor(((n_nationkey * 13) % 256) * 0.3 :: DOUBLE + 0.5 :: DOUBLE) :: INT || CASE WHEN n_nationkey % 2 = 0 THEN ', 0.0)' ELSE ', 0.4)' END AS shadow FROM nation")
def presentation_values(spark, sf_dir):
    n = F.col("n_nationkey")
    colour = display.colour_of(*[(n * k) % 256 for k in (41, 97, 13)])
    font = reading.font_family(F.when(n % 2 == 0, next(iter(reading.FONTS))).otherwise("none"))
    return table(spark, sf_dir, "nation").select("n_nationkey", reading.toggled_mode(F.when(n % 2 == 0, "2D").otherwise("3D")).alias("mode"), reading.plural(n, "page").alias("pages"), font.alias("font"), display.shadow(colour, (n % 2) * 50).alias("shadow"))


@query("SELECT n_nationkey, " + sql.cases("t", {k: v[0] for k, v in display.THEMES.items()}, "CASE t WHEN 'custom' THEN '#ffffff' ELSE '#000000' END") + " AS back, " + sql.cases("t", {k: v[1] for k, v in display.THEMES.items()}, "CASE t WHEN 'custom' THEN '#000000' ELSE '#FFFFFF' END") + " AS front FROM (SELECT *, [" + ", ".join(f"'{k}'" for k in (*display.THEMES, "custom", "other")) + f"][n_nationkey % {len(display.THEMES) + 2} + 1] AS t FROM nation)")
def theme_values(spark, sf_dir):
    names = (*display.THEMES, "custom", "other")
    theme = F.get(F.array(*map(F.lit, names)), (F.col("n_nationkey") % len(names)).cast("int"))
    back, front = display.theme_colours(theme, F.lit("#ffffff"))
    return table(spark, sf_dir, "nation").select("n_nationkey", back.alias("back"), front.alias("front"))


@query("SELECT n_nationkey, printf('%02x', floor(n_nationkey / 30.0 :: DOUBLE * 255 + 0.5 :: DOUBLE) :: INT) AS alpha, round(3 + tan(radians(30.0 :: DOUBLE)) * 4 + n_nationkey, 6) AS x, round(tan(radians(10.0 :: DOUBLE)) * 3 + 4.0 :: DOUBLE, 6) AS y, n_nationkey % 2 = 0 AS read, 50.0 :: DOUBLE AS second_stop FROM nation")
def matrix_values(spark, sf_dir):
    """Skewed and read transformations, the second stop of three colours, and opacities."""
    n = F.col("n_nationkey")
    written = F.when(n % 2 == 0, F.concat(F.lit("matrix(1, 0, 0, 1, "), n.cast("string"), F.lit(", 0)"))).otherwise("none")
    read = display.parsed_matrix(written)
    moved = display.multiplied(F.coalesce(read, display.matrix(1, 0, 0, 1, n, 0)), display.skewed(display.matrix(1, 0, 0, 1, 0, 0), 30.0, 10.0))
    point = display.mapped_point(moved, F.lit(3.0), F.lit(4.0))
    stop = display.gradient_stops(F.array(F.lit("#000000"), F.lit("#111111"), F.lit("#222222")))[1]["offset"]
    return table(spark, sf_dir, "nation").select("n_nationkey", display.alpha_hex(n / 30.0).alias("alpha"), F.round(point["x"], 6).alias("x"), F.round(point["y"], 6).alias("y"), read.isNotNull().alias("read"), stop.cast("double").alias("second_stop"))
