"""Queries about what is cut off, broken, disguised or out of bounds; each builds its input from rows of a table, as ``file_queries`` does."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

from lectern.functions import encoding, files, text
from lectern.functions.columns import arrow_udf
from lectern.operators import containers, decoding, library, progress
from lectern.plans import file_queries as made
from lectern.plans import sql
from lectern.plans.registry import query
from lectern.plans.tables import library as lib
from lectern.plans.tables import progress_events, table
from lectern.sources import files as sources
from lectern.sources import settings

# Compressed books.


def _plain(byte: int) -> bool:
    return byte == 0 or 9 <= byte < 0x80


def palmdoc_packed(data: bytes) -> bytes:
    """PalmDoc compression with all of its codes: back references to the last same three bytes, blank pairs, literal runs."""
    out, at, seen = bytearray(), 0, {}
    while at < len(data):
        back, step = at - seen.get(data[at : at + 3], at), 0
        if 0 < back < 2048 and at + 3 <= len(data):
            step = 3
            while step < 10 and at + step < len(data) and data[at + step - back] == data[at + step]:
                step += 1
            out += (0x8000 | back << 3 | step - 3).to_bytes(2)
        elif data[at] == 0x20 and at + 1 < len(data) and 0x40 <= data[at + 1] < 0x80:
            out.append(data[at + 1] ^ 0x80)
            step = 2
        elif _plain(data[at]):
            out.append(data[at])
            step = 1
        else:
            step = next((n for n in range(1, 8) if at + n >= len(data) or _plain(data[at + n])), 8)
            out += bytes([step]) + data[at : at + step]
        for k in range(at, at + step):
            seen[data[k : k + 3]] = k
        at += step
    return bytes(out)


RECORD_BYTES = 512


def palmdoc_book(data: bytes, declared: int) -> bytes:
    """A book database of compressed records, one of them empty, whose header declares ``declared`` bytes of text."""
    records = [palmdoc_packed(data[i : i + RECORD_BYTES]) for i in range(0, len(data), RECORD_BYTES)]
    records.insert(1, b"")
    head = struct.pack(">HHIHHHH", 2, 0, declared, len(records), RECORD_BYTES, 0, 0) + b"MOBI" + struct.pack(">III", 132, 0, 65001) + bytes(116)
    at, offsets = 78 + 8 * (len(records) + 1), b""
    for record in (head, *records):
        offsets += struct.pack(">II", at, 0)
        at += len(record)
    return bytes(60) + b"BOOKMOBI" + bytes(8) + struct.pack(">H", len(records) + 1) + offsets + head + b"".join(records)


def _books(texts: pd.Series, declared: pd.Series) -> pd.Series:
    return pd.Series([palmdoc_book(t, n) for t, n in zip(texts, declared, strict=True)], dtype=object)


_KEPT = "(CASE WHEN doc_id % 4 = 0 THEN text ELSE left(text, length(text) * 3 // 5) END || ' €')"
_KEPT_TEXT = sql.markup_to_plain(sql.sanitize(sql.sanitize(_KEPT)))


@query(f"SELECT doc_id, {_KEPT_TEXT} AS text FROM documents WHERE {_KEPT_TEXT} <> ''")
def palmdoc_books(spark, sf_dir):
    """Books with back references and blank pairs; most declare a length that ends before their last records, some end with zeros."""
    whole = F.col("doc_id") % 4 == 0
    size = F.floor(F.length("text") * 3 / 5).cast("int")
    kept = F.concat(F.when(whole, F.col("text")).otherwise(F.substring("text", F.lit(1), size)), F.lit(" €"))
    rest = F.when(whole, F.unhex(F.lit("000000"))).otherwise(F.encode(F.substring("text", size + 1, F.length("text")), "UTF-8"))
    data = F.encode(kept, "UTF-8")
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.concat(data, rest).alias("data"), F.when(whole, 0).otherwise(F.octet_length(data)).alias("declared"))
    books = rows.select("doc_id", arrow_udf(_books, "binary", F.col("data"), F.col("declared")).alias("content"))
    return containers.mobi_documents(books).filter("text <> ''").select("doc_id", "text")


_NOT_MOBI = "Invalid MOBI file format (type: "
#: Each fault of a book by number; the second one names what stands in the file.
_FAULTS = (
    "This file is too small to be a valid MOBI document.", None, "This MOBI file does not contain any records.", "PalmDOC header missing or truncated", "This book is DRM-protected and cannot be read. Please use a DRM-free version.",
    "This MOBI uses Huff/CDIC compression which is not supported yet. Please try a different version of the book.", "This MOBI uses an unsupported compression method (0). Only uncompressed and PalmDOC compression are supported.", "MOBI header is truncated", "Invalid MOBI header signature",
)
_FAULT_SQL = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FAULTS) if f)


@query(f"""SELECT doc_id, CASE doc_id % 10 {_FAULT_SQL} WHEN 1 THEN '{_NOT_MOBI}T' || lpad((doc_id % 1000) :: VARCHAR, 3, '0') || ', creator: READ). Expected BOOK/MOBI.'
ELSE CASE WHEN coalesce(text, '') = '' THEN 'No text records could be extracted from MOBI file' END END AS error FROM documents""")
def broken_books(spark, sf_dir):
    """Books with each of the nine faults of headers, and whole ones."""
    number, zeros = made._number, made._zeros
    kind = F.col("doc_id") % 10
    names = F.encode(F.when(kind == 1, F.concat(F.lit("T"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit("READ"))).otherwise("BOOKMOBI"), "UTF-8")
    compression = F.when(kind == 5, number(17480, 2)).when(kind == 6, zeros(2)).otherwise(number(1, 2))
    head = F.concat(compression, zeros(6), number(1, 2), zeros(2), F.when(kind == 4, number(1, 2)).otherwise(zeros(2)), zeros(2), F.encode(F.when(kind == 8, "MOBX").otherwise("MOBI"), "UTF-8"), number(132, 4), zeros(4), number(65001, 4), zeros(116))
    head = F.when(kind == 3, F.substring(head, 1, 10)).when(kind == 7, F.substring(head, 1, 20)).otherwise(head)
    listed = F.when(kind == 2, 0).when(kind == 9, 2).otherwise(1)
    start = F.lit(78) + 8 * listed
    offsets = F.concat(F.when(listed > 0, F.concat(number(start, 4), zeros(4))).otherwise(zeros(8)), F.when(kind == 9, F.concat(number(start + F.octet_length(head), 4), zeros(4))).otherwise(zeros(0)))
    whole = F.concat(zeros(60), names, zeros(8), number(listed, 2), offsets, head, F.when(kind == 9, F.encode(F.coalesce("text", F.lit("")), "UTF-8")).otherwise(zeros(0)))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(kind == 0, zeros(40)).otherwise(whole).alias("content"))
    return containers.mobi_documents(rows).select("doc_id", "error")


_REMARKED = "CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN doc_id || repeat(chr(65533), 60) WHEN 2 THEN 'a' || repeat(chr(65533), 99) ELSE '' END"


@query(f"""WITH d AS (SELECT doc_id, {_REMARKED} AS plain, (doc_id % 5) / 4.0 :: DOUBLE AS decoded, doc_id % 3 AS e, doc_id % 7 = 0 AS again FROM documents), r AS (SELECT *, coalesce({sql.quality('plain')['readability']}, 0) AS final FROM d),
t AS (SELECT *, CASE WHEN final < 0.03 THEN '' ELSE plain END AS text FROM r) SELECT doc_id, text, array_to_string(list_filter([CASE WHEN again THEN 'Detected mojibake in MOBI file. Text encoding repaired automatically.' END, CASE WHEN decoded < 0.4 THEN 'MOBI document contains a large amount of unreadable characters. Display may be degraded.' END,
CASE WHEN e = 0 THEN 'MOBI metadata indicated Windows-1252 but UTF-8 content was detected. Text decoded automatically.' END, CASE WHEN e = 1 THEN 'MOBI metadata indicated UTF-8 but Windows-1252 content was detected. Text decoded automatically.' END,
CASE WHEN final < 0.2 THEN 'Decoded MOBI text still contains noticeable unreadable characters after cleanup.' END, CASE WHEN final < 0.03 THEN 'Decoded MOBI text appears corrupted or uses an unsupported encoding. Display has been suppressed.' END,
CASE WHEN text = '' THEN 'MOBI document did not expose readable text content.' END], lambda w: w IS NOT NULL), '; ') AS warnings FROM t""")
def decoding_remarks(spark, sf_dir):
    """All seven remarks about decoded books: readable, hardly readable, hopeless and empty ones in encodings declared rightly and wrongly."""
    n = F.col("doc_id")
    plain = F.when(n % 4 == 0, F.coalesce("text", F.lit(""))).when(n % 4 == 1, F.concat(n.cast("string"), F.repeat(F.lit("�"), 60))).when(n % 4 == 2, F.concat(F.lit("a"), F.repeat(F.lit("�"), 99))).otherwise("")
    page = F.when(n % 3 == 0, 1252).otherwise(65001)
    rows = table(spark, sf_dir, "documents").select("doc_id", plain.alias("plain"), F.when(n % 7 == 0, "utf8-repair").otherwise("direct").alias("transform"), (n % 5 / 4).alias("decoded_readability"), F.when(n % 3 == 1, "windows-1252").otherwise("utf-8").alias("encoding"), page.alias("code_page"))
    return decoding.decoding_warnings(rows).select("doc_id", "text", F.array_join("warnings", "; ").alias("warnings"))


# Archives by their directory.

MEMBER_LIMIT = 1000


@query(f"SELECT conv_id AS doc_id, 'OEBPS/text/c' || turn || '.xhtml' AS path, octet_length(encode({made._CHAPTER})) :: BIGINT AS unpacked FROM conversations")
def archive_directories(spark, sf_dir):
    """What archives list of themselves, without unpacking anything."""
    listed = made._epubs(spark, sf_dir).select("doc_id", F.explode(containers.archive_directory(F.col("content"))["entries"]).alias("e"))
    return listed.select("doc_id", "e.path", "e.unpacked").filter(F.col("path").startswith("OEBPS/text/"))


@query(f"""WITH m AS (SELECT conv_id AS doc_id, turn, {made._CHAPTER} AS body FROM conversations WHERE turn % 2 = 0), a AS (SELECT doc_id, count(*) AS n, md5(string_agg(body, '' ORDER BY turn)) AS digest, min(turn) FILTER (octet_length(encode(body)) > {MEMBER_LIMIT}) AS bad FROM m GROUP BY doc_id), d AS (SELECT DISTINCT conv_id AS doc_id FROM conversations)
SELECT d.doc_id, CASE WHEN bad IS NULL THEN coalesce(n, 0) END AS members, CASE WHEN bad IS NULL THEN coalesce(digest, md5('')) END AS digest, 'Archive member "OEBPS/text/c' || bad || '.xhtml" unpacks to more than {MEMBER_LIMIT} bytes.' AS error FROM d LEFT JOIN a ON d.doc_id = a.doc_id""")
def bounded_members(spark, sf_dir):
    """Every second chapter by name: first the directory, then these members only; one too large makes an error of its archive."""
    names = F.transform(containers.archive_directory(F.col("content"))["entries"], lambda e: e["path"])
    wanted = F.filter(names, lambda p: F.regexp_extract(p, "^OEBPS/text/c([0-9]+)[.]xhtml$", 1).try_cast("int") % 2 == 0)
    rows = made._epubs(spark, sf_dir).select("doc_id", "content", wanted.alias("wanted"))
    read = rows.select("doc_id", containers.archive_members(F.col("content"), F.col("wanted"), MEMBER_LIMIT).alias("x"))
    joined = F.array_join(F.transform("x.members", lambda m: m["text"]), "")
    return read.select("doc_id", F.when(F.col("x.error").isNull(), F.size("x.members")).cast("long").alias("members"), F.md5(joined).alias("digest"), "x.error")


_ESCAPED = "replace(replace(text, '&', '&amp;'), '<', '&lt;')"
_DISGUISED = sql.clean(sql.entities(_ESCAPED))


@query(f"""WITH d AS (SELECT doc_id, list_extract(['DOC', 'RTF', 'HTML'], (doc_id % 3 + 1) :: INT) AS format, CASE WHEN doc_id % 2 = 0 THEN {_DISGUISED} ELSE '' END AS t FROM documents), f AS (SELECT *, length({sql.trim('t')}) >= 24 AS ok, {sql.cases('format', files.UNSUPPORTED, "''")} AS said FROM d)
SELECT doc_id, CASE WHEN ok THEN 'DOCX' ELSE format END AS source_format, ok AS is_readable, CASE WHEN ok THEN t ELSE '' END AS text, CASE WHEN ok THEN '{sources.WORD_IN_DISGUISE}' ELSE said END AS message, CASE WHEN NOT ok THEN said END AS unreadable_reason FROM f""")
def disguised_files(spark, sf_dir):
    """Files of formats without a reader: half of them are word-processor archives under a wrong name, the others cannot be read."""
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    packed = made.archive(F.array(F.lit("word/document.xml")), F.array(F.concat(F.lit("<w:p><w:r><w:t>"), escaped, F.lit("</w:t></w:r></w:p>"))))
    ending = F.get(F.array(*map(F.lit, ("doc", "rtf", "html"))), (F.col("doc_id") % 3).cast("int"))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), ending)
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), F.concat(F.lit("file:///"), name).alias("uri"), F.lit(None).cast("string").alias("mime_type"), F.lit(None).cast("string").alias("base64"), F.when(F.col("doc_id") % 2 == 0, packed).otherwise(F.encode("text", "UTF-8")).alias("content"))
    return sources.extract_texts(rows).select("doc_id", "source_format", "is_readable", "text", F.array_join("warnings", "; ").alias("message"), "unreadable_reason")


# Texts.


@query("SELECT doc_id, source || ' ' || doc_id || ' & ' || coalesce(lang, 'none') || ' after' AS result FROM documents")
def foreign_drawings(spark, sf_dir):
    """Drawings with markup of another kind in them."""
    page = F.concat(F.lit("<svg><text>"), "source", F.lit("</text><foreignObject><div>"), F.col("doc_id").cast("string"), F.lit(" &amp; <b>"), F.coalesce("lang", F.lit("none")), F.lit("</b></div></foreignObject></svg><p>after</p>"))
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_html(page).alias("result"))


@query("SELECT doc_id, text || chr(65533) || 'A' || chr(65533) AS result FROM documents")
def utf16_half_pairs(spark, sf_dir):
    """UTF-16 of either byte order with zeros, a first half of a pair before a letter, a second half alone, and a byte too many."""
    little = F.col("doc_id") % 2 == 0
    unit = lambda digits: F.when(little, F.unhex(F.lit(digits[2:] + digits[:2]))).otherwise(F.unhex(F.lit(digits)))
    body = F.when(little, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-16BE"))
    data = F.concat(unit("0000"), body, unit("D83D"), unit("0041"), unit("0000"), unit("DE00"), F.unhex(F.lit("41")))
    return table(spark, sf_dir, "documents").select("doc_id", encoding.decode_bytes(data, F.when(little, "utf-16le").otherwise("utf-16be")).alias("result"))


# The library and its readers.


@query("WITH t AS (SELECT doc_id, left(text, 24) AS title FROM documents) SELECT doc_id, title, row_number() OVER (ORDER BY title COLLATE en, doc_id) - 1 AS rank FROM t")
def library_alpha_locale(spark, sf_dir):
    """Titles of all languages in the order of the Unicode collation: accents and capitals decide only where letters are equal."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 24).alias("title"))
    return library.ranked(rows, "alpha", collation="UNICODE").select("doc_id", "title", "rank")


_MARKS = "ev AS (SELECT user_id AS doc_id, event_id, ts, event_type, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS chunk_index FROM events), o AS (SELECT doc_id, chunk_index FROM ev WHERE event_type = 'click' GROUP BY ALL HAVING count(*) % 2 = 1)"


@query(f"WITH {_MARKS}, l AS (SELECT doc_id, (max(struct_pack(ts := ts, e := event_id, c := chunk_index))).c AS chunk_index FROM ev GROUP BY doc_id) SELECT l.doc_id, l.chunk_index, o.doc_id IS NOT NULL AS bookmarked FROM l LEFT JOIN o ON l.doc_id = o.doc_id AND l.chunk_index = o.chunk_index")
def bookmarked_positions(spark, sf_dir):
    """Whether the place where a document was left is among its bookmarks."""
    events = progress_events(spark, sf_dir)
    marks = progress.bookmarks(events.filter("event_type = 'click'"))
    rows = progress.latest_progress(events).join(marks, "doc_id", "left")
    return rows.select("doc_id", "chunk_index", progress.is_bookmarked(F.col("bookmarks"), F.col("chunk_index")).alias("bookmarked"))


@query(f"WITH {_MARKS}, b AS (SELECT doc_id, list(chunk_index ORDER BY chunk_index) AS marks FROM o GROUP BY doc_id) SELECT doc_id, array_to_string(marks[1:4], ',') AS chips, CASE WHEN len(marks) > 4 THEN '+' || (len(marks) - 4) || ' more' END AS more FROM b")
def bookmark_chips(spark, sf_dir):
    """The first four bookmarks of a document, and how many more there are."""
    marks = progress.bookmarks(progress_events(spark, sf_dir).filter("event_type = 'click'"))
    rows = marks.select("doc_id", progress.bookmark_chips(F.col("bookmarks"), 4).alias("c"))
    return rows.select("doc_id", F.array_join(F.col("c.chips").cast("array<string>"), ",").alias("chips"), "c.more")


@query(f"WITH {sql.LIB}, i AS (SELECT DISTINCT user_id + 7 AS doc_id FROM events) SELECT i.doc_id, title, lib.doc_id IS NOT NULL AS found FROM i LEFT JOIN lib ON i.doc_id = lib.doc_id")
def opened_documents(spark, sf_dir):
    """Documents by the ids of readers' addresses; some ids are of no document."""
    ids = progress_events(spark, sf_dir).select((F.col("doc_id") + 7).alias("doc_id")).distinct()
    return library.looked_up(lib(spark, sf_dir).drop("text"), ids).select("doc_id", "title", "found")


@query("""WITH c AS (SELECT user_id, max(struct_pack(ts := ts, e := event_id)) AS last, max(struct_pack(ts := ts, e := event_id, k := event_type = 'click')) AS l FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN l.k THEN 100 + l.e % 500 ELSE 300 END :: INTEGER AS wpm, CASE WHEN l.k THEN 40 ELSE 80 END :: INTEGER AS depth, 'dark' AS theme FROM c""")
def settings_reset(spark, sf_dir):
    """Each reader's stored settings; those whose last event is no click have set them back to the defaults."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("l"))
    stored = F.from_json(F.concat(F.lit('{"wpm":'), (F.col("l.event_id") % 500 + 100).cast("string"), F.lit(',"threeD":{"depth":40}}')), settings.schema())
    kept = F.when(F.col("l.event_type") == "click", settings.saved(settings.merged(stored))).otherwise(settings.reset())
    rows = settings.load_settings(last.select("user_id", kept.alias("settings")))
    return rows.select("user_id", F.col("settings.wpm").alias("wpm"), F.col("settings.threeD.depth").alias("depth"), F.col("settings.backgroundTheme").alias("theme"))
