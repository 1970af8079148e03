"""Text out of word-processor files, e-books and pages: archives opened in tasks, everything else on tables.

Each function takes (doc_id, content) and gives one row for each document: text, warnings, error. A document that cannot be
read has an error and no text; nothing fails for another one's sake.
"""

from __future__ import annotations

import io
import lzma
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.columns import arrow_udf, computed
from lectern.functions.encoding import book_text_bytes, unsigned
from lectern.functions.text import docx_text, js_length, js_trim, markup_to_plain, page_text, sanitize_control
from lectern.operators import chapters as book
from lectern.operators.decoding import best_decoding, decoding_warnings
from lectern.shipping import written

LEAST_BOOK_CHARACTERS = 500
#: No member of an archive may unpack to more.
MEMBER_BYTES = 1 << 28


#: What is raised where an archive or a member of it is broken or encrypted.
_BROKEN = (zipfile.BadZipFile, OSError, RuntimeError, ValueError, NotImplementedError, EOFError, zlib.error, lzma.LZMAError)


def _directory(contents: pd.Series) -> pd.DataFrame:
    rows = []
    for data in contents:
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as archive:
                rows.append(([{"path": i.filename, "packed": i.compress_size, "unpacked": i.file_size} for i in archive.infolist()], None))
        except _BROKEN as e:
            rows.append((None, str(e) or type(e).__name__))
    return pd.DataFrame(rows, columns=["entries", "error"])


def _unpacked(archive: zipfile.ZipFile, path: str, most: int) -> str:
    with archive.open(path) as member:
        data = member.read(most + 1)
    if len(data) > most:
        raise ValueError(f'Archive member "{path}" unpacks to more than {most} bytes.')
    return data.decode("utf-8", "replace")


def _members(contents: pd.Series, wanted: pd.Series, most: pd.Series) -> pd.DataFrame:
    rows = []
    for data, paths, limit in zip(contents, wanted, most, strict=True):
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as archive:
                known = archive.NameToInfo
                paths = dict.fromkeys(p for p in (() if paths is None else paths) if p in known)
                rows.append(([{"path": p, "text": _unpacked(archive, p, limit)} for p in paths], None))
        except _BROKEN as e:
            rows.append((None, str(e) or type(e).__name__))
    return pd.DataFrame(rows, columns=["members", "error"])


def archive_directory(content: Column) -> Column:
    """struct<entries, error>: what a zip archive's directory lists (path, packed and unpacked size); no member is unpacked."""
    return arrow_udf(_directory, "struct<entries:array<struct<path:string,packed:bigint,unpacked:bigint>>,error:string>", content)


def archive_members(content: Column, paths: Column, most_bytes: int = MEMBER_BYTES) -> Column:
    """struct<members, error>: the texts (path, text) of the named members of a zip archive, each once, in the order of ``paths``.

    Members are found by the archive's directory and only these are unpacked. Names that are not there are left out. A broken
    member, or one of more than ``most_bytes`` whatever the directory says of it, gives an error and no members.
    """
    return arrow_udf(_members, "struct<members:array<struct<path:string,text:string>>,error:string>", content, paths, F.lit(most_bytes))


def _member(members: Column, path: Column | str) -> Column:
    """The text of one member, null if it is not among them."""
    path = F.lit(path) if isinstance(path, str) else path
    return F.get(F.filter(members, lambda m: m["path"] == path), F.lit(0))["text"]


def _no_warnings() -> Column:
    return F.array().cast("array<string>")


def docx_documents(files: DataFrame, most_bytes: int = MEMBER_BYTES) -> DataFrame:
    """(doc_id, text, warnings, error) of word-processor archives."""
    path = "word/document.xml"
    opened = files.select("doc_id", archive_members(F.col("content"), F.array(F.lit(path)), most_bytes).alias("x")).select("doc_id", _member(F.col("x.members"), path).alias("xml"), "x.error")
    read = opened.withColumn("d", F.when(F.col("xml").isNotNull(), docx_text(F.col("xml"))))
    missing = F.when(F.col("xml").isNull(), f"DOCX archive is missing {path}")
    return read.select("doc_id", F.col("d.text").alias("text"), F.coalesce("d.warnings", _no_warnings()).alias("warnings"), F.coalesce("error", missing).alias("error"))


def epub_documents(files: DataFrame, skip_non_linear: bool = True, include_image_alt: bool = True, respect_aria_hidden: bool = False, compat: bool = False, most_bytes: int = MEMBER_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, chapters) of e-books: doc_id, text, title, author, warnings, error; and doc_id, pos, id, title, start_char, end_char.

    Within each row the container names the package, the package names the members to read, and only these are unpacked.
    """
    unpack = lambda rows, paths: rows.withColumn("x", archive_members(F.col("content"), paths, most_bytes))
    fixed_paths = ("META-INF/container.xml", "META-INF/encryption.xml")
    opened = unpack(files.select("doc_id", "content"), F.array(*map(F.lit, fixed_paths)))
    opened = opened.select("doc_id", "content", F.col("x.error").alias("zip_error"), *[_member(F.col("x.members"), p).alias(n) for p, n in zip(fixed_paths, ("container", "encryption"), strict=True)])
    opened = opened.withColumns({"protected": book.is_protected(F.col("encryption")), "opf_path": book.package_path(F.col("container"))})
    opened = unpack(opened, F.array("opf_path")).withColumns({"opf": _member(F.col("x.members"), F.col("opf_path")), "zip_error": F.coalesce("zip_error", "x.error")})
    wanted = F.when(~F.col("protected"), book.wanted_paths(F.col("opf"), F.col("opf_path"), compat))
    opened = unpack(opened, wanted).withColumns({"entries": F.col("x.members"), "zip_error": F.coalesce("zip_error", "x.error")})
    packages = written(opened.select("doc_id", "zip_error", "protected", "container", "opf_path", "opf", "entries"), "book-entries")
    entries = packages.select("doc_id", F.explode("entries").alias("e")).select("doc_id", "e.path", "e.text")
    usable = packages.filter("not protected and opf is not null").select("doc_id", "opf_path", "opf")
    packages = packages.drop("entries")
    manifest, spine = book.manifest(usable), book.spine(usable)
    placed = manifest.join(usable.select("doc_id", "opf_path"), "doc_id").withColumn("path", book.resolved_path(F.col("opf_path"), F.col("href"), compat)).join(entries, ["doc_id", "path"])
    ncx = placed.filter("media_type = 'application/x-dtbncx+xml'").withColumn("source", F.struct(F.lit(0).alias("kind"), "pos"))
    nav = placed.filter("media_type = 'application/xhtml+xml' and href like '%nav%'").withColumn("source", F.struct(F.lit(1).alias("kind"), "pos"))
    # A book may have several navigation files: the first with entries counts, the older kind before the newer one.
    keyed = lambda rows: rows.select(F.struct("doc_id", "source").alias("doc_id"), "text")
    contents = book.ncx_contents(keyed(ncx), compat).unionByName(book.nav_contents(keyed(nav))).select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.source").alias("source"), "ord", "title", "href")
    first = contents.groupBy("doc_id").agg(F.min("source").alias("source"))
    contents = contents.join(first, ["doc_id", "source"]).select("doc_id", "ord", "title", "href")
    parts = book.spine_chapters(spine, manifest, entries, usable.select("doc_id", "opf_path"), contents, skip_non_linear, include_image_alt, respect_aria_hidden, compat)
    counts = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    texts = packages.join(book.joined_text(parts), "doc_id", "left").join(counts(manifest, "items"), "doc_id", "left").join(counts(spine, "refs"), "doc_id", "left")
    fixed = F.col("opf").contains("rendition:layout") & book.any_of(F.col("opf"), ("pre-paginated", "fixed-layout"))
    error = (
        F.when(F.col("zip_error").isNotNull(), F.concat(F.lit("This file doesn't appear to be a valid EPUB. The archive structure is corrupted or invalid. "), "zip_error")).when(F.col("protected"), "This EPUB is DRM-protected and cannot be read. Please use a DRM-free version.")
        .when(F.col("container").isNull(), "Invalid EPUB structure: Invalid EPUB: missing META-INF/container.xml").when(F.col("opf_path").isNull(), "Invalid EPUB structure: Invalid EPUB: cannot locate package document in container.xml")
        .when(F.col("opf").isNull(), F.concat(F.lit('Invalid EPUB: package document not found at "'), F.col("opf_path"), F.lit('". The EPUB structure may be corrupted.')))
        .when(F.coalesce("items", F.lit(0)) == 0, "Invalid EPUB: manifest is empty or cannot be parsed").when(F.coalesce("refs", F.lit(0)) == 0, "Invalid EPUB: spine is empty or cannot be parsed - cannot determine reading order")
        .when(js_length(js_trim(F.coalesce("text", F.lit("")))) < LEAST_BOOK_CHARACTERS, F.when(fixed, "This EPUB appears to be fixed-layout with no text layer. Image-only pages aren't supported.").otherwise("This EPUB doesn't contain extractable text (may render text with scripts or images only)."))
    )
    marked = texts.withColumn("error", error)
    rtl = F.when(F.col("opf").contains("rtl") & F.col("error").isNull(), F.array(F.lit("This EPUB contains right-to-left text. Display may not be fully optimized."))).otherwise(_no_warnings())
    about = book.metadata(F.col("opf"))
    documents = marked.select("doc_id", F.when(F.col("error").isNull(), js_trim(F.col("text"))).alias("text"), about["title"].alias("title"), about["author"].alias("author"), rtl.alias("warnings"), "error")
    return documents, parts.select("doc_id", "pos", "id", "title", "start_char", "end_char")


def _ascii(data: Column, at: int, size: int) -> Column:
    return F.decode(F.substring(data, F.lit(at + 1), F.lit(size)), "ISO-8859-1")


def mobi_headers(files: DataFrame) -> DataFrame:
    """``files`` with the fields of the database, document and book headers, and the first error found in them."""
    c = F.col("content")
    # The first error is decided before fields behind it are read; fields beyond the end are null.
    rows = files.withColumns({"size": F.octet_length(c), "kind": _ascii(c, 60, 4), "creator": _ascii(c, 64, 4), "listed": unsigned(c, 76, 2)})
    # Offsets are read of books only, and no more than the file has room for, whatever number it claims.
    held = F.least("listed", F.floor((F.col("size") - 78) / 8) + 1)
    offsets = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(held - 1, F.lit(0)).cast("int")), lambda i: unsigned(c, i * 8 + 78, 4)), lambda o: o.isNotNull())
    is_book = (F.col("kind") == "BOOK") & (F.col("creator") == "MOBI") & (F.col("listed") > 0)
    rows = rows.withColumn("offsets", F.when(is_book, offsets).otherwise(F.array().cast("array<bigint>"))).withColumn("records", F.size("offsets"))
    # Offsets may be anything; what lies beyond the file is its end.
    start = F.least(F.get("offsets", F.lit(0)), F.col("size")).cast("int")
    first_end = F.greatest(start, F.least(F.get("offsets", F.lit(1)), F.col("size")).cast("int"))
    rows = rows.withColumns({"start": start, "first_size": F.greatest(first_end - start, F.lit(0))})
    at = F.col("start")
    rows = rows.withColumns({"compression": unsigned(c, at, 2), "text_length": unsigned(c, at + 4, 4), "text_records": unsigned(c, at + 8, 2), "encryption": unsigned(c, at + 12, 2), "magic": unsigned(c, at + 16, 4), "header_length": unsigned(c, at + 20, 4), "code_page": unsigned(c, at + 28, 4), "first_other": F.coalesce(unsigned(c, at + 124, 4), F.lit(0).cast("long"))})
    error = (
        F.when(F.col("size") < 84, "This file is too small to be a valid MOBI document.")
        .when((F.col("kind") != "BOOK") | (F.col("creator") != "MOBI"), F.concat(F.lit("Invalid MOBI file format (type: "), "kind", F.lit(", creator: "), "creator", F.lit("). Expected BOOK/MOBI.")))
        .when(F.col("records") == 0, "This MOBI file does not contain any records.").when(F.col("first_size") < 16, "PalmDOC header missing or truncated")
        .when(F.col("encryption") != 0, "This book is DRM-protected and cannot be read. Please use a DRM-free version.")
        .when(F.col("compression") > 2, "This MOBI uses Huff/CDIC compression which is not supported yet. Please try a different version of the book.")
        .when(~F.col("compression").isin(1, 2), F.concat(F.lit("This MOBI uses an unsupported compression method ("), F.col("compression").cast("string"), F.lit("). Only uncompressed and PalmDOC compression are supported.")))
        .when(at + 36 > F.col("size"), "MOBI header is truncated").when(F.col("magic") != 0x4D4F4249, "Invalid MOBI header signature")
    )
    return rows.withColumn("error", error)


def mobi_metadata(headers: DataFrame) -> DataFrame:
    """(doc_id, title, author) from the extended header: records of type 503 and 100, the last of each."""
    c, at = F.col("content"), (F.col("start") + 16 + F.col("header_length")).try_cast("int")
    rows = headers.filter("error is null").withColumn("at", at).withColumn("flags", unsigned(c, F.col("start") + 16 + 128, 4)).filter(F.col("flags").bitwiseAND(0x40) != 0)
    rows = rows.filter(unsigned(c, F.col("at"), 4) == 0x45585448).withColumn("n", unsigned(c, F.col("at") + 8, 4))
    empty = F.struct((F.col("at") + 12).alias("next"), F.lit(None).cast("binary").alias("title"), F.lit(None).cast("binary").alias("author"), F.lit(True).alias("going"))

    def step(s: Column, _: Column) -> Column:
        kind, size = unsigned(c, s["next"], 4), unsigned(c, s["next"] + 4, 4)
        fits = s["going"] & size.isNotNull() & (size >= 8) & (s["next"] + size <= F.octet_length(c))
        data = F.when(fits & (size > 8), F.substring(c, (s["next"] + 9).cast("int"), (size - 8).cast("int")))
        return F.struct(F.when(fits, s["next"] + size.cast("int")).otherwise(s["next"]).cast("int").alias("next"), F.when(kind == 503, F.coalesce(data, s["title"])).otherwise(s["title"]).alias("title"), F.when(kind == 100, F.coalesce(data, s["author"])).otherwise(s["author"]).alias("author"), fits.alias("going"))

    found = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n", F.octet_length(c) / 8), F.lit(1)).cast("int")), empty, step)
    rows = rows.withColumn("m", found)
    text = lambda name: F.when(F.is_valid_utf8(F.col(f"m.{name}").cast("string")), F.col(f"m.{name}").cast("string"))
    return rows.select("doc_id", text("title").alias("title"), text("author").alias("author"))


def mobi_text_bytes(headers: DataFrame) -> DataFrame:
    """(doc_id, code_page, data): the text records, decompressed and joined as far as the declared length, without zeros at the end.

    All of it happens within the row; books without a record of text are absent.
    """
    last = F.when((F.col("first_other") > 0) & (F.col("first_other") < F.col("records")), F.col("first_other")).otherwise(F.greatest(F.lit(0), F.least(F.col("records") - 1, F.when(F.col("text_records") > 0, F.col("text_records")).otherwise(F.col("records") - 1))) + 1)

    def record(i: Column) -> Column:
        begin = F.least(F.get("offsets", i), "size")
        end = F.least("size", F.greatest(begin, F.coalesce(F.get("offsets", i + 1), "size")))
        return F.substring("content", (begin + 1).cast("int"), (end - begin).cast("int"))

    rows = headers.filter("error is null").withColumn("last", F.least(last, "records").cast("int"))
    records = F.when(F.col("last") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.col("last") - 1, F.lit(1))), record)).otherwise(F.array().cast("array<binary>"))
    joined = computed(rows, data=book_text_bytes(records, F.col("compression"), F.col("text_length")))
    return joined.select("doc_id", "code_page", "data").filter("data is not null")


def mobi_documents(files: DataFrame) -> DataFrame:
    """(doc_id, text, title, author, warnings, error) of Palm database books."""
    headers = written(mobi_headers(files), "book-headers")
    decoded = best_decoding(mobi_text_bytes(headers))
    plain = computed(decoded, plain=markup_to_plain(sanitize_control(F.col("text"))))
    shown = decoding_warnings(plain)
    rows = headers.select("doc_id", "error").join(shown, "doc_id", "left").join(mobi_metadata(headers), "doc_id", "left")
    empty = F.when(F.col("error").isNull() & F.col("text").isNull(), "No text records could be extracted from MOBI file")
    return rows.select("doc_id", "text", "title", "author", F.coalesce("warnings", _no_warnings()).alias("warnings"), F.coalesce("error", empty).alias("error"))


def pdf_documents(items: DataFrame, least_characters: int = 20) -> DataFrame:
    """(doc_id, text, warnings, pages) of ``items`` (doc_id, page_no, item_no, str), the text items of pages."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("item_no", F.col("str").alias("s")))), lambda x: x["s"])
    pages = items.groupBy("doc_id", "page_no").agg(page_text(ordered).alias("text"))
    short = F.when(js_length(F.col("text")) < least_characters, F.concat(F.lit("Page "), F.col("page_no").cast("string"), F.lit(" contains little or no selectable text.")))
    parts = F.array_sort(F.collect_list(F.struct("page_no", "text", short.alias("warning"))))
    joined = pages.groupBy("doc_id").agg(parts.alias("p"))
    return joined.select("doc_id", js_trim(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")).alias("text"), F.array_compact(F.transform("p", lambda x: x["warning"])).alias("warnings"), F.size("p").alias("pages"))
