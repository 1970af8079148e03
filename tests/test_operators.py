from __future__ import annotations

import io
import struct
import zipfile

from pyspark.sql import functions as F

from lectern.functions import display
from lectern.operators import chapters, containers, decoding, library, progress
from lectern.sources import settings, store
from lectern.sources.files import extract_texts, read_files

LONG = "This is a chapter with enough words to read. " * 15


def docx(xml: str) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    return data.getvalue()


def epub(folder: str = "OEBPS/", encryption: str | None = None, **files: str) -> bytes:
    opf = f"""<package><metadata><dc:title>A &amp; B</dc:title><dc:creator>Me</dc:creator></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/>
    <item id="c" href="c.xhtml" media-type="application/xhtml+xml"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="a"/><itemref idref="c" linear="no"/><itemref idref="zz"/><itemref idref="b"/></spine></package>"""
    ncx = "<ncx><navPoint id='1'><navLabel><text>First</text></navLabel><content src='a.xhtml#x'/><navPoint id='2'><navLabel><text>Inner</text></navLabel><content src='q.xhtml'/></navPoint></navPoint></ncx>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", f'<container><rootfile full-path="{folder}content.opf"/></container>')
        if encryption:
            z.writestr("META-INF/encryption.xml", encryption)
        for name, content in {"content.opf": opf, "toc.ncx": ncx, "a.xhtml": f"<p>{LONG}</p>", "b.xhtml": "<h1>End</h1>", "c.xhtml": "<p>side</p>", **files}.items():
            z.writestr(folder + name, content)
    return data.getvalue()


def mobi(text: bytes, code_page: int = 65001, compression: int = 1, encryption: int = 0, exth: bool = False) -> bytes:
    extra = struct.pack(">III", 0x45585448, 12 + 11 + 13, 2) + struct.pack(">II", 100, 11) + b"Ann" + struct.pack(">II", 503, 13) + b"Title" if exth else b""
    header = struct.pack(">4sIII", b"MOBI", 132, 2, code_page)
    header += b"\0" * (128 - len(header)) + struct.pack(">I", 0x40 if exth else 0) + extra
    first = struct.pack(">HHIHHHH", compression, 0, len(text), 1, 4096, encryption, 0) + header
    start = 78 + 16
    return b"book".ljust(60, b"\0") + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">H", 2) + struct.pack(">II", start, 0) + struct.pack(">II", start + len(first), 2) + first + text


def table(spark, rows):
    return spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(rows)], "doc_id long, content binary")


def test_docx_documents(spark):
    rows = {r["doc_id"]: r for r in containers.docx_documents(table(spark, [docx("<w:p><w:t>Hi</w:t></w:p>"), b"nothing", epub()])).collect()}
    assert rows[0]["text"] == "Hi" and rows[0]["error"] is None
    assert rows[1]["text"] is None and rows[1]["error"]
    assert rows[2]["error"] == "DOCX archive is missing word/document.xml"


def test_epub_documents(spark):
    files = table(spark, [epub(), epub(folder=""), epub(encryption="<x>lcpl</x>"), b"zip?", epub(**{"a.xhtml": "short"})])
    documents, parts = containers.epub_documents(files)
    rows = {r["doc_id"]: r for r in documents.collect()}
    assert rows[0]["text"] == LONG.strip() + "\n\nEnd" and rows[0]["title"] == "A & B" and rows[0]["author"] == "Me"
    assert rows[1]["text"] == rows[0]["text"]
    assert "DRM" in rows[2]["error"] and "valid EPUB" in rows[3]["error"] and "extractable" in rows[4]["error"]
    found = [(r["title"], r["start_char"], r["end_char"]) for r in parts.filter("doc_id = 0").orderBy("pos").collect()]
    n = len(LONG.strip())
    assert found == [("First", 0, n + 2), ("Chapter 2", n + 2, n + 7)]


def test_epub_original_paths(spark):
    documents, _ = containers.epub_documents(table(spark, [epub(), epub(folder="")]), compat=True)
    errors = {r["doc_id"]: r["error"] for r in documents.collect()}
    assert "extractable" in errors[0] and errors[1] is None


def test_paths(value):
    path = lambda base, rel, **k: value(chapters.resolved_path(F.lit(base), F.lit(rel), **k))
    assert path("OEBPS/content.opf", "ch1.xhtml", compat=True) == "OEBPS/ch1.xhtml/ch1.xhtml"
    assert path("OEBPS/content.opf", "ch1.xhtml") == "OEBPS/ch1.xhtml" and path("content.opf", "ch1.xhtml") == "ch1.xhtml"
    assert path("a/b/c.opf", "../d/./e.x") == "a/d/e.x" and path("a/b.opf", "/x/y") == "x/y"


def test_mobi_documents(spark):
    plain = "Plain words that are long enough to be read, said the book."
    packed = bytes.fromhex("616263801B") + b" and more"
    files = table(spark, [mobi(plain.encode()), mobi(packed, compression=2), mobi(b"x", encryption=1), mobi(b"x", compression=17480), b"short", mobi(plain.encode(), exth=True), mobi("“Quoted” words are here".encode("cp1252"), 1252)])
    rows = {r["doc_id"]: r for r in containers.mobi_documents(files).collect()}
    assert rows[0]["text"] == plain and rows[0]["warnings"] == []
    assert rows[1]["text"].startswith("abcabcabc and")
    assert "DRM" in rows[2]["error"] and "Huff" in rows[3]["error"] and "too small" in rows[4]["error"]
    assert (rows[5]["title"], rows[5]["author"]) == ("Title", "Ann")
    # As UTF-8 the quotes are malformed and dropped; the text without them scores higher than the one with them.
    assert rows[6]["text"] == "Quoted words are here"


def test_best_decoding(spark):
    rows = spark.createDataFrame([(0, bytearray("plain ascii said the book".encode("utf-16-le")), 1200), (1, bytearray(b""), 1252), (2, bytearray("smart ’ quotes of the book — said".encode()), 1252)], "doc_id long, data binary, code_page int")
    got = {r["doc_id"]: r for r in decoding.best_decoding(rows).collect()}
    assert got[0]["text"] == "plain ascii said the book" and got[0]["encoding"] == "utf-16le"
    assert got[1]["text"] == "" and got[2]["encoding"] == "utf-8"


def test_extract_texts(spark, tmp_path):
    enough = "These are quite enough characters to read."
    (tmp_path / "a.txt").write_text(enough + "\r\n")
    (tmp_path / "b.docx").write_bytes(docx(f"<w:p><w:t>{enough}</w:t></w:p>"))
    (tmp_path / "c.rtf").write_bytes(docx(f"<w:p><w:t>{enough}</w:t></w:p>"))
    (tmp_path / "d.html").write_text("<p>no</p>")
    (tmp_path / "e.mobi").write_bytes(mobi(enough.encode()))
    (tmp_path / "f.epub").write_bytes(epub())
    (tmp_path / "g.txt").write_text("few")
    (tmp_path / "h.pdf").write_bytes(b"%PDF")
    sources = read_files(spark, str(tmp_path))
    names = {r["doc_id"]: r["name"] for r in sources.collect()}
    rows = {names[r["doc_id"]]: r for r in extract_texts(sources).collect()}
    assert set(rows) == {p.name for p in tmp_path.iterdir()}
    assert all(rows[n]["text"] == enough and rows[n]["is_readable"] for n in ("a.txt", "b.docx", "c.rtf", "e.mobi"))
    assert rows["c.rtf"]["source_format"] == "DOCX" and rows["c.rtf"]["warnings"]
    assert not rows["d.html"]["is_readable"] and "HTML documents are not supported" in rows["d.html"]["unreadable_reason"]
    assert rows["f.epub"]["is_readable"] and rows["g.txt"]["unreadable_reason"] == "This TXT file does not contain readable text content."
    assert rows["h.pdf"]["unreadable_reason"].startswith("Failed to read PDF")


def test_pdf_documents(spark):
    items = spark.createDataFrame([(1, 1, 0, "Hello"), (1, 1, 1, "  world of readers here"), (1, 2, 0, "x")], "doc_id long, page_no int, item_no int, str string")
    row = containers.pdf_documents(items).first()
    assert row["text"] == "Hello world of readers here\n\nx" and row["warnings"] == ["Page 2 contains little or no selectable text."]


def test_library_views(spark):
    rows = [(1, "b", 100, True, 5, 100), (2, "A", 10, True, 9, 10), (3, "c", 0, False, 99, 0), (4, "a", 50, True, 5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, word_count long, is_readable boolean, updated_ts long, chunk_index long")
    order = lambda o, **k: [r["doc_id"] for r in library.ranked(docs, o, **k).orderBy("rank").collect()]
    assert order("recent") == [3, 2, 1, 4] and order("recent", first=2) == [3, 2] and order("alpha") == [2, 4, 1, 3]
    assert order("alpha", collation="UNICODE") == [4, 2, 1, 3] and order("progress") == [1, 2, 4, 3]
    assert library.continue_reading(docs).first()["doc_id"] == 4
    assert library.totals(docs).first().asDict() == {"files": 4, "readable_files": 3, "total_words": 160}
    assert library.searched(docs, "  ").count() == 4 and library.searched(docs, "A").count() == 2


def test_progress(spark):
    events = spark.createDataFrame([(1, 1, 7, 20), (2, 2, 7, 20), (3, 3, 7, 40), (4, 4, 7, 20)], "event_id long, ts long, doc_id long, chunk_index long").withColumn("ts", F.timestamp_seconds("ts"))
    assert progress.latest_progress(events).first()["chunk_index"] == 20
    assert [r["event_id"] for r in progress.saved_positions(events).orderBy("event_id").collect()] == [1, 3, 4]
    assert progress.bookmarks(events).first()["bookmarks"] == [20, 40]
    assert [r["event_id"] for r in progress.checkpoints(events).collect()] == [3]
    assert sorted(r["event_id"] for r in progress.double_tap_pairs(events, 1500).collect()) == [2, 3, 4]
    assert sorted(r["event_id"] for r in progress.double_taps(events, 1500).collect()) == [2, 4]


def test_bookmark_toggle(value):
    marks = F.array(F.lit(2), F.lit(5))
    assert value(progress.toggled(marks, F.lit(5))) == [2] and value(progress.toggled(marks, F.lit(3))) == [2, 3, 5]


def test_store(spark, tmp_path):
    payload = spark.createDataFrame([("T", "TXT", "some words here", True, None, None), ("U", "PDF", " ", True, "why", ["w"])], "title string, source_format string, content string, is_readable boolean, unreadable_reason string, conversion_warnings array<string>")
    shelf = store.Library(spark, str(tmp_path / "lib"))
    shelf.add(payload, 1000)
    rows = {r["title"]: r for r in shelf.documents().collect()}
    assert rows["T"]["word_count"] == 3 and not rows["U"]["is_readable"] and rows["U"]["unreadable_reason"] == "why"
    shelf.update(spark.createDataFrame([(rows["T"]["id"], 2)], "id string, chunk_index long"), 2000)
    assert shelf.documents().filter("title = 'T'").first()["chunk_index"] == 2
    shelf.delete(spark.createDataFrame([(rows["U"]["id"],)], "id string"), 3000)
    shelf.restore_sample(4000)
    shelf.restore_sample(5000)
    assert sorted(r["id"] for r in shelf.documents().select("id").collect()) == sorted([rows["T"]["id"], store.SAMPLE_ID])
    assert shelf.compact(str(tmp_path / "lib2")).versions().count() == 2


def test_normalized(spark):
    docs = spark.createDataFrame([("x", None, None, "PDF", "a b", None, None, None, None, None, None, None, None)], "id string, title string, format string, source_format string, content string, created_at long, updated_at long, chunk_index long, bookmarks array<bigint>, last_mode string, is_readable boolean, unreadable_reason string, conversion_warnings array<string>")
    row = library.normalized(docs, F.lit(7)).first()
    assert (row["title"], row["format"], row["word_count"], row["created_at"], row["last_mode"]) == ("Untitled Document", "PDF", 2, 7, "2D")


def test_settings(value):
    row = value(settings.parsed(F.lit('{"wpm": 400, "threeD": {"depth": 1}, "other": 1}')))
    assert row["wpm"] == 400 and row["threeD"]["depth"] == 1 and row["threeD"]["defaultStyle"] == "cross" and row["pdf"]["minCharsPerPage"] == 20
    assert value(settings.parsed(F.lit("not json")))["wpm"] == 300


def test_display(value):
    assert round(value(display.contrast(F.lit("#000000"), F.lit("#FFFFFF"))), 6) == 21
    assert value(display.gloss(F.lit("#646464"))) == "#828282" and value(display.contrast_colour(F.lit("#ffffff"))) == "#000000"
    m = display.rotated(display.translated(display.matrix(1, 0, 0, 1, 0, 0), 5, 6), 90)
    p = value(display.mapped_point(m, F.lit(1.0), F.lit(0.0)))
    assert (round(p["x"], 9), round(p["y"], 9)) == (5, 7)
    assert value(display.inverted(display.matrix(0, 0, 0, 0, 1, 1))) is None
    assert value(display.parsed_matrix(F.lit("matrix(1, 2, 3, 4, 5, 6)")))["f"] == 6 and value(display.parsed_matrix(F.lit("x"))) is None


def test_streams(spark, tmp_path):
    from lectern.streaming import progress as stream

    source = tmp_path / "in"
    events = [(1, 7, 1, 10), (2, 7, 2, 20), (2, 7, 2, 20), (3, 8, 3, 5)]
    spark.createDataFrame(events, "event_id long, doc_id long, s long, chunk_index long").withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(str(source))
    read = lambda: spark.readStream.schema("event_id long, doc_id long, chunk_index long, ts timestamp").parquet(str(source))
    stream.write_latest(read(), str(tmp_path / "out"), str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    rows = stream.latest_of(spark.read.parquet(str(tmp_path / "out"))).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["chunk_index"]) for r in rows] == [(7, 20), (8, 5)]
    q = stream.double_tap_stream(read(), 1500).writeStream.format("memory").queryName("taps").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["event_id"] for r in spark.table("taps").collect()] == [2]


def broken_behind(book: bytes, kept: tuple[str, ...]) -> bytes:
    """An archive in which every member's bytes but those of ``kept`` are damaged; the directory stays as it is."""
    data = bytearray(book)
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        for i in z.infolist():
            if i.filename not in kept:
                start = i.header_offset + 30 + len(i.filename)
                data[start : start + i.compress_size] = b"\xff" * i.compress_size
    return bytes(data)


def test_only_named_members_are_unpacked(spark):
    """Of ten thousand members a book needs three; all others are damaged, and it can be read all the same."""
    book = epub(**{f"x{i}.xhtml": "<p>unused</p>" for i in range(10_000)})
    needed = [n for n in zipfile.ZipFile(io.BytesIO(book)).namelist() if not n.rsplit("/", 1)[-1].startswith("x")]
    files = table(spark, [book, broken_behind(book, tuple(needed)), broken_behind(book, tuple(needed[:-1]))])
    rows = [r for r in containers.epub_documents(files)[0].orderBy("doc_id").collect()]
    assert rows[0]["error"] is None and rows[1]["text"] == rows[0]["text"] and rows[1]["error"] is None
    assert rows[2]["text"] is None and rows[2]["error"].startswith("This file doesn't appear to be a valid EPUB.")
    listed = files.select("doc_id", F.size(containers.archive_directory(F.col("content"))["entries"]).alias("n")).collect()
    assert {r["n"] for r in listed} == {len(needed) + 10_000}


def test_members_beyond_the_bound(spark):
    """A member that unpacks to much more than it takes gives an error row, and other rows are read."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b"<w:p>" + bytes(64 << 20))
        z.writestr("small", "s")
    files = table(spark, [data.getvalue(), docx("<w:p><w:t>Hi</w:t></w:p>"), b"", None])
    rows = {r["doc_id"]: r for r in containers.docx_documents(files, most_bytes=1 << 20).collect()}
    errors = [rows[k]["error"] for k in sorted(rows)]
    assert errors == ['Archive member "word/document.xml" unpacks to more than 1048576 bytes.', None, "File is not a zip file", "File is not a zip file"]
    small = files.select("doc_id", containers.archive_members(F.col("content"), F.array(F.lit("small"), F.lit("none"), F.lit("small")), 1 << 20).alias("x")).orderBy("doc_id").first()["x"]
    assert [tuple(m) for m in small["members"]] == [("small", "s")] and small["error"] is None


def test_compressed_records_round_trip():
    """Packed and unpacked again, over few letters, so that references reach into their own output."""
    import random

    from lectern.functions.encoding import book_bytes, palmdoc_bytes
    from lectern.plans.edge_queries import palmdoc_packed

    rng = random.Random(3)
    for _ in range(400):
        data = bytes(rng.choice(b"ab  A\x00\x01\x08\t\x7f\x80\xc3\xff") for _ in range(rng.randint(0, 300)))
        packed = palmdoc_packed(data)
        assert palmdoc_bytes(packed) == data
        cut = rng.randint(0, len(data) + 1)
        assert book_bytes([packed, b"", packed], 2, cut) == ((data + data)[:cut] if cut else data + data).rstrip(b"\0") if packed else True
    assert len(palmdoc_packed(b"ab" * 500)) < 250
    assert book_bytes([b"\x41", b"\x80\x80\x80"], 2, 1) == b"A"


def test_functions_see_slices(spark):
    """A function over Arrow batches gets few rows and bytes at once, however large Spark's batches are, and a long row alone."""
    from lectern.functions import columns

    def sizes(texts):
        return texts.map(lambda _: f"{len(texts)}:{texts.str.len().sum()}")

    length = F.when(F.col("id") % 500 == 7, 2 << 20).otherwise(300).cast("int")
    rows = spark.range(0, 6000, 1, 1).select("id", F.repeat(F.lit("x"), length).alias("text"))
    got = {r["id"]: tuple(map(int, r["s"].split(":"))) for r in rows.select("id", columns.arrow_udf(sizes, "string", F.col("text")).alias("s")).collect()}
    assert len(got) == 6000
    assert all(n == 1 or (n <= columns.SLICE_ROWS and size <= columns.SLICE_BYTES) for n, size in got.values())
    assert all(got[i] == (1, 2 << 20) for i in range(7, 6000, 500))
    assert max(n for n, _ in got.values()) > 100


def test_offsets_are_read_of_books_only(spark):
    """A file that claims 65,535 records has offsets only as far as it goes, and none if it is no book."""
    from lectern.operators import containers

    body = lambda kind: bytearray(b"\0" * 60 + kind + b"\0" * 8 + b"\xff\xff" + b"\0\0\0\x56\0\0\0\0" * 4 + b"\0" * 3)
    rows = spark.createDataFrame([(1, body(b"BOOKMOBI")), (2, body(b"TEXTREAD")), (3, bytearray(b"\xff" * 500)), (4, bytearray(b"BOOK")), (5, None)], "doc_id long, content binary")
    got = {r["doc_id"]: r for r in containers.mobi_headers(rows).collect()}
    assert {i: r["records"] for i, r in got.items()} == {1: 4, 2: 0, 3: 0, 4: 0, 5: 0}
    assert list(got[1]["offsets"]) == [0x56] * 4
    assert got[2]["error"] == "Invalid MOBI file format (type: TEXT, creator: READ). Expected BOOK/MOBI." and got[4]["error"] == "This file is too small to be a valid MOBI document."
