"""Imports as a stream, the library's versions and plans, double taps across ranges, lenient decoding, counts of characters."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import encoding, quality
from lectern.operators import decoding, progress
from lectern.sources.store import Library
from lectern.streaming.imports import arriving_files, import_batch, import_stream

PAYLOAD = "id string, title string, source_format string, content string, is_readable boolean, unreadable_reason string, conversion_warnings array<string>"


def payloads(spark, *rows):
    return spark.createDataFrame([(i, t, "TXT", c, True, None, None) for i, t, c in rows], PAYLOAD)


def live(library, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in library.documents().collect()}


def test_batches_replace_themselves(spark, tmp_path):
    """Three files in batches of one; a stream without its checkpoint starts at the first batch again and leaves the same rows."""
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    for i in range(3):
        (folder / f"Book {i}.txt").write_text(f"These are quite enough characters of book {i}.")
    start = lambda check: import_stream(spark, str(tmp_path / "in"), str(tmp_path / "lib"), str(tmp_path / check), files_per_batch=1, buckets=2).trigger(availableNow=True).start().awaitTermination()
    start("c1")
    library = Library(spark, str(tmp_path / "lib"), 2)
    first = live(library, "title", "content", "created_at", "is_readable")
    assert sorted(v[0] for v in first.values()) == ["Book 0", "Book 1", "Book 2"] and all(v[3] for v in first.values())
    assert library.versions().select("batch").distinct().count() == 3
    start("c2")
    assert live(library, "title", "content", "created_at", "is_readable") == first and library.versions().count() == 3
    (folder / "late.txt").write_text("few")
    start("c1")
    rows = {r["title"]: r for r in library.documents().collect()}
    assert len(rows) == 4 and rows["late"]["unreadable_reason"] == "This TXT file does not contain readable text content."


def test_one_batch_written_twice(spark, tmp_path):
    (tmp_path / "a.txt").write_text("These are quite enough characters to read.")
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.txt"))
    library = Library(spark, str(tmp_path / "lib"), 2)
    for batch in ("x-0", "x-0", "x-1"):
        import_batch(files, library, batch)
    assert library.versions().count() == 2 and library.documents().count() == 1
    assert arriving_files(spark, str(tmp_path)).isStreaming


def test_two_writers_from_one_snapshot(spark, tmp_path):
    one, two = (Library(spark, str(tmp_path / "lib"), 2) for _ in range(2))
    one.add(payloads(spark, ("a", "A", "some words"), ("b", "B", "more"), ("a", "A", "some words")), 1000)
    seen_one, seen_two = one.documents(), two.documents()
    one.update(seen_one.select("id", F.lit("new title").alias("title")), 2000)
    two.update(seen_two.select("id", F.lit(9).cast("long").alias("chunk_index")), 2000)
    two.update(spark.createDataFrame([("a", "early")], "id string, title string"), 1500)
    assert live(one, "title", "chunk_index", "updated_at", "content") == {"a": ("new title", 9, 2000, "some words"), "b": ("new title", 9, 2000, "more")}
    one.update(spark.createDataFrame([("b", "three new words")], "id string, content string"), 3000)
    assert live(two, "content", "word_count", "title")["b"] == ("three new words", 3, "new title")
    two.delete(spark.createDataFrame([("a",), ("unknown",)], "id string"), 4000)
    one.update(spark.createDataFrame([("a", 3)], "id string, chunk_index long"), 5000)
    small = one.compact(str(tmp_path / "small"))
    assert live(one, "content") == live(small, "content") == {"b": ("three new words",)}
    assert small.versions().count() == 1
    one.add(payloads(spark, ("a", "again", "back")), 6000)
    assert live(one, "title", "chunk_index")["a"] == ("again", 0)


def test_texts_are_not_shuffled(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"), 4)
    library.add(payloads(spark, *[(str(i), f"T{i}", f"text {i}") for i in range(50)]), 1000)
    library.update(library.cards().select("id", F.lit("x").alias("title")), 2000)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange", plan(library.documents())) and "SelectedBucketsCount: 4 out of 4" in plan(library.documents())
    assert not re.search("Exchange|content:string|content#", plan(library.cards()).replace("content_batch", ""))
    assert library.documents().count() == 50


def taps_by_force(rows, within):
    out, last, doc = [], None, None
    for d, i, us in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        last = last if d == doc else None
        second = last is not None and us - last < within * 1000
        out += [i] if second else []
        last, doc = None if second else us, d
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_double_taps_across_ranges(spark, parts):
    """One document holds most taps, long runs of close ones among them, and lies in many ranges."""
    rng, rows, now = random.Random(parts), [], {}
    for i in range(1500):
        d = 0 if rng.random() < 0.7 else rng.randint(1, 30)
        now[d] = now.get(d, 0) + rng.choice([0, 100_000, 200_000, 349_999, 350_000, 900_000] if i % 300 < 150 else [50_000])
        rows.append((d, i, now[d]))
    taps = spark.createDataFrame(rows, "doc_id long, event_id long, us long").select("doc_id", "event_id", F.timestamp_micros("us").alias("ts"))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = progress.double_taps(taps, 350)
        assert got.columns == ["doc_id", "event_id", "ts"]
        assert sorted(r["event_id"] for r in got.collect()) == taps_by_force(rows, 350)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert progress.double_taps(taps.limit(0), 350).count() == 0


def lenient_by_force(data):
    out, at = "", 0
    while at < len(data):
        lead, at = data[at], at + 1
        size = 0 if lead < 0x80 else 1 if 0xC0 <= lead < 0xE0 else 2 if 0xE0 <= lead < 0xF0 else 3 if 0xF0 <= lead < 0xF8 else None
        if size is None or at + size > len(data):
            continue
        point = lead if not size else lead & (0x1F, 0x0F, 0x07)[size - 1]
        for b in data[at : at + size]:
            point = point * 64 + b % 64
        at += size
        out += chr(point) if point <= 0x10FFFF and not 0xD800 <= point <= 0xDFFF else "�"
    return out


def test_lenient_decoding_by_brute_force(spark):
    rng = random.Random(5)
    cases = [bytes(rng.choice([65, 10, 0x80, 0xC1, 0xC3, 0xE2, 0xED, 0xF0, 0xF5, 0xFF, rng.randrange(256)]) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    assert all(encoding.utf8_lenient(c) == lenient_by_force(c) for c in cases)
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases[:300])] + [(-1, None)], "i long, b binary")
    got = {r["i"]: r["t"] for r in rows.select("i", encoding.text_of_bytes(F.col("b")).alias("t")).collect()}
    assert got.pop(-1) is None
    for i, text in got.items():
        try:
            want = cases[i].decode()
        except UnicodeDecodeError:
            want = lenient_by_force(cases[i])
        assert text == want


def test_counts_agree_with_the_expressions(spark):
    """The histogram gives what the built-in expressions give, on odd characters, long texts, empty and null ones."""
    rng = random.Random(8)
    letters = "aZ \t\n\r\x00\x07\x1f\x7f\x80\xbf\xc2\xc3\xe2\xd0\xd1�😀éthe"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["", None, "the and " * 8000, "Ã" + "\u0080" * 3, "â\u0080\u0099Ã"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    one, two = quality.quality_columns(F.col("t")), quality.measures(F.array("t"))[0]
    spelled = {k: getattr(quality, k)(F.left("t", F.lit(quality.SAMPLE_CHARACTERS))) for k in quality.MEASURES[:5]}
    shown = lambda c, names: F.struct(*[c[k].cast("double").alias(k) for k in names])
    for r in rows.select("i", shown(one, quality.MEASURES).alias("a"), shown(two, quality.MEASURES).alias("b"), shown(spelled, spelled).alias("c")).collect():
        assert r["a"] == r["b"] and r["a"][:5] == r["c"], texts[r["i"]]
    many = rows.filter("t is not null").agg(F.collect_list("t").alias("ts")).select(F.arrays_zip("ts", quality.measures(F.col("ts")).alias("m")).alias("z")).select(F.inline("z"))
    assert {r["ts"]: r["m"] for r in many.collect()} == {r["t"]: r["m"] for r in rows.filter("t is not null").select("t", two.alias("m")).collect()}
    whole = quality.quality_columns(F.col("t"), None, None)["english_density"]
    late = spark.createDataFrame([("x " * 30_000 + "the " * 30_000,)], "t string")
    assert late.select(whole).first()[0] == 1.0 and late.select(quality.quality_columns(F.col("t"))["english_density"]).first()[0] == 0.0


def test_decodings_stay_within_the_row(spark):
    rows = spark.createDataFrame([(1, bytearray("né’e".encode()), 1252), (2, None, 1252), (3, bytearray(b""), None)], "doc_id long, data binary, code_page int")
    best = decoding.best_decoding(rows)
    assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: (r["text"], r["encoding"], r["transform"]) for r in best.collect()}
    assert got[1] == ("né’e", "utf-8", "direct") and got[2][0] == got[3][0] == "" and got[3][1] == "utf-8"
    tried = decoding.decoding_candidates(rows).filter("doc_id = 1").collect()
    assert len({(r["encoding"], r["transform"]) for r in tried}) == len(tried) and tried[0]["prio"] == 0


ODD = [("wiki", "These are quite enough characters to be read.\n\n\n\nMore of them."), ("a/b %41+c", "A name with signs of addresses; the text is long enough."), ("_hidden", "few"), ("ü é", ""), (None, "short"), ("wiki", " " * 30)]


@pytest.fixture
def odd_documents(spark, tmp_path):
    rows = [(i, text, source) for i, (source, text) in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    return str(tmp_path / "sf")


def test_imported_library_of_odd_names(spark, odd_documents):
    """Files are called what SQL says, whatever signs are in a name, and none is lost."""
    import duckdb

    from lectern.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{odd_documents}/documents.parquet/*.parquet'")
    got, want = QUERIES["imported_library"](spark, odd_documents), con.sql(ORACLES["imported_library"])
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(str(spark.createDataFrame([r], got.select(*want.columns).schema).first()) for r in want.fetchall())


def test_folder_of_many_files_has_few_folders(spark, tmp_path):
    """A folder for each file made readers list as many folders as there were files."""
    from lectern.sources import files

    rows = spark.range(1500).select(F.concat(F.lit("n_"), F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.encode(F.concat(F.lit("text "), F.col("id").cast("string")), "UTF-8").alias("content"))
    assert files.write_files(rows, f"file://{tmp_path}/in") == 1500
    assert len([p for p in (tmp_path / "in").rglob("*") if p.is_dir()]) <= files.FOLDERS
    found = files.read_files(spark, f"{tmp_path}/in", "*.txt").select(files.written_name(F.col("uri")).alias("name"), F.decode("content", "UTF-8").alias("t")).collect()
    assert sorted((r["name"], r["t"]) for r in found) == sorted((f"n_{i}.txt", f"text {i}") for i in range(1500))
    assert files.write_files(rows.limit(0), f"file://{tmp_path}/none") == 0


def test_only_formats_that_occur_are_planned(spark):
    """A batch of plain texts needs no reader of books; rows are those of all readers."""
    from lectern.sources.files import extract_texts, formats_of

    rows = spark.createDataFrame([(i, None, f"f{i}.txt", None, None, bytearray(b"quite enough characters to read %d" % i)) for i in range(3)] + [(9, None, "f.txt", None, None, None)], "doc_id long, uri string, name string, mime_type string, base64 string, content binary")
    assert formats_of(rows) == {"TXT"} and formats_of(rows.limit(0)) == set()
    less, whole = extract_texts(rows, formats=formats_of(rows)), extract_texts(rows)
    assert sorted(map(str, less.collect())) == sorted(map(str, whole.collect()))
    assert "Join" not in less._jdf.queryExecution().optimizedPlan().toString()


def test_playback_counts_words_once(spark, odd_documents):
    from lectern.plans.queries import QUERIES

    plan = QUERIES["playback_index"](spark, odd_documents)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_plain_texts_take_one_pass(spark, tmp_path, monkeypatch):
    """A batch of plain texts is written once and dealt to few tasks; it was written twice, after a look at its formats, a task for every 32 files."""
    from lectern.streaming import imports

    (tmp_path / "in").mkdir()
    for i in range(600):
        (tmp_path / "in" / f"n{i}.txt").write_text(f"These are quite enough characters of text {i}.")
    seen, write = [], imports.written
    monkeypatch.setattr(imports, "written", lambda df, name: (seen.append((name, df.rdd.getNumPartitions())), write(df, name))[1])
    import_stream(spark, str(tmp_path / "in"), str(tmp_path / "lib"), str(tmp_path / "check"), buckets=2).trigger(availableNow=True).start().awaitTermination()
    assert [name for name, _ in seen] == ["import-files"] and seen[0][1] <= 8
    assert Library(spark, str(tmp_path / "lib"), 2).documents().filter("is_readable").count() == 600


def test_formats_of_one_batch(spark, tmp_path):
    """Plain texts go with the pass over the files, all other formats their own way; together they are what every reader gives."""
    from lectern.sources.files import extract_texts, read_files

    (tmp_path / "in").mkdir()
    for name in ("a.txt", "b.html", "c.docx", "d.pdf", "e", "f.epub", "g.mobi", "h.rtf", "i.doc", "j.txt"):
        (tmp_path / "in" / name).write_bytes(b"few" if name == "j.txt" else b"These are quite enough characters of %s, \xe9 and more." % name.encode())
    library = Library(spark, str(tmp_path / "lib"), 2)
    import_batch(spark.read.format("binaryFile").load(str(tmp_path / "in")), library, "x-0")
    sources = read_files(spark, str(tmp_path / "in"))
    want = extract_texts(sources).join(sources.select("doc_id", "name"), "doc_id").collect()
    shown = lambda r, text, warnings: (r["source_format"], r[text], r["is_readable"], r["unreadable_reason"], list(r[warnings]))
    got = library.documents().collect()
    assert len(got) == 10 and {r["title"] for r in got} == set("abcdefghij")
    assert sorted(shown(r, "content", "conversion_warnings") for r in got) == sorted((*shown(r, "text", "warnings"),) for r in want)
