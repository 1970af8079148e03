from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import encoding, files, quality, reading, text
from lectern.functions.text import once

L = F.lit


@pytest.mark.parametrize("name, mime, kind", [("report.PDF", None, "PDF"), ("README", "text/html", "HTML"), ("pdf", None, "PDF"), ("x.bin", "application/x-word", "DOCX"), ("x.bin", None, "TXT"), ("a.htm", "application/pdf", "HTML"), ("a.bin", "x/pdf", "PDF")])
def test_format(value, name, mime, kind):
    assert value(files.document_format(L(name), L(mime).cast("string"))) == kind


def test_names(value):
    assert value(text.title_of_file(L("My.Book.EPUB"))) == "My.Book"
    assert value(text.title_of_file(L(".pdf"))) == "Untitled Document"
    assert value(files.name_in_uri(L("file:///a/b.txt?x=1#f"))) == "b.txt"
    assert value(files.name_in_uri(L("?#"))) == "document"
    assert value(files.is_remote(L("blob:x"))) and not value(files.is_remote(L("file:///x")))
    assert value(files.recognition_language(L("ja"))) == "jpn" and value(files.recognition_language(L("xx"))) == "eng"


def test_cleaning(value):
    assert value(text.clean_text(L("a\r\n\r\n\r\n\r\nb  \tc"))) == "a\n\nb c"
    assert value(text.clean_text(L(" so­ft﻿"))) == "soft"
    assert value(text.markup_to_plain(L("<p>A</p><p>B</p>"))) == "A B"
    assert value(text.markup_to_plain(L("<p>A</p><p>B</p>"), keep_paragraphs=True)) == "A\n\nB"
    assert value(text.markup_to_plain(L("<ul><li>a</li></ul>"))) == "• a"
    assert value(text.markup_to_plain(L("x<style>p{}</style><script>1</script>y<hr>z"))) == "xy --- z"
    assert value(text.sanitize_control(L("a\x01b  \n\n  c�\n"))) == "a bc"  # a blank line between goes with both its breaks
    assert value(text.recognized_text(L(" a\r\n\r\n\r\nb  c "))) == "a\n\nb c"
    assert value(text.page_text(F.array(L("a "), L(None).cast("string"), L(" b")))) == "a b"


def test_entities(value):
    assert value(text.decode_entities(L("&amp;lt;"))) == "<"
    assert value(text.decode_entities(L("&#x41;&#66;&#x1F600;!"))) == "AB\U0001f600!"
    assert value(text.decode_entities(L("&#x; &#; &#x41"))) == "&#x; &#; &#x41"
    assert value(text.decode_entities(L("a&nbsp;b"), nbsp=True)) == "a b"
    assert value(text.decode_entities(L("&#99999999;"))) is None


def test_books_pages(value):
    assert value(text.strip_html(L('<img alt="cat">'))) == "[Image: cat]"
    assert value(text.strip_html(L('<img alt="cat">'), include_image_alt=False)) == ""
    assert value(text.strip_html(L('<p aria-hidden="true">no</p>yes'), respect_aria_hidden=True)) == "yes"
    svg = "<svg><text>a <tspan>b</tspan></text><foreignObject><p>c</p></foreignObject></svg>"
    assert value(text.strip_html(L(f"x{svg}y{svg}"))) == "x b a c y b a c"
    assert value(text.normalize_unicode(L("ﬁx—y…é"))) == "fix-y...é"


def test_docx(value):
    xml = "<w:p><w:r><w:t>Hello </w:t><w:t xml:space='preserve'>&amp; you</w:t></w:r></w:p><w:p></w:p><w:p><w:t>end</w:t></w:p>"
    assert value(text.docx_text(L(xml))).asDict() == {"text": "Hello & you\n\nend", "warnings": []}
    assert value(text.docx_text(L("<x/>")))["warnings"] == ["No paragraphs detected in Word document."]
    assert value(text.docx_text(L("<w:p> </w:p>")))["warnings"] == ["The Word document contains no readable text runs."]


def test_quality(value):
    assert value(quality.readability(L("ab�\t"))) == 0.75
    assert value(quality.readability(L(""))) == 0
    assert value(quality.english_density(L("the and cat"))) == 1.0
    assert value(quality.mojibake_count(L("Ã¤ Â» â\u0080\u0099 �"))) == 4
    assert value(text.js_length(L("a\U0001f600"))) == 3


def test_bytes(value):
    binary = lambda h: F.unhex(L(h))
    assert [value(encoding.is_valid_utf8(binary(h))) for h in ("C328", "EDA080", "C3A9")] == [False, False, True]
    assert value(encoding.decode_windows_1252(binary("938194E9"))) == "“”é"
    assert value(encoding.decode_base64(L("data:text/plain;base64,YWJj\nZA=="))) == b"abcd"
    assert value(encoding.decode_base64(L("%%%"))) is None
    assert value(encoding.without_mark(binary("EFBBBF41"), "utf-8")) == b"A"
    assert value(encoding.unsigned(binary("00010203"), 1, 2)) == 0x0102 and value(encoding.unsigned(binary("00"), 0, 2)) is None
    assert encoding.palmdoc_bytes(bytes.fromhex("616263801B")) == b"abcabcabc"
    assert encoding.palmdoc_bytes(b"\xc1") == b" A" and encoding.palmdoc_bytes(b"\x02\xff\xfe") == b"\xff\xfe"
    assert encoding.palmdoc_bytes(b"ab\x80\x11\x80") == b"ababab" and encoding.palmdoc_bytes(b"a\x80\x11") == b"a    "
    records = F.array(binary("616263801B"), binary(""), binary("6465"), binary("C1"))
    joined = lambda declared: value(encoding.book_text_bytes(records, F.lit(2), F.lit(declared)))
    assert joined(0) == b"abcabcabcde A" and joined(10) == b"abcabcabcd" and joined(9) == b"abcabcabc"
    assert value(encoding.book_text_bytes(F.array(binary("410000"), binary("0000")), F.lit(1), F.lit(0))) == b"A"
    assert value(encoding.book_text_bytes(F.array(binary("")), F.lit(1), F.lit(0))) is None
    assert encoding.utf16_lenient("a\U0001f600".encode("utf-16-be"), "big") == "a\U0001f600"
    assert encoding.utf16_lenient(b"\x00\xdc\x41\x00\x00", "little") == "�A"
    assert encoding.utf8_lenient(b"\xc3\xa9\xff\x41") == "éA"
    assert value(encoding.repaired_text(L("Ã©"))) == "é" and value(encoding.repaired_text(L("abc"))) is None


@pytest.mark.parametrize("word, point", [("a", 0), ("the", 1), ("it's", 1), ("reading", 2), ("extraordinary", 4), ("123", 0)])
def test_point_of_a_word(value, word, point):
    assert value(reading.recognition_point(F.array(L(word)))) == point


def test_reading(value):
    ws = lambda s: F.array(*map(L, s.split()))
    assert value(reading.recognition_point(ws("one two three"))) == 1 and value(reading.recognition_point(ws("speed reading"))) == 2
    assert value(reading.chunks(ws("a b c d e"), 2)) == [["a", "b"], ["c", "d"], ["e"]]
    assert value(reading.chunks(F.array().cast("array<string>"), 2)) == []
    assert [value(reading.duration_ms(L(n), L(300))) for n in (1, 3)] == [200, 600]
    assert value(reading.longest_word(ws("aa bb c"))) == "aa"
    assert value(reading.playback_index(L(10), L(1000), L(300), 1, L(100))["chunk_index"]) == 15
    assert [value(reading.letter_spacing(L(s), L(32))) for s in (0, 50)] == [0.5, 3.0]
    assert [value(reading.library_progress(L(i), L(n))) for i, n in ((50, 200), (5, 0), (300, 200))] == [25, 0, 100]
    assert [value(reading.eta_label(L(n), L(0))) for n in (300, 18_000, 19_000, 0)] == ["1 min", "1h", "1h 4m", "N/A"] and value(reading.eta_label(L(9), L(9))) == "<1 min"
    assert [value(reading.word_label(L(n))) for n in (999, 1150, 1250, 1_000_000)] == ["999", "1.1K", "1.3K", "1.0M"]
    assert [value(reading.gesture(L(x), L(y))) for x, y in ((1, 1), (40, 0), (-40, 3), (0, 50), (0, -50), (20, 0))] == ["tap", "jump-5", "jump+5", "wpm-50", "wpm+50", "none"]
    assert value(reading.adjusted("wpm", L(1190), 1)) == 1200 and value(reading.turned(L(10), -1)) == 355
    assert value(reading.plural(L(1), "book")) == "1 book" and value(reading.plural(L(2), "book")) == "2 books"
    parts = reading.orp_parts(ws("reading"), L(2))
    assert [value(parts[k]) for k in ("pre", "focus", "post", "left_context", "right_context")] == ["re", "a", "ding", "re", "ing"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=40), min_size=1, max_size=30))
def test_chunks_cover_the_words(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("t", text.word_count(F.col("t")).alias("n"), reading.chunks(reading.reading_words(F.col("t")), 3).alias("c"), text.clean_text(F.col("t")).alias("once"), text.clean_text(text.clean_text(F.col("t"))).alias("twice")).collect()
    for r in got:
        assert sum(map(len, r["c"])) == r["n"] == len(text_words(r["t"]))
        assert all(len(c) == 3 for c in r["c"][:-1])


def text_words(t: str) -> list[str]:
    blank = "\t\n\x0b\x0c\r \xa0     　﻿" + "".join(map(chr, range(0x2000, 0x200B)))
    return [w for w in "".join(" " if c in blank else c for c in t).split(" ") if w]


def test_once(value):
    assert value(once(L(2), lambda x: x * x + x)) == 6


def test_word_labels_round_the_binary_value(spark):
    """Against decimals of the quotient's exact binary value, at every tie and beside it."""
    counts = [c for n in range(10, 10_000, 7) for c in (n * 100 + 49, n * 100 + 50, n * 100 + 51)] + [n * 100_000 + 50_000 for n in range(10, 30_000, 11)]
    want = {c: f"{Decimal(c / u).quantize(Decimal('0.1'), ROUND_HALF_UP)}{s}" for c in counts for u, s in [(1_000_000, "M") if c >= 1_000_000 else (1_000, "K")]}
    rows = spark.createDataFrame([(c,) for c in counts], "c long").select("c", reading.word_label(F.col("c")).alias("label"))
    assert {r["c"]: r["label"] for r in rows.collect()} == want


def test_sanitized_decodings(spark):
    """The function of one text for Arrow batches follows the expression's rule, whatever line ends and white space there are."""
    import random

    rng = random.Random(3)
    signs = [*"ab  \t\n\n\n\r\x0b\x0c\x00\x1f\x85", "\u2028", "\u3000", "\xa0", "\ufeff", "\ufffd", "\u200b", "\U0001f600"]
    plain = [c for c in signs if c not in "\r\x85\u2028"]
    texts = ["".join(rng.choice(signs if i % 2 else plain) for _ in range(rng.randrange(25))) for i in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.sanitize_control(F.col("t")).alias("want")).collect()
    assert [text.sanitized_control(r["t"]) for r in rows] == [r["want"] for r in rows]
