"""Text normalisation as column expressions: cleaning, markup to text, entities, ligatures, page and word-processor text.

White space is ECMAScript's: Java's ``\\s`` is ASCII only, so every rule spells the class out. The same patterns run in RE2.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lectern.functions.columns import nfc_udf

#: ECMAScript white space, and a character that is none.
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_WS = "[^" + WS[1:]
BULLET = "•"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row, however often ``use`` or its lambdas name it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def collapse_white_space(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+", " ")


def js_length(text: Column) -> Column:
    """Length in UTF-16 units, as ECMAScript counts."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def words(text: Column) -> Column:
    """The words between white space, without empty ones."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")


def clean_text(text: Column) -> Column:
    """Line ends, three and more breaks to two, runs of blanks and tabs to one blank, no soft hyphens, trimmed."""
    text = F.regexp_replace(unix_lines(text), "\n{3,}", "\n\n")
    return js_trim(F.replace(F.regexp_replace(text, "[ \t]+", " "), F.lit("­"), F.lit("")))


def _character(digits: Column, base: int) -> Column:
    """The character of a code point in digits; null beyond U+10FFFF, U+FFFD for half of a surrogate pair."""
    trimmed = F.regexp_replace(digits, "^0+(?=.)", "")
    number = F.when(F.length(trimmed) <= 8, F.conv(trimmed, base, 10).cast("long"))
    number = F.when(number <= 0x10FFFF, F.when(number.between(0xD800, 0xDFFF), 0xFFFD).otherwise(number))
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _numeric_references(text: Column, start: str, digits: str, base: int) -> Column:
    """Replace references that begin with ``start``, each once and from left to right."""
    pattern = f"^({digits}+);"

    def rewritten(t: Column) -> Column:
        pieces = F.transform(F.split(t, start), lambda p, i: F.when(i == 0, p).when(p.rlike(pattern), F.concat(_character(F.regexp_extract(p, pattern, 1), base), F.regexp_replace(p, pattern, ""))).otherwise(F.concat(F.lit(start), p)))
        return F.when(~t.contains(start), t).otherwise(once(pieces, lambda ps: F.when(F.forall(ps, lambda p: p.isNotNull()), F.concat_ws("", ps))))

    return once(text, rewritten)


def decode_entities(text: Column, nbsp: bool = False) -> Column:
    """Five named references (``nbsp``: six), then hexadecimal, then decimal ones, in this order, so ``&amp;lt;`` ends as ``<``.

    A reference beyond U+10FFFF makes the text null, for the caller to report.
    """
    named = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), *([("&nbsp;", " ")] if nbsp else [])]
    for reference, character in named:
        text = F.replace(text, F.lit(reference), F.lit(character))
    return _numeric_references(_numeric_references(text, "&#x", "[0-9a-fA-F]", 16), "&#", "[0-9]", 10)


def _without(text: Column, *tags: str) -> Column:
    for tag in tags:
        text = F.regexp_replace(text, rf"(?i)<{tag}[\s\S]*?</{tag}>", "")
    return text


def _broken_lines(text: Column, blocks: str) -> Column:
    """Breaks, blocks, list items, list ends and rules turned into line breaks and signs. Tag names match as prefixes."""
    for pattern, replacement in ((r"(?i)<[ \t\n\x0B\f\r]*br[ \t\n\x0B\f\r]*/?[ \t\n\x0B\f\r]*>", "\n"), (rf"(?i)</?({blocks})[^>]*>", "\n\n"), (r"(?i)<[ \t\n\x0B\f\r]*li[^>]*>", f"\n{BULLET} "), (r"(?i)</(li|ul|ol)[ \t\n\x0B\f\r]*>", "\n"), ("(?i)<hr[^>]*>", "\n---\n")):
        text = F.regexp_replace(text, pattern, replacement)
    return text


def markup_to_plain(text: Column, keep_paragraphs: bool = False) -> Column:
    """Text of simple markup. White space becomes single blanks, unless ``keep_paragraphs`` keeps the line breaks."""
    text = _broken_lines(_without(text, "style", "script"), "p|div|section|article|h[1-6]")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), " ?\n ?", "\n") if keep_paragraphs else collapse_white_space(text)
    return clean_text(decode_entities(text))


def _tagless(text: Column) -> Column:
    return js_trim(F.regexp_replace(text, "<[^>]+>", ""))


def svg_text(svg: Column) -> Column:
    """Texts of a drawing: of each text element its spans, then what is outside them; last, embedded markup."""
    span = r"(?i)<tspan[^>]*>[\s\S]*?</tspan>"
    of_text = lambda m: F.concat(F.transform(F.regexp_extract_all(m, F.lit(span), F.lit(0)), _tagless), F.array(_tagless(F.regexp_replace(m, span, ""))))
    texts = F.flatten(F.transform(F.regexp_extract_all(svg, F.lit(r"(?i)<text[^>]*>[\s\S]*?</text>"), F.lit(0)), of_text))
    embedded = F.transform(F.regexp_extract_all(svg, F.lit(r"(?i)<foreignObject[^>]*>[\s\S]*?</foreignObject>"), F.lit(0)), lambda m: strip_html(m, drawings=False))
    return F.array_join(F.filter(F.concat(texts, embedded), lambda t: t != ""), " ")


def _with_svg_text(text: Column) -> Column:
    def replaced(done: Column, svg: Column) -> Column:
        at, inner = F.position(svg, done), svg_text(svg)
        return F.concat(F.substring(done, F.lit(1), at - 1), F.when(inner != "", F.concat(F.lit(" "), inner, F.lit(" "))).otherwise(" "), F.substring(done, at + F.length(svg), F.length(done)))

    drawings = lambda t: F.regexp_extract_all(t, F.lit(r"(?i)<svg[\s\S]*?</svg>"), F.lit(0))
    return once(text, lambda t: F.when(t.rlike("(?i)<svg"), F.aggregate(drawings(t), t, replaced)).otherwise(t))


def strip_html(text: Column, include_image_alt: bool = True, respect_aria_hidden: bool = False, drawings: bool = True) -> Column:
    """Text of a book's page: without head, styles and scripts, with texts of drawings and alternative texts of images."""
    if respect_aria_hidden:
        text = F.regexp_replace(text, r"""(?i)<[^>]*aria-hidden=["']true["'][^>]*>[\s\S]*?</[^>]+>""", "")
    text = _without(text, "style", "script", "noscript", "head")
    if drawings:
        text = _with_svg_text(text)
    text = _broken_lines(text, "p|div|section|article|h[1-6]|blockquote|pre|dd|dt|td|th|caption|figcaption")
    if include_image_alt:
        text = F.regexp_replace(text, r"""(?i)<img[^>]*alt=["']["'][^>]*>""", "")
        text = F.regexp_replace(text, r"""(?i)<img[^>]*alt=["']([^"']*)["'][^>]*>""", "[Image: $1]")
    text = F.regexp_replace(F.regexp_replace(text, "(?i)<img[^>]*>", ""), "<[^>]+>", " ")
    return js_trim(decode_entities(collapse_white_space(text), nbsp=True))


#: Dashes, the ellipsis and ligatures with their plain forms.
PLAIN_FORMS = (("–", "-"), ("—", "-"), ("…", "..."), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))


def normalize_unicode(text: Column) -> Column:
    """Line ends, soft hyphens, dashes, ellipses and ligatures to plain forms, NFC, single blanks, at most three breaks become two."""
    text = F.replace(unix_lines(text), F.lit("­"), F.lit(""))
    for character, plain in PLAIN_FORMS:
        text = F.replace(text, F.lit(character), F.lit(plain))
    text = F.regexp_replace(nfc_udf(text), "[ \t]+", " ")
    return js_trim(F.regexp_replace(text, "\n{4,}", "\n\n"))


def sanitize_control(text: Column) -> Column:
    """Control characters to blanks, no U+FFFD, lines trimmed, no blank lines."""
    text = F.replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]+", " "), F.lit("�"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(text, "\n{4,}", "\n\n"), f"(?m)^{WS}+|{WS}+$", "")


#: The rules of ``sanitize_control`` for Python's expressions, whose ``^`` and ``$`` know one line end only.
_WHITE = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_CONTROLS, _BREAKS, _LINE_ENDS = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F]+"), re.compile("\n{4,}"), re.compile("[\r\x85\u2028\u2029]")
_OUTER = re.compile(rf"(?:\A|(?<=[\n\x85\u2028\u2029])|(?<=\r)(?!\n))[{_WHITE}]+|[{_WHITE}]+(?:\Z|(?=[\r\x85\u2028\u2029])|(?<!\r)(?=\n))")


def sanitized_control(text: str) -> str:
    """``sanitize_control`` of one text, for functions over Arrow batches that have many texts of a row at hand.

    Where line breaks are the only line ends, lines are trimmed one by one. White space with a break in it leaves that break, unless an
    empty line comes last in it; then it leaves nothing.
    """
    text = _CONTROLS.sub(" ", text).replace("\ufffd", "").replace("\t", " ")
    while "  " in text:
        text = text.replace("  ", " ")
    text = text.replace(" \n", "\n")
    if "\n\n\n\n" in text:
        text = _BREAKS.sub("\n\n", text)
    if _LINE_ENDS.search(text):
        return _OUTER.sub("", text)
    if "\n" not in text:
        return text.strip(_WHITE)
    out, apart = [], True
    for raw in text.split("\n"):
        if line := raw.strip(_WHITE):
            out.append(line if apart else "\n" + line)
            apart = False
        elif out:
            apart = not raw
    return "".join(out)


def page_text(items: Column) -> Column:
    """Text of a page from its items, in order."""
    return js_trim(collapse_white_space(F.array_join(F.transform(items, lambda x: F.coalesce(x, F.lit(""))), " ")))


def recognized_text(text: Column, enhance: bool = True) -> Column:
    """What is kept of a text-recognition result."""
    text = unix_lines(js_trim(text))
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), "[ \t]+", " ") if enhance else text


def docx_text(xml: Column) -> Column:
    """struct(text, warnings) of a word-processor document's XML: its runs, joined in paragraphs, blank ones dropped."""
    xml = F.regexp_replace(F.regexp_replace(xml, r"(?i)<w:tab\b[^>]*/>", "\t"), r"(?i)<w:br\b[^>]*/>", "\n")
    paragraphs = F.regexp_extract_all(xml, F.lit(r"(?i)<w:p[\s\S]*?</w:p>"), F.lit(0))
    runs = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(r"(?i)<w:t[^>]*>([\s\S]*?)</w:t>"), F.lit(1)), lambda t: decode_entities(t)), "")
    filled = F.filter(F.transform(paragraphs, runs), lambda p: js_trim(p) != "")
    warning = F.when(F.size(paragraphs) == 0, F.array(F.lit("No paragraphs detected in Word document."))).when(F.size(filled) == 0, F.array(F.lit("The Word document contains no readable text runs."))).otherwise(F.array().cast("array<string>"))
    return F.struct(clean_text(F.array_join(filled, "\n\n")).alias("text"), warning.alias("warnings"))


def title_of_file(name: Column) -> Column:
    """A file's name without a known extension, trimmed, or a default."""
    bare = js_trim(F.regexp_replace(name, r"(?i)\.(txt|pdf|docx?|epub|mobi|rtf|html?)$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("Untitled Document"))


def is_readable_text(text: Column, least: int = 24) -> Column:
    """Whether ``least`` characters are left when the text is trimmed."""
    return F.coalesce(F.length(js_trim(text)) >= least, F.lit(False))
