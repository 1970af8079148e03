"""SQL text of the text rules, for the oracles: each function mirrors a column expression over DuckDB's functions."""

from __future__ import annotations

from lectern.functions.files import EXTENSIONS, MIME_TYPES
from lectern.functions.quality import COMMON_WORDS, MOJIBAKE
from lectern.functions.text import BULLET, PLAIN_FORMS, WS

ASCII_WS = r"[ \t\n\x0B\f\r]"


def sub(x: str, pattern: str, replacement: str) -> str:
    """All matches replaced; line breaks in either are spelled with chr()."""
    quoted = pattern.replace("'", "''")
    to = "'" + replacement.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"regexp_replace({x}, '{quoted}', {to}, 'g')"


def trim(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "")


def collapse(x: str) -> str:
    return sub(x, f"{WS}+", " ")


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def reading_words(x: str) -> str:
    return words(f"translate(coalesce({x}, ''), '‘’“”', '''''\"\"')")


def unix_lines(x: str) -> str:
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def clean(x: str) -> str:
    return trim(f"replace({sub(sub(unix_lines(x), r'\n{3,}', chr(10) * 2), r'[ \t]+', ' ')}, chr(173), '')")


def entities(x: str, nbsp: bool = False) -> str:
    for a, b in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), *([("&nbsp;", " ")] if nbsp else [])]:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def broken_lines(x: str, blocks: str) -> str:
    x = sub(x, rf"(?i)<{ASCII_WS}*br{ASCII_WS}*/?{ASCII_WS}*>", "\n")
    x = sub(x, rf"(?i)</?({blocks})[^>]*>", "\n\n")
    x = sub(x, rf"(?i)<{ASCII_WS}*li[^>]*>", f"\n{BULLET} ")
    x = sub(x, rf"(?i)</(li|ul|ol){ASCII_WS}*>", "\n")
    return sub(x, "(?i)<hr[^>]*>", "\n---\n")


def without(x: str, *tags: str) -> str:
    for tag in tags:
        x = sub(x, rf"(?i)<{tag}[\s\S]*?</{tag}>", "")
    return x


def markup_to_plain(x: str) -> str:
    x = broken_lines(without(x, "style", "script"), "p|div|section|article|h[1-6]")
    return clean(entities(collapse(sub(x, "<[^>]+>", " "))))


def strip_html(x: str) -> str:
    x = broken_lines(without(x, "style", "script", "noscript", "head"), "p|div|section|article|h[1-6]|blockquote|pre|dd|dt|td|th|caption|figcaption")
    x = sub(sub(x, r"""(?i)<img[^>]*alt=["'](["'])[^>]*>""", ""), r"""(?i)<img[^>]*alt=["']([^"']*)["'][^>]*>""", r"[Image: \1]")
    return trim(entities(collapse(sub(sub(x, "(?i)<img[^>]*>", ""), "<[^>]+>", " ")), nbsp=True))


def normalize_unicode(x: str) -> str:
    x = f"replace({unix_lines(x)}, chr(173), '')"
    for a, b in PLAIN_FORMS:
        x = f"replace({x}, '{a}', '{b}')"
    return trim(sub(sub(f"nfc_normalize({x})", r"[ \t]+", " "), r"\n{4,}", "\n\n"))


def sanitize(x: str) -> str:
    x = f"replace({sub(x, r'[\x00-\x08\x0B\x0C\x0E-\x1F]+', ' ')}, chr(65533), '')"
    x = sub(sub(x, r"[ \t]+", " "), r"[ \t]+\n", "\n")
    return sub(sub(x, r"\n{4,}", "\n\n"), f"(?m)^{WS}+|{WS}+$", "")


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def share(part: str, whole: str) -> str:
    return f"coalesce(({part}) :: DOUBLE / nullif(({whole}) :: DOUBLE, 0), 0)"


def quality(x: str, whole: bool = False) -> dict[str, str]:
    """Texts beyond the sampled 24,000 characters are cut, as in the expression, unless the ``whole`` text counts."""
    s = x if whole else f"left({x}, 24000)"
    first = words(f"lower({s})") if whole else f"list_slice({words(f'lower({s})')}, 1, 500)"
    common = ", ".join(f"'{w}'" for w in COMMON_WORDS)
    out = {
        "readability": share(f"length({s}) - {count(s, r'[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}]')}", f"length({s})"), "ascii_letter_ratio": share(count(s, "[A-Za-z]"), f"length({s}) - {count(s, r'[\x00-\x1F\x7F]')}"), "space_ratio": share(count(s, " "), f"length({s})"),
        "english_density": f"least(1.0 :: DOUBLE, {share(f'len(list_filter({first}, lambda w: w IN ({common}))) * 3', f'len({first})')})", "mojibake_count": " + ".join(count(s, p) for p in MOJIBAKE),
    }
    return out


def point(w: str, n: str) -> str:
    """Recognition point of a chunk ``w`` (a list) of ``n`` words."""
    letters = f"length(regexp_replace({w}[CASE WHEN {n} = 1 THEN 1 ELSE {n} // 2 + 1 END], '[^a-zA-Z]', '', 'g'))"
    return f"(CASE WHEN {letters} <= 2 THEN 0 WHEN {letters} <= 4 THEN 1 ELSE greatest(1, least({letters} // 3, {letters} - 1)) END) :: INTEGER"


def title(x: str) -> str:
    return f"coalesce(nullif({trim(sub(x, r'(?i)\.(txt|pdf|docx?|epub|mobi|rtf|html?)$', ''))}, ''), 'Untitled Document')"


def cases(x: str, table: dict[str, str], otherwise: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {otherwise} END"


def document_format(name: str, mime: str) -> str:
    mime = f"lower(coalesce({mime}, ''))"
    guess = f"CASE WHEN {mime} LIKE '%word%' OR {mime} LIKE '%officedocument%' THEN 'DOCX' WHEN {mime} LIKE '%pdf%' THEN 'PDF' ELSE 'TXT' END"
    return cases(f"lower(string_split({name}, '.')[-1])", EXTENSIONS, cases(mime, MIME_TYPES, guess))


def fixed_1(x: str) -> str:
    """One decimal, halves of the exact binary value up; printf alone rounds exact halves to even."""
    return f"printf('%.1f', CASE WHEN {x} * 20 = floor({x} * 20) AND {x} * 10 <> floor({x} * 10) AND (floor({x} * 4) = {x} * 4) THEN {x} + 0.01 ELSE {x} END)"


#: Documents as a library, see ``lectern.plans.tables``.
LIB = f"""
ev AS (SELECT user_id AS doc_id, event_id, ts, event_type, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS chunk_index FROM events),
lp AS (SELECT doc_id, (max(struct_pack(ts := ts, e := event_id, c := chunk_index))).c AS chunk_index, max(ts) AS updated_ts FROM ev GROUP BY doc_id),
nm AS (SELECT doc_id, text, source || '_' || doc_id || CASE WHEN doc_id % 10 = 9 THEN '' ELSE '.' || list_extract(['txt', 'pdf', 'docx', 'doc', 'epub', 'mobi', 'rtf', 'html', 'htm'], (doc_id % 10 + 1) :: INT) END AS file_name,
  CASE WHEN doc_id % 2 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'text/html' ELSE 'application/msword' END AS mime_type FROM documents),
lib AS (SELECT nm.doc_id, nm.file_name, nm.mime_type, {title("nm.file_name")} AS title, nm.text, len({words("nm.text")}) :: BIGINT AS word_count, length({trim("nm.text")}) >= 24 AS is_readable,
  TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * nm.doc_id AS created_ts, coalesce(lp.updated_ts, TIMESTAMP '2024-01-01') AS updated_ts, coalesce(lp.chunk_index, 0) AS chunk_index
  FROM nm LEFT JOIN lp ON nm.doc_id = lp.doc_id)
"""
