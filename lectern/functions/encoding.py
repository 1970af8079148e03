"""Bytes to text: numbers in headers, base64, byte-order marks, lenient decoders, PalmDoc decompression."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.columns import arrow_udf
from lectern.functions.text import sanitized_control

#: What Windows-1252 has at 0x80 to 0x9F; the five bytes it leaves out are dropped.
WINDOWS_1252 = {0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ"}
CODE_PAGES = {65001: "utf-8", 1252: "windows-1252", 1200: "utf-16le", 1201: "utf-16be"}
SIGNATURE_CHARACTERS = 4096
MARKS = {"utf-8": "EFBBBF", "utf-16le": "FFFE", "utf-16be": "FEFF"}


def unsigned(data: Column, offset: Column | int, size: int) -> Column:
    """A big-endian number of ``size`` bytes at an offset; null beyond the end."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    part = F.substring(data, offset.try_cast("int") + 1, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def decode_base64(text: Column) -> Column:
    """Bytes of base64 text, with or without a data: prefix; null if it is not valid."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^data:[^,]*,", ""), r"[ \t\n\x0B\f\r]+", "")
    return F.try_to_binary(bare, F.lit("base64"))


def without_mark(data: Column, encoding: str) -> Column:
    mark = MARKS.get(encoding)
    return data if mark is None else F.when(F.startswith(F.hex(data), F.lit(mark)), F.substring(data, F.lit(len(mark) // 2 + 1), F.octet_length(data))).otherwise(data)


def decode_windows_1252(data: Column) -> Column:
    """Windows-1252 by way of Latin-1: moved characters are translated, bytes without one dropped."""
    kept = "".join(map(chr, sorted(WINDOWS_1252)))
    gone = "".join(chr(c) for c in range(0x80, 0xA0) if c not in WINDOWS_1252)
    return F.translate(F.decode(data, "ISO-8859-1"), kept + gone, "".join(WINDOWS_1252[ord(c)] for c in kept))


def is_valid_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def windows_1252_leads(data: Column) -> Column:
    """Bytes that mean a character in Windows-1252 and nothing in Latin-1."""
    return F.regexp_count(F.decode(data, "ISO-8859-1"), F.lit(r"[\x{0080}\x{0082}-\x{008C}\x{008E}\x{0091}-\x{009C}\x{009E}\x{009F}]"))


def encoding_of_code(code: Column) -> Column:
    found = F.lit(None).cast("string")
    for number, name in CODE_PAGES.items():
        found = F.when(code == number, name).otherwise(found)
    return found


#: A lead byte with as many bytes as it asks for, whatever they are; or a byte that leads nothing.
_SEQUENCE = re.compile("[\xc0-\xdf].|[\xe0-\xef]..|[\xf0-\xf7]...|[\x80-\xff]", re.DOTALL)
_LEAD_BITS = {1: 0, 2: 0x1F, 3: 0x0F, 4: 0x07}


def _point(found: re.Match) -> str:
    units = found[0]
    if len(units) == 1:
        return ""
    point = ord(units[0]) & _LEAD_BITS[len(units)]
    for unit in units[1:]:
        point = point << 6 | ord(unit) & 0x3F
    return chr(point) if point <= 0x10FFFF and not 0xD800 <= point <= 0xDFFF else "\ufffd"


def utf8_lenient(data: bytes) -> str:
    """UTF-8 without any checks of continuation bytes: bad leads are skipped, overlong forms accepted. Runs of ASCII are copied as they are."""
    return _SEQUENCE.sub(_point, data.decode("latin-1"))


def utf16_lenient(data: bytes, order: str) -> str:
    """UTF-16 of whole units, zeros dropped; a half pair becomes U+FFFD."""
    units = np.frombuffer(data[: len(data) // 2 * 2], "<u2" if order == "little" else ">u2")
    return units[units != 0].astype("<u2").tobytes().decode("utf-16-le", "replace")


_MOVED = {c: WINDOWS_1252.get(c, "") for c in range(0x80, 0xA0)}


def decoded_text(data: bytes, name: str) -> str:
    if name == "windows-1252":
        return data.decode("latin-1").translate(_MOVED)
    if name in ("utf-16le", "utf-16be"):
        return utf16_lenient(data, "little" if name == "utf-16le" else "big")
    return data.decode("utf-8", "replace")


def text_repaired(text: str | None) -> str | None:
    if not text or text.isascii() or max(text) > "\xff":
        return None
    again = utf8_lenient(text.encode("latin-1"))
    return again if again and again != text else None


def _decoded(data: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else decoded_text(b, n) for b, n in zip(data, encoding, strict=True)])


def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(text_repaired)


#: Bytes that stand for themselves, as many as follow each other.
_PLAIN = re.compile(rb"[\x00\x09-\x7f]+")


def palmdoc_bytes(data: bytes) -> bytes:
    """Undo PalmDoc compression: literals, runs of literals, back references, and a blank with a character.

    Plain bytes and back references are copied as whole slices; a reference that reaches into its own output repeats it.
    One that points before the start gives blanks, one cut off at the end gives nothing.
    """
    out, at = bytearray(), 0
    while at < len(data):
        code = data[at]
        if 1 <= code <= 8:
            out += data[at + 1 : at + 1 + code]
            at += 1 + code
        elif code < 0x80:
            run = _PLAIN.match(data, at)
            out += run[0]
            at = run.end()
        elif code >= 0xC0:
            out += bytes((0x20, code ^ 0x80))
            at += 1
        else:
            pair = data[at : at + 2]
            at += 2
            if len(pair) == 2:
                number = int.from_bytes(pair)
                back, size = number >> 3 & 0x7FF, (number & 7) + 3
                start = len(out) - back
                window = out[start : start + size] if 0 < back <= len(out) else b" "
                out += (window * size)[:size]
    return bytes(out)


def book_bytes(records, compression: int, declared: int) -> bytes | None:
    """Text records decompressed and joined until the declared length is reached, cut there, without zeros at the end.

    Records behind the one that reaches it are not decompressed. A length of 0 declares none; without records the result is null.
    """
    parts, size = [], 0
    for record in records:
        if record:
            parts.append(palmdoc_bytes(record) if compression == 2 else record)
            size += len(parts[-1])
            if 0 < declared <= size:
                break
    if not parts:
        return None
    joined = b"".join(parts)
    return (joined[:declared] if declared > 0 else joined).rstrip(b"\0")


def _book_bytes(records: pd.Series, compression: pd.Series, declared: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else book_bytes(r, c, n) for r, c, n in zip(records, compression, declared, strict=True)], dtype=object)


def decode_bytes(data: Column, encoding: Column) -> Column:
    """Text of bytes in one of the four encodings; what is malformed is replaced or dropped, never an error."""
    return arrow_udf(_decoded, "string", data, encoding)


def repaired_text(text: Column) -> Column:
    """Text that was UTF-8 read as Latin-1, read again; null if it has higher characters or does not change."""
    return arrow_udf(_repaired, "string", text)


def _lenient(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else utf8_lenient(b))


def text_of_bytes(data: Column) -> Column:
    """The text of bytes that claim to be UTF-8; those that are not go the lenient decoder's way."""
    plain = data.cast("string")
    broken = F.when(~F.is_valid_utf8(plain), data)
    return F.when(F.is_valid_utf8(plain), plain).otherwise(arrow_udf(_lenient, "string", broken))


def _candidates(data: pd.Series, encodings: pd.Series) -> pd.Series:
    def one(b, names):
        out, seen = [], set()
        for i, name in enumerate(names if b is not None and names is not None else ()):
            mark = bytes.fromhex(MARKS.get(name, ""))
            raw = decoded_text(b[len(mark) :] if mark and b.startswith(mark) else b, name)
            for k, (kind, text) in enumerate((("direct", raw), ("utf8-repair", text_repaired(raw)))):
                if text and (sign := (name, kind, text[:SIGNATURE_CHARACTERS])) not in seen:
                    seen.add(sign)
                    out.append({"prio": 2 * i + k, "encoding": name, "transform": kind, "text": sanitized_control(text)})
        return out

    return pd.Series([one(b, n) for b, n in zip(data, encodings, strict=True)])


def decoding_array(data: Column, encodings: Column) -> Column:
    """Every decoding of bytes that gives a text, as an array of structs (prio, encoding, transform, text) in the order tried, no candidate twice; texts are sanitized."""
    return arrow_udf(_candidates, "array<struct<prio: int, encoding: string, transform: string, text: string>>", data, encodings)


def book_text_bytes(records: Column, compression: Column, declared: Column) -> Column:
    """The text of a book's records (an array of binaries) as bytes, see :func:`book_bytes`."""
    return arrow_udf(_book_bytes, "binary", records, F.coalesce(compression, F.lit(1)), F.coalesce(declared, F.lit(0)))
