"""Byte-pair encoding of words by a contiguous rank array, and decoding.

A word's symbols and the ranks of its adjacent pairs stand in two arrays. The smallest rank is found by a scan, the
boundary behind it is deleted, and the ranks beside it are refreshed, until no pair can merge. Words of like length are the
rows of such arrays, one merge of each at a time. Scans beat heaps on
short words; words over ``SHORT`` symbols, where a scan for each merge would be quadratic, use a heap of pairs.

The vocabulary file (text normaliser, pattern, merges, special tokens) is a parameter; nothing of it is kept here.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase, Sequence
from tokenizers.pre_tokenizers import Split

from lectern.llm.common import map_arrow, release_memory, sliced
from lectern.llm.pieces import PieceTable, ranges

SHORT, NEVER = 96, np.iinfo(np.int32).max
#: Words up to these numbers of symbols are merged together, so many symbols at a time.
LENGTHS, CELLS = (4, 8, 16, 32, SHORT), 64_000
#: Texts that a task has in work at once, and after how many such slices it gives memory back: an executor's workers share its memory with a JVM whose heap is full by then.
SLICE_ROWS, SLICE_BYTES, SLICES = 500, 500_000, 8


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else one from U+0100 up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file with word ends, lower-casing and dropped white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((self.vocab[left], self.vocab[right]), (rank, self.vocab[left + right]))
        self.bytes = byte_characters()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.normalizer = Sequence([NFC(), Lowercase()])
        #: The pattern with a match for each line break, which no word has.
        self.lines = regex.compile(f"(?:{pattern})|\n")
        self.known, self.stand_ins = set(), {}
        self.base = max(self.tokens) + 1
        keys = np.array([a * self.base + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        found = np.array([*self.merges.values()], np.int32).reshape(-1, 2)
        #: Pairs as numbers in ascending order, with one behind them that no pair has, and their ranks.
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(found[order, 0], NEVER)
        # Duplicates in the file keep the first rank, so ranks go beyond the number of merges.
        self.product_of = np.zeros(int(found[:, 0].max(initial=0)) + 1, np.int64)
        self.product_of[found[:, 0]] = found[:, 1]
        #: [whether it is a word's last, byte]: the symbol, -1 if the vocabulary has none.
        self.symbols = np.array([[self.vocab.get(c + end, -1) for c in self.bytes] for end in ("", self.suffix)], np.int64)
        self.names = pa.array([self.tokens.get(i) for i in range(self.base)], pa.string())
        self.table = PieceTable(self.encode_pieces, limit=200_000)

    def _rank(self, left: int, right: int) -> int:
        return self.merges.get((left, right), (NEVER,))[0]

    def merge(self, parts: list[int]) -> list[int]:
        if len(parts) > SHORT:
            return self._merge_long(parts)
        ranks = [self._rank(a, b) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            parts[i] = self.merges[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = self._rank(parts[i - 1], parts[i])
            if i < len(ranks):
                ranks[i] = self._rank(parts[i], parts[i + 1])
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        pairs = [(self._rank(a, b), i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        heap = [p for p in pairs if p[0] != NEVER]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:  # one of the two has been merged since
                continue
            parts[i], parts[j] = self.merges[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (rank := self._rank(parts[x], parts[y])) != NEVER:
                    heapq.heappush(heap, (rank, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair stands among the merges, in order of rank; ``NEVER`` for pairs that do not merge and for places without a symbol."""
        keys = left * self.base + right
        at = np.searchsorted(self.keys, keys)
        return np.where((self.keys[at] == keys) & (right >= 0), self.ranks[at], NEVER)

    def _merge_rows(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Merge words of like length, each a row, one merge of each at a time; they are written back to ``flat``. Returns their new sizes."""
        width, own, left, out = int(sizes.max()), np.arange(len(sizes)), sizes.copy(), sizes.copy()
        parts = np.where(np.arange(width) < sizes[:, None], flat[np.minimum(starts[:, None] + np.arange(width), len(flat) - 1)], -1)
        ranks = self._pairs(parts[:, :-1], parts[:, 1:])
        while len(own):
            place = ranks.argmin(1) if width > 1 else np.zeros(len(own), np.int64)
            least = ranks[np.arange(len(own)), place] if width > 1 else np.full(len(own), NEVER)
            done = least == NEVER
            if done.any():
                held = np.arange(width) < left[done, None]
                flat[(starts[own[done], None] + np.arange(width))[held]] = parts[done][held]
                out[own[done]] = left[done]
                own, left, parts, ranks, place, least = (x[~done] for x in (own, left, parts, ranks, place, least))
            row = np.arange(len(own))
            parts[row, place] = self.product_of[least]
            kept = np.arange(width) != place[:, None] + 1
            parts, ranks = parts[kept].reshape(len(own), -1) if len(own) else parts, ranks[kept[:, 1:]].reshape(len(own), -1) if len(own) else ranks
            width, left = width - 1, left - 1
            for at in (place - 1, place):
                live = (at >= 0) & (at < width - 1)
                i, j = row[live], at[live]
                ranks[i, j] = self._pairs(parts[i, j], parts[i, j + 1])
        return out

    def merge_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each one's)."""
        sizes = pc.binary_length(words).to_numpy().astype(np.int64)
        raw = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), np.uint8)
        last = np.zeros(len(raw), np.int64)
        last[np.cumsum(sizes)[sizes > 0] - 1] = 1
        flat = self.symbols[last, raw]
        if (flat < 0).any():
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[flat >= 0], minlength=len(sizes))
            flat = flat[flat >= 0]
        starts, counts, least = np.cumsum(sizes) - sizes, sizes.copy(), 1
        for most in LENGTHS:
            own = np.flatnonzero((sizes > least) & (sizes <= most))
            for first in range(0, len(own), rows := CELLS // most):
                at = own[first : first + rows]
                counts[at] = self._merge_rows(flat, starts[at], sizes[at])
            least = most
        for i in np.flatnonzero(sizes > SHORT).tolist():
            ids = self._merge_long(flat[starts[i] : starts[i] + sizes[i]].tolist())
            flat[starts[i] : starts[i] + len(ids)], counts[i] = ids, len(ids)
        return flat[ranges(starts, counts)].astype(np.int32), counts

    def _classed(self, text: str) -> str:
        """``text`` with characters that this interpreter and the library class differently replaced by one of the library's class.

        Their versions of Unicode differ. Each character is asked about once.
        """
        if new := set(text) - self.known:
            self.known |= new
            line = "".join(sorted(new))
            for kind, mark in ((r"[^\p{L}\p{N}\s]", "!"), (r"\p{L}", "a"), (r"\p{N}", "0"), (r"\s", " ")):
                found = Split(Regex(kind + "+"), "removed", invert=True).pre_tokenize_str(line)
                theirs = set("".join(piece for piece, _ in found))
                self.stand_ins |= {ord(c): mark for c in theirs - set(regex.findall(kind, line))}
        return text.translate(self.stand_ins) if self.stand_ins else text

    def _split(self, text: str, pattern: regex.Pattern) -> list[str]:
        text = text.lower() if text.isascii() else self.normalizer.normalize_str(text)
        if text.isascii() or (classed := self._classed(text)) == text:
            return pattern.findall(text)
        return [text[m.start() : m.end()] for m in pattern.finditer(classed)]

    def encode_piece(self, piece: str) -> list[int]:
        ids = []
        for part in self.specials.split(piece) if self.specials else [piece]:
            if part in self.special:
                ids.append(self.special[part])
            elif words := self._split(part, self.pattern):
                ids += self.merge_words(pa.array(words, pa.string()))[0].tolist()
        return ids

    def encode_pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of each one's). No piece has a line break, so one stands between pieces, and they are split into words at once."""
        joined, apart = "\n".join(texts := pieces.to_pylist()), {}
        if self.specials and self.specials.search(joined):
            apart = {i: self.encode_piece(p) for i, p in enumerate(texts) if self.specials.search(p)}
            joined = "\n".join("" if i in apart else p for i, p in enumerate(texts))
        coded = pa.array(self._split(joined, self.lines), pa.string()).dictionary_encode()
        rows, flat, sizes = np.asarray(coded.indices), *self.merge_words(coded.dictionary)
        breaks = rows == coded.dictionary.index("\n").as_py()
        owner, rows = np.cumsum(breaks)[~breaks], rows[~breaks]
        ids = flat[ranges((np.cumsum(sizes) - sizes)[rows], sizes[rows])]
        counts = np.bincount(owner, sizes[rows], len(pieces)).astype(np.int64)
        if apart:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, own in apart.items():
                parts[i], counts[i] = np.array(own, np.int32), len(own)
            ids = np.concatenate(parts)
        return ids, counts

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's ids). White space never reaches a token, so texts are cut at it first."""
        return self.table.lookup(pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " "))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, word ends and special tokens kept, as the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.StringArray:
        """``decode`` of many texts, whose ids lie one behind the other."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.names.take(pa.array(ids))), " ")


def coded(bpe: WordBpe, batches: Iterator[pa.RecordBatch], decode: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids, decoded) of batches (doc_id, text), slice by slice; without ``decode`` (doc_id, ids)."""
    for n, batch in enumerate(sliced(batches, rows=SLICE_ROWS, size=SLICE_BYTES), 1):
        ids, counts = bpe.encode(batch.column(1))
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = {"doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))}
        if decode:
            out["decoded"] = bpe.decode_all(ids, ends)
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
        if n % SLICES == 0:
            release_memory()


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``docs``; without ``decode`` (doc_id, ids).

    ``tokenizer_path`` must exist on every executor. Null and empty texts have no ids and an empty decoded text;
    very long texts and words are encoded whole; repeated rows and null ids are kept; an empty table gives an empty
    result; other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from coded(loaded(tokenizer_path), batches, decode)
        release_memory()
        release_memory()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return map_arrow(rows, encode, schema.add("decoded", T.StringType()) if decode else schema)
