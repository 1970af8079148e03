"""Token ids in a content-addressed store.

A rolling hash over the last ``WINDOW`` ids cuts every document's id stream into chunks, so that equal passages give equal
chunks wherever they stand. A chunk is stored once, under the SHA-256 of its bytes. A document is a recipe: its
chunks' addresses in order, and the Merkle root over them. The store is a folder of Parquet tables:

* ``objects/kind=chunk``: key (address), data (ids, little-endian unsigned, 2 or 4 bytes each)
* ``index``: doc_id, start, n_tokens, root, recipe (addresses, 32 bytes each), in ascending doc_id order
* ``manifest``: a Merkle tree over the documents' roots in index order, as nodes (level, place, first, documents, tokens, root): a node of
  level 0 covers ``FAN`` documents, a node above ``FAN`` nodes; the last level has one node

Reading back recomputes every address from the stored bytes, every root from the recipe and every node of the manifest
from the index; what is missing or altered shows as documents that are not verified. Checksums of documents
are combined from those of their chunks (a CRC of a concatenation follows from the parts' CRCs and lengths), so a
verification moves a few bytes for each chunk; ``read_documents`` reassembles the ids themselves.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import map_arrow, salted_join, sliced, written
from lectern.llm.pieces import PieceTable, flattened, ranges
from lectern.llm.word_bpe import byte_characters
from lectern.shipping import ship

#: A chunk has 256 ids on average: a cut where the top 8 bits of the rolling hash are 0.
WINDOW, CUT_BITS, LEAST, MOST = 16, 8, 64, 2048
#: Children of a node of the manifest.
FAN = 4096
#: White space beside white space, at the end, or of another kind than space and line break: such texts are encoded as a whole.
JOINED_SPACE = "[ \n][ \n]|\n\\z|[" + "".join(f"\\x{{{ord(c):X}}}" for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]"
#: Signs that stand apart from a word before them; an apostrophe may not.
SIGNS, LATIN_END = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'"), "\u0250"
#: A word of letters below ``LATIN_END``, and the signs behind it.
PLAIN_WORD = r"\A(?P<word>[%s]+)(?P<signs>[%s]*)\z" % ("".join(c for c in map(chr, range(ord(LATIN_END))) if c.isalpha()), "".join(f"\\x{ord(c):02X}" for c in SIGNS))


class Encoder:
    """Ids of texts by the tokenizers library; pieces between single spaces are encoded once each.

    In a byte-level vocabulary a word takes its leading space along, so a text may be cut before any space that has no
    white space beside it, and before a line break that has none. Texts where some has are encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        special = [t for t in self.tokenizer.get_added_tokens_decoder().items() if not (t[1].lstrip or t[1].rstrip or t[1].single_word)]
        self.mark_id, self.mark = next(((i, t.content) for i, t in special), (None, None))
        self.characters = dict(enumerate(byte_characters()))
        self.blank, self.known_signs = self.characters[0x20], {}
        self.table = PieceTable(self.encode_pieces)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Plain words with signs behind them go to the library's model directly, all else through its whole chain; a word is encoded once, with signs and without."""
        table, cut = self.table, pc.extract_regex(pieces, PLAIN_WORD)
        plain = np.asarray(cut.is_valid().cast(pa.int8())).astype(bool)
        word, signs = (x.dictionary_encode() for x in cut.filter(pa.array(plain)).flatten())
        held = table.find(word.dictionary)
        old, rest = held >= 0, np.flatnonzero(~plain)
        sources = [(self._words(word.dictionary.filter(pa.array(~old)))), flattened([self._signs(x) for x in signs.dictionary.to_pylist()]), self._others(pieces.take(pa.array(rest)).to_pylist())]
        flats = [table.flat, *[flat for flat, _ in sources]]
        begin = np.cumsum([len(flat) for flat in flats])
        new, behind, whole = [(first + np.cumsum(sizes) - sizes, sizes) for first, (_, sizes) in zip(begin.tolist(), sources, strict=False)]
        # Of each piece where the ids of its word lie and where those of its signs do; other pieces are whole, without signs.
        at, n = np.zeros((2, len(pieces), 2), np.int64)
        for out, known, found, sign, other in ((at, table.starts, new[0], behind[0], whole[0]), (n, table.sizes, new[1], behind[1], whole[1])):
            of_words = np.zeros(len(held), np.int64)
            of_words[old], of_words[~old] = known[held[old]], found
            out[plain, 0], out[plain, 1], out[rest, 0] = of_words[np.asarray(word.indices)], sign[np.asarray(signs.indices)], other
        return np.concatenate(flats)[ranges(at.ravel(), n.ravel())], n.sum(1)

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words with the space before each, and their numbers."""
        tokenize, blank = self.tokenizer.model.tokenize, self.blank
        spelled = " ".join(["", *words.to_pylist()]).encode().decode("latin-1").translate(self.characters).split(blank)[1:]
        return flattened([[t.id for t in tokenize(blank + w)] for w in spelled])

    def _others(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin a text (marked by a space) or a line, or are more than a plain word with signs, and their numbers."""
        found: list[list[int] | None] = []
        other = []
        for i, p in enumerate(pieces):
            start, p = ("", p[1:]) if p[:1] == " " else ("\n", p[1:]) if p[:1] == "\n" else (" ", p)
            word = p.rstrip(SIGNS)
            if start != " " and word.isalpha() and (word.isascii() or max(word) < LATIN_END):
                ids = self._word(start, word)
                found.append(ids + self._signs(p[len(word) :]) if len(word) < len(p) else ids)
            else:
                found.append(None)
                other.append((i, start + p))
        for (i, _), ids in zip(other, self._apart([t for _, t in other]), strict=True):
            found[i] = ids
        return flattened(found)

    def _word(self, start: str, word: str) -> list[int]:
        text = word if word.isascii() else word.encode().decode("latin-1").translate(self.characters)
        if start == "\n":
            return [*self._signs("\n"), *(t.id for t in self.tokenizer.model.tokenize(text))]
        return [t.id for t in self.tokenizer.model.tokenize(text)]

    def _signs(self, signs: str) -> list[int]:
        if (ids := self.known_signs.get(signs)) is None:
            if len(self.known_signs) > 50_000:
                self.known_signs.clear()
            ids = self.known_signs[signs] = self.plain([signs])[0]
        return ids

    def _apart(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, many to a call."""
        if self.mark is None or any(self.mark in t for t in texts):
            return self.plain(texts)
        out: list[list[int]] = []
        for first in range(0, len(texts), 5000):
            run = np.array(self.plain([self.mark.join([*texts[first : first + 5000], ""])])[0], np.int32)
            out += [part[:-1].tolist() for part in np.split(run, np.flatnonzero(run == self.mark_id) + 1)[:-1]]
        return out

    def encode(self, texts: pa.StringArray) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        whole = np.asarray(pc.match_substring_regex(texts, JOINED_SPACE).cast(pa.int8())).astype(bool)
        cut = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(whole), "", texts), "\n", " \n"), " ")
        ids, counts = self.table.lookup(cut, mark=" ")
        out = np.split(ids, np.cumsum(counts)[:-1])
        at = np.flatnonzero(whole)
        for i, found in zip(at, self.plain(texts.take(pa.array(at)).to_pylist()), strict=True):
            out[i] = np.array(found, np.int32)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each id to an unrelated number."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the last ``WINDOW`` ids asks for a cut, after which id; each step doubles the window summed so far."""
    rolling, width = mixed_bits(ids), 1
    while width < WINDOW:
        rolling[width:] += rolling[:-width] << np.uint64(4 * width)
        width *= 2
    return np.flatnonzero(rolling >> np.uint64(64 - CUT_BITS) == 0) + 1


def _ends(size: int, cuts: list[int]) -> list[int]:
    """Where the chunks of a stream of ``size`` ids end, given its cut points. No chunk is under ``LEAST`` ids but the last, none over ``MOST``."""
    if size <= LEAST:
        return [size]
    ends, start = [], 0
    for cut in cuts:
        while cut - start > MOST:
            start += MOST
            ends.append(start)
        if cut - start >= LEAST:
            ends.append(cut)
            start = cut
    while size - start > MOST:
        start += MOST
        ends.append(start)
    return ends if start == size else [*ends, size]


def streams_ends(flat: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Where the chunks of many streams end, which lie one behind the other in ``flat``, from ``bounds``.

    A window that reaches back into the stream before ends within the first ``WINDOW`` ids, under ``LEAST``, where no chunk is cut.
    """
    points = cut_points(flat)
    own = np.searchsorted(points, bounds, "right")
    starts = bounds[:-1].tolist()
    return [_ends(n, (points[a:b] - start).tolist()) for n, start, a, b in zip(np.diff(bounds).tolist(), starts, own.tolist(), own[1:].tolist(), strict=False)]


def chunk_ends(ids: np.ndarray) -> list[int]:
    """Where the chunks of one stream end."""
    return streams_ends(ids, np.array([0, len(ids)]))[0]


def merkle_root(leaves: list[bytes]) -> bytes:
    """SHA-256 over a binary tree; leaves and inner nodes are told apart by a first byte, an odd node moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"\0").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(level) & ~1 :]
    return level[0]


def _crc_tables(powers: int = 24) -> np.ndarray:
    """[power, byte place, byte]: what 2**power zero bytes make of a CRC-32, as sums of four lookups."""
    one = np.zeros(256, np.uint32)
    for b in range(256):
        c = b
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        one[b] = c
    tables = np.zeros((powers, 4, 256), np.uint32)
    values = np.arange(256, dtype=np.uint32)
    for place in range(4):
        v = values << np.uint32(8 * place)
        tables[0, place] = one[v & 255] ^ (v >> np.uint32(8))
    for p in range(1, powers):
        for place in range(4):
            tables[p, place] = _shifted(tables[p - 1], tables[p - 1, place])
    return tables


def _shifted(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> np.uint32(8)) & 255] ^ table[2][(crc >> np.uint32(16)) & 255] ^ table[3][crc >> np.uint32(24)]


def combined_crcs(crcs: np.ndarray, sizes: np.ndarray, bounds: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """CRC-32 of each document from those of its parts; ``bounds`` says where documents begin among the parts."""
    counts = np.diff(bounds)
    out = np.zeros(len(counts), np.uint32)
    for step in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > step)
        part = bounds[:-1][live] + step
        crc, size = out[live], sizes[part]
        for p in range(int(size.max()).bit_length()):
            crc = np.where((size >> p) & 1 == 1, _shifted(tables[p], crc), crc)
        out[live] = crc ^ crcs[part]
    return out


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> None:
    """Encode every text of ``docs``, append ``end_id``, and write the store to ``path``.

    ``width`` is the bytes of a stored id: 2 up to 65,536 ids, else 4. Null and empty texts are the end id alone; very long
    texts are whole; repeated rows are documents of their own, in a fixed order; rows with a null id come first; an
    empty table gives an empty store; other columns are not read.
    """
    kind = f"<u{width}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        names = ["kind", "key", "data", "doc_id", "n_tokens", "root", "copies"]
        for batch in sliced(batches, rows=2000, size=4_000_000):
            chunks, recipes = {}, {}
            coded = encoder(tokenizer_path).encode(batch.column(1))
            bounds = np.cumsum([0, *[len(ids) + 1 for ids in coded]])
            flat = np.full(int(bounds[-1]), end_id, np.int64)
            for ids, first in zip(coded, bounds.tolist(), strict=False):
                flat[first : first + len(ids)] = ids
            raw = flat.astype(kind).tobytes()
            for doc, first, ends in zip(batch.column(0).to_pylist(), bounds.tolist(), streams_ends(flat, bounds), strict=False):
                start, keys = first, []
                for end in ends:
                    data = raw[start * width : (first + end) * width]
                    keys.append(key := hashlib.sha256(data).digest())
                    start = first + end
                    if key not in seen:
                        seen.add(key)
                        chunks[key] = data
                root = merkle_root(keys)
                # A recipe's key is its content and the document's id, so a task that runs again gives the same.
                name = root + (b"" if doc is None else doc.to_bytes(8, "big", signed=True))
                recipes[name] = (b"".join(keys), doc, ends[-1], root, recipes[name][4] + 1 if name in recipes else 1)
            if len(seen) > 500_000:  # later copies are found by the grouping
                seen.clear()
            n, m = len(chunks), len(recipes)
            data, doc, count, root, copies = zip(*recipes.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(["chunk"] * n + ["recipe"] * m, pa.string()), pa.array([*chunks, *recipes], pa.binary()), pa.array([*chunks.values(), *data], pa.binary()), pa.array([None] * n + [*doc], pa.int64()), pa.array([None] * n + [*count], pa.int64()), pa.array([None] * n + [*root], pa.binary()), pa.array([1] * n + [*copies], pa.int64())], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    objects = map_arrow(rows, cut, "kind string, key binary, data binary, doc_id long, n_tokens long, root binary, copies long")
    # A task gives a chunk once for each 500,000, so there is little to combine before the exchange: one sort instead of two.
    objects = objects.repartition("kind", "key").groupBy("kind", "key").agg(*[F.first(c).alias(c) for c in ("data", "doc_id", "n_tokens", "root")], F.sum("copies").alias("copies"))
    objects.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/objects")
    _write_index(docs.sparkSession, path)


def _objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key binary, data binary, doc_id long, n_tokens long, root binary, copies long, kind string").parquet(f"{path}/objects")


def _write_index(spark: SparkSession, path: str) -> None:
    """Recipes in id order, with the number of ids and of documents before each: sums of range partitions first, then sums within one."""
    recipes = _objects(spark, path).filter("kind = 'recipe'").select("doc_id", "n_tokens", "root", F.col("data").alias("recipe"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")
    order = ["doc_id", "root", "recipe"]
    placed = written(recipes.repartitionByRange(*order).withColumn("run", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "recipes")
    runs = placed.groupBy("run").agg(F.sum("n_tokens").alias("run_tokens"), F.count("*").alias("run_documents"))
    before = W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)  # one row for each range partition
    sums = {"run_start": F.coalesce(F.sum("run_tokens").over(before), F.lit(0)), "run_place": F.coalesce(F.sum("run_documents").over(before), F.lit(0))}
    runs = written(runs.withColumns(sums), "runs")
    inner = W.partitionBy("run").orderBy(*order, "row").rowsBetween(W.unboundedPreceding, -1)
    started = placed.withColumns({"inner": F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)), "nth": F.count("*").over(inner)}).join(runs.select("run", "run_start", "run_place"), "run")
    index = started.select("doc_id", (F.col("run_start") + F.col("inner")).alias("start"), "n_tokens", "root", "recipe", (F.col("run_place") + F.col("nth")).alias("place"))
    index.repartitionByRange("doc_id", "start").sortWithinPartitions("doc_id", "start").write.option("compression", "zstd").parquet(f"{path}/index")
    manifest_nodes(read_index(spark, path)).write.parquet(f"{path}/manifest")


def manifest_nodes(index: DataFrame) -> DataFrame:
    """The nodes of the Merkle tree over ``index`` (place, n_tokens, root); each groups a fixed run of children, so no row grows with the corpus."""

    @F.pandas_udf("binary")
    def tree_root(roots):
        return roots.map(lambda r: merkle_root([bytes(x) for x in r]))

    def grouped(children: DataFrame, level: int) -> DataFrame:
        at = F.floor(F.col("place") / FAN).cast("long")
        rows = children.groupBy(at.alias("place")).agg(F.min("first").alias("first"), F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("place", "root")))["root"].alias("roots"))
        return written(rows.select(F.lit(level).alias("level"), "place", "first", "documents", "tokens", tree_root("roots").alias("root")), "manifest-level")

    ship(index.sparkSession)
    nodes = grouped(index.select("place", F.col("place").alias("first"), F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("tokens"), "root"), 0)
    out, level = nodes, 0
    while (nodes.agg(F.max("place")).first()[0] or 0) > 0:
        level += 1
        nodes = grouped(nodes.drop("level"), level)
        out = out.unionByName(nodes)
    return out


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("level int, place long, first long, documents long, tokens long, root binary").parquet(f"{path}/manifest")


def damaged_runs(spark: SparkSession, path: str) -> DataFrame:
    """(place): numbers of the runs of ``FAN`` documents whose node, or a node above it, does not agree with the index.

    A missing manifest agrees with nothing. Nodes are few: one for ``FAN`` documents.
    """
    index = read_index(spark, path)
    found = manifest_nodes(index).select("level", "place", *[F.col(c).alias(f"own_{c}") for c in ("documents", "tokens", "root")])
    try:
        stored = read_manifest(spark, path)
    except AnalysisException:
        stored = spark.createDataFrame([], "level int, place long, first long, documents long, tokens long, root binary")
    joined = found.join(stored, ["level", "place"], "full")
    bad = joined.filter(F.coalesce((F.col("own_root") != F.col("root")) | (F.col("own_documents") != F.col("documents")) | (F.col("own_tokens") != F.col("tokens")), F.lit(True))).select("level", "place")
    # A bad node above covers all runs below it; the root differs whenever anything does, so only nodes whose children all agree count by themselves.
    bad = written(bad, "bad-nodes")
    below = bad.filter("level > 0").select("level", "place").join(bad.select((F.col("level") + 1).alias("level"), F.floor(F.col("place") / FAN).cast("long").alias("place")).distinct(), ["level", "place"], "left_anti")
    spread = below.select(F.explode(F.sequence(F.col("place") * F.pow(F.lit(float(FAN)), "level").cast("long"), (F.col("place") + 1) * F.pow(F.lit(float(FAN)), "level").cast("long") - 1)).alias("place"))
    runs = found.filter("level = 0").select("place")
    return bad.filter("level = 0").select("place").unionByName(runs.join(spread, "place", "left_semi")).distinct()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, start long, n_tokens long, root binary, recipe binary, place long").parquet(f"{path}/index")


def _addresses(index: DataFrame) -> DataFrame:
    """One row for each chunk of each recipe: doc_id, start, n_tokens, root, place, at, key."""
    at = F.explode(F.sequence(F.lit(0), (F.octet_length("recipe") / 32 - 1).cast("int"))).alias("at")
    return index.select("doc_id", "start", "n_tokens", "root", "place", "recipe", at).withColumn("key", F.substring(F.col("recipe"), F.col("at") * 32 + 1, F.lit(32))).drop("recipe")


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, start, ids): the id streams, reassembled from chunks by their recipes, end ids included; null where a chunk is missing.

    An empty store gives no rows; repeated documents and null ids are rows of their own.
    """

    @F.pandas_udf("array<int>")
    def joined(parts):
        return parts.map(lambda p: None if any(x is None for x in p) else np.frombuffer(b"".join(p), f"<u{width}").astype(np.int32))

    ship(spark)
    chunks = _objects(spark, path).filter("kind = 'chunk'").select("key", "data")
    parts = salted_join(_addresses(read_index(spark, path)), chunks, ["key"], F.struct("place", "at"), salts=4)
    grouped = parts.groupBy("place", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("parts"))
    return grouped.select("doc_id", "start", joined(F.col("parts.data")).alias("ids"))


def verified_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified) of every document of the index, all from the store's files.

    ``verified``: each chunk's bytes have the address they are stored under, all chunks of the recipe are there,
    the Merkle root over them is the stored one, the ids are as many as the index says, and the manifest agrees with the index
    about the document's run. A missing chunk has the checksum of no bytes. An empty store gives no rows; repeated documents and null ids
    are rows of their own.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            crcs = [zlib.crc32(np.frombuffer(d, f"<u{width}").astype("<u4").tobytes()) for d in data]
            good = [hashlib.sha256(d).digest() == k for k, d in zip(keys, data, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array([len(d) // width for d in data], pa.int64()), pa.array(good, pa.bool_())], names=["key", "crc", "n", "good"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of whole documents: rows come by document and place in it, and a batch's last document may go on in the next batch."""
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            place = np.asarray(batch.column(0))
            if not len(place):
                continue
            new = np.flatnonzero(np.diff(place, prepend=rest[-1].column(0)[-1].as_py() if rest else place[0]))
            if len(new):
                yield pa.concat_batches([*rest, batch.slice(0, new[-1])])
                rest, batch = [], batch.slice(new[-1])
            rest.append(batch)
        if rest:
            yield pa.concat_batches(rest)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _crc_tables()
        for batch in documents(batches):
            place = np.asarray(batch.column("place"))
            at = np.flatnonzero(np.diff(place, prepend=place[0] - 1, append=place[-1] + 1))
            first = batch.take(pa.array(at[:-1]))
            crcs, sizes = np.asarray(batch.column("crc")).astype(np.uint32), np.asarray(batch.column("n"))
            keys, good = batch.column("key").to_pylist(), np.asarray(batch.column("good").cast(pa.int8()))
            crc = combined_crcs(crcs, sizes * 4, at, tables)
            total, faults = np.add.reduceat(sizes, at[:-1]), np.add.reduceat(1 - good, at[:-1])
            roots = [merkle_root(keys[a:b]) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
            fine = (total == np.asarray(first.column("n_tokens"))) & (faults == 0) & np.array([a == b for a, b in zip(roots, first.column("root").to_pylist(), strict=True)])
            own = [first.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(crc.astype(np.int64)), pa.array(fine, pa.bool_()), first.column("place")], names=["doc_id", "start", "n_tokens", "ids_crc32", "fine", "place"])

    chunks = map_arrow(_objects(spark, path).filter("kind = 'chunk'").select("key", "data"), sums, "key binary, crc long, n long, good boolean")
    # Missing chunks keep their documents in the result. One exchange on either side, so adaptive execution splits a hot chunk.
    parts = _addresses(read_index(spark, path)).join(chunks, "key", "left")
    root = F.when(F.col("at") <= 0, F.col("root")).alias("root")
    found = [F.coalesce("crc", F.lit(0)).alias("crc"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("good", F.lit(False)).alias("good")]
    parts = parts.select("place", "at", "doc_id", "start", "n_tokens", root, "key", *found).repartition("place").sortWithinPartitions("place", "at")
    combined = map_arrow(parts, combine, "doc_id long, start long, n_tokens long, ids_crc32 long, fine boolean, place long")
    bad = damaged_runs(spark, path).withColumn("bad", F.lit(True)).withColumnRenamed("place", "run")
    judged = combined.withColumn("run", F.floor(F.col("place") / FAN).cast("long")).join(bad, "run", "left")
    return judged.select("doc_id", "start", "n_tokens", "ids_crc32", (F.col("fine") & F.col("bad").isNull()).alias("verified"))
