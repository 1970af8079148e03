"""Exact duplicates by deterministic block naming.

Every text is cut into fixed-size blocks. The distinct blocks are sorted, and a block's place in that order
is its integer name; then adjacent names are paired, the distinct pairs are sorted and named in turn, and so on
until a document has one name. Equal names mean equal texts: no step compares hashes, so nothing can collide.

Unequal fingerprints prove that two texts differ, so only texts that share fingerprint and length with
another one are named; all others are alone in their class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import counted_join, lowered, maybe_among, passing_tables, salted_join, scratch_path, stored, without_rows, written


def _named(items: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The distinct ``keys`` with their number of ``items`` and ``name``: an integer that follows their sort order over all partitions."""
    distinct = items.groupBy(*keys).agg(F.count("*").alias("items"))
    ordered = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(ordered.withColumn("name", F.monotonically_increasing_id()), label)


def block_identities(texts: DataFrame, block_chars: int = 4096) -> DataFrame:
    """(row, level, name) of each row of ``texts`` (row, text): equal texts, and only they, share level and name.

    ``level`` is how often names were paired; a name means something at its level only. Null and empty texts
    have one empty block. ``row`` must be unique.
    """
    blocks = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    blocks = F.when(F.size(blocks) > 0, blocks).otherwise(F.array(F.lit("")))
    cut = texts.select("row", F.size(blocks).alias("left"), F.posexplode(blocks).alias("at", "block"))
    names = _named(cut, ["block"], "block-names")
    parts = written(counted_join(cut, names, ["block"], F.struct("row", "at"), "items").select("row", "left", "at", "name"), "named-blocks")
    level, done = 0, []
    while True:
        done.append(parts.filter("left = 1").select("row", F.lit(level).alias("level"), "name"))
        most = parts.agg(F.max("left")).first()[0] or 1
        if most == 1:
            return reduce(DataFrame.unionByName, done)
        even = F.col("at") % 2 == 0
        pairs = (
            parts.filter("left > 1")
            .groupBy("row", F.floor(F.col("at") / 2).cast("int").alias("at"))
            .agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"), F.first(F.ceil(F.col("left") / 2).cast("int")).alias("left"))
        )
        pairs = written(pairs, "pairs")
        parts = written(counted_join(pairs, _named(pairs, ["a", "b"], "pair-names"), ["a", "b"], F.struct("row", "at"), "items").select("row", "left", "at", "name"), "named-pairs")
        level += 1


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096) -> DataFrame:
    """Classes of texts that are identical after lower-casing A-Z.

    Returns one row per row of ``docs``: doc_id, keep_id (largest id of the class), group_size (rows of the
    class), kept (whether the row has that id), text_sha256 (of the normalised text).

    Edge cases: a null text equals an empty one; a null id never wins over another, and a class of null ids
    only has keep_id null and keeps its rows; repeated rows count each, and those with the winning id are all
    marked kept (``drop_exact_duplicates`` leaves one); an empty table gives an empty result; other columns
    are not read.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), lowered(F.col(text_col)).alias("text"))
    printed = text.withColumns({"print": F.xxhash64("text"), "bytes": F.octet_length("text")})
    shared = written(printed.groupBy("print", "bytes").agg(F.count("*").alias("n")).filter("n > 1"), "shared-prints")
    candidates = maybe_among(printed, "print", shared)
    candidates = candidates.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"), F.when(F.col("maybe"), F.col("text")).alias("text"), "print", "bytes", "maybe")
    candidates = written(candidates, "dedup-candidates")
    checked = salted_join(candidates.filter("maybe"), shared, ["print", "bytes"], F.struct("row"))
    rows = written(checked.select("row", "doc_id", "text_sha256", F.when(F.col("n").isNotNull(), F.col("text")).alias("text"), F.col("n").isNotNull().alias("shared")), "dedup-rows")
    alone = candidates.filter("not maybe").select("doc_id", "text_sha256").unionByName(rows.filter("not shared").select("doc_id", "text_sha256"))
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    names = block_identities(rows.filter("shared").select("row", "text"), block_chars)
    members = written(rows.filter("shared").select("row", "doc_id", "text_sha256").join(names, "row"), "dedup-members")
    classes = members.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    grouped = salted_join(members, classes, ["level", "name"], F.struct("row"), "inner")
    return alone.unionByName(grouped.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the largest id.

    Edge cases as in ``exact_duplicates``: null and empty texts are equal, a class of null ids keeps one row, and of repeated rows
    with the winning id one stays; very long texts are whole; other columns may have any name; an empty table
    stays empty. Rows that lose are found first; they alone are joined against.
    """
    if docs.isEmpty():
        return docs
    path = scratch_path(docs.sparkSession, "dedup-lost")
    with passing_tables(docs.sparkSession):
        found = exact_duplicates(docs, id_col, text_col, block_chars)
        tied = found.filter("kept and group_size > 1").groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest")).agg(F.count("*").alias("same"))
        lost = found.filter("not kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest")).distinct().withColumn("same", F.lit(0).cast("long"))
        lost = stored(lost.unionByName(tied.filter("same > 1")), path)
    return without_rows(docs, lost, id_col, F.sha2(lowered(F.col(text_col)), 256))
