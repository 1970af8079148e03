"""Queries of a document library: search, orders, totals, what to read next, labels of cards.

Tables here have doc_id, title, word_count, is_readable, updated_ts, created_ts, chunk_index. Results carry their order as a rank
column, so a caller who needs no order pays for none; ties fall by ``position``, the place in the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.reading import eta_label, library_progress, word_label
from lectern.functions.text import js_trim, word_count
from lectern.shipping import written


def normalized(docs: DataFrame, now: Column) -> DataFrame:
    """Stored rows with every default filled in; ``now`` is given, never read from the clock."""
    content = F.coalesce("content", F.lit(""))
    readable = F.coalesce("is_readable", F.length(js_trim(content)) > 0)
    return docs.select(
        "id", F.coalesce("title", F.lit("Untitled Document")).alias("title"), F.coalesce("format", "source_format", F.lit("TXT")).alias("format"), F.coalesce("source_format", "format", F.lit("TXT")).alias("source_format"), content.alias("content"),
        F.coalesce("created_at", now).alias("created_at"), F.coalesce("updated_at", now).alias("updated_at"), F.coalesce("chunk_index", F.lit(0)).cast("long").alias("chunk_index"), F.coalesce("bookmarks", F.array().cast("array<bigint>")).alias("bookmarks"),
        F.coalesce("last_mode", F.lit("2D")).alias("last_mode"), F.when(readable, word_count(content)).otherwise(0).cast("long").alias("word_count"), readable.alias("is_readable"), "unreadable_reason", F.coalesce("conversion_warnings", F.array().cast("array<string>")).alias("conversion_warnings"),
    )


def searched(docs: DataFrame, query: str) -> DataFrame:
    """Titles that contain the query, letter case aside; a blank query keeps all. The query is not trimmed otherwise."""
    return docs if not query.strip() else docs.filter(F.lower("title").contains(query.lower()))


def looked_up(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` of the given ids (doc_id), each with ``found``; an id of no document gives a row of nulls."""
    return ids.join(docs.withColumn("found", F.lit(True)), "doc_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def progress_share() -> Column:
    return F.when(F.col("word_count") > 0, F.col("chunk_index").cast("double") / F.col("word_count")).otherwise(0.0)


def order_keys(order: str, collation: str | None = None) -> list[Column]:
    """Sort keys for ``recent``, ``alpha`` (by a collation if given) or ``progress``."""
    title = F.collate("title", collation) if collation else F.col("title")
    keys = {"recent": F.desc("updated_ts"), "alpha": title.asc(), "progress": progress_share().desc()}
    return [keys[order], F.asc("doc_id")]


def ranked(docs: DataFrame, order: str, first: int | None = None, collation: str | None = None) -> DataFrame:
    """``docs`` with ``rank`` in one of the orders, from 0.

    A total order needs all rows' places: ranges are sorted side by side and their sizes added up, so no task sees
    the whole library. With ``first`` only that many rows are kept, by a top-n in each task.
    """
    keys = order_keys(order, collation)
    if first is not None:
        return docs.orderBy(*keys).limit(first).withColumn("rank", (F.row_number().over(W.orderBy(*keys)) - 1).cast("long"))
    # The rows are computed once; sampling the ranges and sorting read them again.
    placed = written(docs, "ranked-rows").repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumns({"_range": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    # Both uses below must see the same places, and outlive a lost executor.
    placed = written(placed, "ranked-places")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    starts = placed.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return placed.join(starts.select("_range", "_start"), "_range").withColumn("rank", F.col("_start") + F.col("_in")).drop("_at", "_range", "_in", "_start")


def totals(docs: DataFrame) -> DataFrame:
    """files, readable files and words of readable documents."""
    readable = F.col("is_readable")
    return docs.agg(F.count("*").alias("files"), F.count(F.when(readable, 1)).alias("readable_files"), F.coalesce(F.sum(F.when(readable, F.col("word_count"))), F.lit(0)).alias("total_words"))


def continue_reading(docs: DataFrame) -> DataFrame:
    """The readable document touched last that is not finished, else the first readable one, else no row."""
    readable = docs.filter("is_readable").withColumn("unfinished", F.col("chunk_index") < F.col("word_count"))
    return readable.orderBy(F.desc("unfinished"), F.when(F.col("unfinished"), F.col("updated_ts")).desc_nulls_last(), "doc_id").limit(1)


def card_columns() -> dict[str, Column]:
    """Progress, time left and word count as the library shows them."""
    return {"progress_percent": library_progress(F.col("chunk_index"), F.col("word_count")), "eta": eta_label(F.col("word_count"), F.col("chunk_index")), "words": word_label(F.col("word_count"))}


def card_message(default: Column | str = "No readable text detected.") -> Column:
    """Why a document cannot be read, else its first warning, else null."""
    default = F.lit(default) if isinstance(default, str) else default
    return F.when(~F.col("is_readable"), F.coalesce("unreadable_reason", default)).otherwise(F.get("conversion_warnings", F.lit(0)))
