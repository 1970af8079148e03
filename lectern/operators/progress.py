"""Reading progress from events: latest position, bookmarks, checkpoints, double taps.

Events have event_id, ts, doc_id and what the operator names. All group by document; a document's events are few, and
counts and maxima combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.shipping import written


def latest_progress(events: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, updated_ts): the last event of each document, by time and then id."""
    last = F.max(F.struct("ts", "event_id", "chunk_index"))
    return events.groupBy("doc_id").agg(last.alias("last")).select("doc_id", F.col("last.chunk_index").alias("chunk_index"), F.col("last.ts").alias("updated_ts"))


def saved_positions(events: DataFrame) -> DataFrame:
    """Events that change the position: those equal to the one before are not written again."""
    before = F.lag("chunk_index").over(W.partitionBy("doc_id").orderBy("ts", "event_id"))
    return events.withColumn("_before", before).filter(~F.col("chunk_index").eqNullSafe(F.col("_before"))).drop("_before")


def bookmarks(events: DataFrame) -> DataFrame:
    """(doc_id, bookmarks): chunks toggled an odd number of times, ascending; documents without any are absent."""
    odd = events.groupBy("doc_id", "chunk_index").agg(F.count("*").alias("n")).filter("n % 2 = 1")
    return odd.groupBy("doc_id").agg(F.array_sort(F.collect_list("chunk_index")).alias("bookmarks"))


def toggled(marks, chunk):
    """A sorted array of bookmarks with one chunk added or taken away."""
    return F.when(F.array_contains(marks, chunk), F.array_remove(marks, chunk)).otherwise(F.array_sort(F.array_append(marks, chunk)))


def is_bookmarked(marks: Column, chunk: Column) -> Column:
    """Whether a chunk is among the bookmarks; documents without any have none."""
    return F.coalesce(F.array_contains(marks, chunk), F.lit(False))


def bookmark_chips(marks: Column, shown: int = 4) -> Column:
    """struct(chips, more): the first bookmarks, and how many more there are, null if none."""
    more = F.size(marks) - shown
    return F.struct(F.slice(marks, 1, shown).alias("chips"), F.when(more > 0, F.concat(F.lit("+"), more.cast("string"), F.lit(" more"))).alias("more"))


def checkpoints(events: DataFrame, every: int = 20) -> DataFrame:
    """Positions that playback saves: each ``every``-th chunk but a document's first position."""
    start = F.first("chunk_index").over(W.partitionBy("doc_id").orderBy("ts", "event_id"))
    return events.withColumn("start_index", start).filter((F.col("chunk_index") % every == 0) & (F.col("chunk_index") != F.col("start_index")))


def double_tap_pairs(taps: DataFrame, within_ms: int = 350) -> DataFrame:
    """Taps that follow another of the same document within some time; three in a row are two pairs."""
    before = F.lag("ts").over(W.partitionBy("doc_id").orderBy("ts", "event_id"))
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1000
    return taps.withColumn("gap_ms", gap).filter(F.col("gap_ms") < within_ms)


def double_taps(taps: DataFrame, within_ms: int = 350) -> DataFrame:
    """As :func:`double_tap_pairs`, but a double tap ends its pair: three in a row are one double tap and a single one.

    A tap is a map of two states, whether one waits for a second or not: one that is close to its predecessor swaps them, any
    other makes both wait. So a tap is a double one if an odd number of close ones ends with it, and maps compose by adding
    numbers. Taps lie in ranges of document and time; each range's part of a document becomes one map, the maps of a
    document are composed in order, and its taps are then decided range by range. No task sees a whole document.
    """
    order = ["doc_id", "ts", "event_id"]
    n = int(taps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = taps.select("doc_id", "event_id", "ts").repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Both passes must see the same ranges, and outlive a lost executor.
    dealt = written(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id(), "us": F.unix_micros(F.col("ts").cast("timestamp"))}), "tap-ranges")
    own = W.partitionBy("part", "doc_id").orderBy("at")
    near = lambda gap: F.coalesce(gap < within_ms * 1000, F.lit(False))
    rows = dealt.withColumns({"first": F.row_number().over(own) == 1, "close": near(F.col("us") - F.lag("us").over(own))})
    # One row for each document in a range; of one document as many as there are ranges at most.
    broken = F.max(F.when(~F.col("first") & ~F.col("close"), F.col("at")))
    parts = rows.groupBy("doc_id", "part").agg(F.min(F.struct("at", "us")).alias("begin"), F.max(F.struct("at", "us")).alias("end"), F.count("*").alias("n"), broken.alias("broken"))
    before = W.partitionBy("doc_id").orderBy("part")
    parts = parts.withColumn("joined", near(F.col("begin.us") - F.lag("end.us").over(before)))
    # Close taps at a part's end: since the last one that is not close, or all of them and those before the part.
    through = F.col("broken").isNull() & F.col("joined")
    ends = F.col("end.at") - F.coalesce("broken", "begin.at")
    parts = parts.withColumns({"kept": F.when(through, F.col("n")).otherwise(ends), "stop": F.when(~through, F.col("part"))})
    parts = parts.withColumn("since", F.max("stop").over(before))
    run = W.partitionBy("doc_id", "since").orderBy("part")
    parts = parts.withColumn("total", F.sum("kept").over(run)).withColumn("carried", F.when(F.col("joined"), F.coalesce(F.lag("total").over(before), F.lit(0))))
    told = rows.join(parts.select("doc_id", "part", "joined", "carried"), ["doc_id", "part"])
    close = F.when(F.col("first"), F.col("joined")).otherwise(F.col("close"))
    told = told.withColumn("close", close)
    last = F.max(F.when(~F.col("close"), F.col("at"))).over(own)
    start = F.min("at").over(own)
    number = F.when(last.isNotNull(), F.col("at") - last).otherwise(F.col("at") - start + 1 + F.coalesce("carried", F.lit(0)))
    return told.withColumn("number", number).filter("close and number % 2 = 1").select("doc_id", "event_id", "ts")
