"""Progress events as a stream: late repeats dropped, latest positions written, double taps by state.

Event time needs a zone: events come with ``ts`` as a timestamp, not one without zone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.progress import latest_progress
from lectern.shipping import ship


def unique_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once, however often it is sent within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def reading_by_window(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window_start, doc_id, events, furthest): how much was read in each window."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "doc_id")
    return grouped.agg(F.count("*").alias("events"), F.max("chunk_index").alias("furthest")).select(F.col("w.start").alias("window_start"), "doc_id", "events", "furthest")


def write_latest(events: DataFrame, path: str, checkpoint: str, late: str = "10 minutes"):
    """Append each batch's latest position of each document to ``path``; a batch that is run again replaces itself.

    Readers take the last version of a document (:func:`latest_of`), so no batch rewrites another one.
    """

    def save(batch: DataFrame, number: int) -> None:
        latest_progress(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return unique_events(events, late).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def latest_of(versions: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, updated_ts) of the tables that :func:`write_latest` left."""
    last = F.max(F.struct("updated_ts", "chunk_index"))
    return versions.groupBy("doc_id").agg(last.alias("last")).select("doc_id", F.col("last.chunk_index").alias("chunk_index"), F.col("last.updated_ts").alias("updated_ts"))


def double_tap_stream(taps: DataFrame, within_ms: int = 350) -> DataFrame:
    """(doc_id, event_id, ts) of each tap that ends a double tap; the pair is then over. State is one time for each document."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        kept = []
        for ts in rows["ts"]:
            now = int(ts.timestamp() * 1_000_000)
            second = last >= 0 and now - last < within_ms * 1000
            kept.append(second)
            last = -1 if second else now
        state.update((last,))
        yield rows.loc[kept, ["doc_id", "event_id", "ts"]]

    ship(taps.sparkSession)
    return taps.select("doc_id", "event_id", "ts").groupBy("doc_id").applyInPandasWithState(fold, "doc_id long, event_id long, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout)
