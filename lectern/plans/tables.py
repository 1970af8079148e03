"""The driver's tables in the shapes of the library: documents with names, titles and progress, events as progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import is_readable_text, title_of_file, word_count
from lectern.operators.progress import latest_progress

NAMES = ("txt", "pdf", "docx", "doc", "epub", "mobi", "rtf", "html", "htm")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, doc_id, event_type, chunk_index): a user stands for a document."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", "ts", F.col("user_id").alias("doc_id"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("chunk_index"))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, file_name, mime_type): names and types by rule from doc_id and source."""
    ending = F.when(F.col("doc_id") % 10 == 9, "").otherwise(F.concat(F.lit("."), F.get(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 10).cast("int"))))
    mime = F.when(F.col("doc_id") % 2 == 0, None).when(F.col("doc_id") % 4 == 1, "text/html").otherwise("application/msword")
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), ending).alias("file_name"), mime.alias("mime_type"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``named`` with title, word_count, is_readable, times and position. Texts are counted before the join, and only used columns are read."""
    docs = named(spark, sf_dir).withColumns({"title": title_of_file(F.col("file_name")), "word_count": word_count(F.col("text")).cast("long"), "is_readable": is_readable_text(F.col("text")), "created_ts": F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))})
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return docs.join(latest_progress(progress_events(spark, sf_dir)), "doc_id", "left").withColumns({"updated_ts": F.coalesce("updated_ts", start), "chunk_index": F.coalesce("chunk_index", F.lit(0))})
