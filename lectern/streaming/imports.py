"""Files of a folder into a library, as a stream: each batch of new files is extracted, titled and appended under the batch's number.

A batch that runs again, after a failure or from a lost checkpoint, replaces itself, so no file is in the library twice. Files are
known by their address: a file that is written again under the same name is a new version of its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lectern.functions.files import name_in_uri
from lectern.functions.text import title_of_file
from lectern.shipping import passing_tables, written
from lectern.sources.files import NAMES, UNREAD, extract_texts, opened
from lectern.sources.store import Library

#: Settings of a session that imports, at most: a batch names its files one by one, and they are small. Listing them starts a task for each up to the first
#: number; opening one counts as so many bytes when files are dealt to tasks (Spark's 4 MB make a task of every few).
SETTINGS = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": 64, "spark.sql.files.openCostInBytes": 1 << 16}
FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, glob: str = "*", files_per_batch: int = 10_000) -> DataFrame:
    """A stream of the files below a folder: path, modificationTime, length, content."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.option("maxFilesPerTrigger", files_per_batch).load(folder)


def file_rows(files: DataFrame, name: Callable[[Column], Column] = name_in_uri) -> DataFrame:
    """Sources for ``extract_texts`` from files as Spark reads them; ``name`` says what a path is called."""
    gap = F.lit(None).cast("string")
    return files.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("uri"), name(F.col("path")).alias("name"), gap.alias("mime_type"), gap.alias("base64"), "content", F.col("modificationTime").alias("modified"))


def import_batch(files: DataFrame, library: Library, batch: str, name: Callable[[Column], Column] = name_in_uri, now: Column | None = None) -> None:
    """Extract, title and append some files. Files without a readable text become rows that say why.

    ``now`` may use ``modified``, which it is by default, so that a batch run again writes the same rows.
    """
    now, found = F.unix_millis("modified") if now is None else now, Observation()
    payload = lambda texts: texts.select(F.lower(F.hex("doc_id")).alias("id"), "title", "source_format", F.col("text").alias("content"), "is_readable", "unreadable_reason", F.col("warnings").alias("conversion_warnings"), "now")
    with passing_tables(files.sparkSession):
        # Files are read once; plain texts are extracted then, and the formats that occur are counted on the way.
        rows = opened(file_rows(files, name).withColumn("now", now.cast("long")), "title", "now")
        rows = written(rows.observe(found, *[F.max(F.col("format") == kind).alias(kind) for kind in (*NAMES, *UNREAD)]), "import-files")
        payloads = payload(rows.filter("format = 'TXT'"))
        if others := {kind for kind, occurs in found.get.items() if occurs} - {"TXT"}:
            sources = rows.filter("format <> 'TXT'")
            texts = extract_texts(sources.drop("title", "now", "format"), formats=others).join(sources.select("doc_id", "title", "now"), "doc_id")
            # The library writes fields and texts apart; both come from one extraction.
            payloads = written(payloads.unionByName(payload(texts)), "import-texts")
        library.add(payloads, F.col("now"), batch)


def import_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, stream: str = "import", glob: str = "*", name: Callable[[Column], Column] = name_in_uri, now: Column | None = None, files_per_batch: int = 10_000, buckets: int | None = None) -> DataStreamWriter:
    """A stream, ready to start, that imports a folder's files into the library at ``path``.

    ``stream`` is part of the batches' names: streams of different folders into one library need different ones.
    """
    more = {} if buckets is None else {"buckets": buckets}

    def save(batch: DataFrame, number: int) -> None:
        import_batch(batch, Library(batch.sparkSession, path, **more), f"{stream}-{number:012d}", name, now)

    for setting, most in SETTINGS.items():
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting)) > most:  # numbers may have units
            spark.conf.set(setting, most)
    return arriving_files(spark, folder, glob, files_per_batch).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
