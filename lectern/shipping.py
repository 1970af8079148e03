"""What a session needs around the operators: the package on its Python workers, and a folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Whether Spark deletes the shuffle files of a statement at its end; otherwise they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths handed out in the innermost block of ``passing_tables``.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lectern-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    staged = Path(folder, "staged")
    shutil.copytree(package, staged / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(Path(folder, package.name)), "zip", staged))
    _SHIPPED.add(context.applicationId)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local session may name none: it gets a temporary one, removed at exit. On a cluster such a folder would be another one
    on every machine, so there it is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-")
        context.setCheckpointDir(folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder; nothing else uses it."""
    path = f"{checkpoint_folder(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    if (passing := _PASSING.get()) is not None:
        passing.append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing will read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables whose paths are made in this block are deleted at its end. What is to stay goes to a path made before it."""
    made: list[str] = []
    token = _PASSING.set(made)
    try:
        yield
    finally:
        _PASSING.reset(token)
    for path in made:
        discard(spark, path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a Parquet table and return it as read from there. Its shuffle files are deleted as soon as it is written."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and return it as read from there.

    This cuts the lineage: an executor that is lost later costs a re-read, not a recomputation, and
    columns such as generated row numbers stay what they were.
    """
    return stored(df, scratch_path(df.sparkSession, name))
