"""Tables written between steps: they cut lineage and survive the loss of any executor.

They have an owner.  Every session has a folder of its own in the shared one, which goes when the
driver's JVM ends; inside ``scratch`` they go at its end; ``discard`` deletes single ones at once.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder used where the session names none.
_own: list[str] = []
#: The folder of each session, by its application and the shared folder.
_sessions: dict[tuple[str, str], str] = {}
#: The folders of the scratch blocks that are open, outermost first.
_open: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset and Spark runs on one machine (tests) a local folder is chosen;
    on a cluster a missing setting is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="sagebrook-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        at = "file://" + _own[0]
    return at.rstrip("/")


def _at(spark: SparkSession, path: str):
    """A path and its file system, as the JVM has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    at, files = _at(spark, path)
    files.delete(at, True)


def session_dir(spark: SparkSession) -> str:
    """The session's folder; it is deleted when the driver's JVM ends, however that comes about."""
    base = shared_dir(spark)
    key = (spark.sparkContext.applicationId, base)
    if key not in _sessions:
        path = f"{base}/{key[0]}-{uuid.uuid4().hex[:8]}"
        at, files = _at(spark, path)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _sessions[key] = path
    return _sessions[key]


def clear(spark: SparkSession) -> None:
    """Delete all that the session has stored; results that rest on it can no longer be read."""
    _delete(spark, session_dir(spark))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for the tables made inside, deleted at the end, also after an error.

    A result that is still to be read is kept by ``materialize(..., keep=True)``, which gives it to
    the block around this one, or to the session.
    """
    path = f"{session_dir(spark)}/scratch-{uuid.uuid4().hex}"
    before = _open.set((*_open.get(), path))
    try:
        yield path
    finally:
        _open.reset(before)
        _delete(spark, path)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table of its owner's and read it back."""
    spark = df.sparkSession
    blocks = _open.get()[: -1 if keep else None]
    path = f"{blocks[-1] if blocks else session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` made and that nothing still to be read rests on."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            _delete(df.sparkSession, path)
