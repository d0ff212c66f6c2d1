"""Session plumbing shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import discard, materialize, scratch, session_dir  # noqa: F401

#: Upper bounds of one Arrow batch handed to a Python worker.
ARROW_RECORDS = 1000
ARROW_BYTES = 4 << 20

#: Stands for a missing doc_id inside join keys.
NO_ID = -(2**63)


def arrow_limits(spark: SparkSession) -> None:
    """Bound what one batch sent to a Python worker holds, whatever the length of texts."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > ARROW_RECORDS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_RECORDS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batched(
    docs: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow with a function of one record batch, to one batch or to several."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                for part in (out,) if isinstance(out, pa.RecordBatch) else out:
                    if part.num_rows:
                        yield part

    return docs.mapInArrow(run, schema)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df``, best a stored table, has at most ``rows`` rows; every task counts its own."""
    return df.count() <= rows


#: The most rows of a narrow side that are sent to every executor to spare the shuffle of
#: whole texts: some tens of MB at two numbers a row.
NARROW_ROWS = 1_000_000


def narrow(df: DataFrame, rows: int = NARROW_ROWS) -> DataFrame:
    """``df`` broadcast if it is within bounds; beyond them the join shuffles both sides."""
    return F.broadcast(df) if small_enough(df, rows) else df


def as_text(column: str = "text"):
    """A text column with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
