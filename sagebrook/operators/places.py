"""Places of rows within groups of any size, without a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import materialize


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "places") -> DataFrame:
    """``rows`` with ``pos``: the place from 0 among the rows with equal ``by``, in ``order``.

    Rows are range-sorted by group and order, so a group is spread over as many tasks as it has rows
    for, and stored with their place; only (group, task) rows are counted and summed.
    """
    keys = [F.col(c).asc_nulls_first() for c in by] + list(order)
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    sorted_ = materialize(sorted_, name)
    task = F.shiftright("__at", 33)
    parts = sorted_.groupBy(*by, task.alias("__task")).agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*[F.col(c).alias(f"__{c}") for c in by], "__task", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("__shift"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    placed = sorted_.join(parts, same & (task == F.col("__task")))
    return placed.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__at", "__task", "__shift", *[f"__{c}" for c in by])
