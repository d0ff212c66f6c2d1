"""What became of merged entities, over any number of rounds of merging and resolving.

Every merge is a row (entity_id, into, reason, round).  The last survivor of an entity is found by
pointer jumping: each round doubles how far a pointer reaches, so chains of n merges take about
log2(n) joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import discard, materialize
from .resolution import repoint

SCHEMA = "entity_id string, into string, reason string, round int"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def record(lineage: DataFrame, entities: DataFrame, into: str, reason: str, round_: int) -> DataFrame:
    """The lineage and the merges of one round: the rows of ``entities`` whose column ``into`` names
    a survivor."""
    rows = entities.filter(F.col(into).isNotNull() & (F.col(into) != F.col("entity_id")))
    return lineage.unionByName(rows.select("entity_id", F.col(into).alias("into"), F.lit(reason).alias("reason"), F.lit(round_).alias("round")))


def pointers(lineage: DataFrame) -> DataFrame:
    """(entity_id, into): the last merge of every entity, unless something was merged into it in a
    later round: then it lives again, and its own merge is over."""
    last = lineage.groupBy("entity_id").agg(F.max_by("into", "round").alias("into"), F.max("round").alias("round"))
    taken = lineage.groupBy(F.col("into").alias("entity_id")).agg(F.max("round").alias("taken"))
    alive = F.col("taken").isNotNull() & (F.col("taken") > F.col("round"))
    return last.join(taken, "entity_id", "left").filter(~alive).select("entity_id", "into")


def survivors(lineage: DataFrame) -> DataFrame:
    """(entity_id, survivor, steps): where the merges of each entity end, and over how many."""
    now = materialize(pointers(lineage).select("entity_id", F.col("into").alias("survivor"), F.lit(1).cast("long").alias("steps")), "lineage")
    while True:
        ahead = now.select(F.col("entity_id").alias("survivor"), F.col("survivor").alias("beyond"), F.col("steps").alias("more"))
        joined = now.join(ahead, "survivor", "left")
        moved = materialize(
            joined.select("entity_id", F.coalesce("beyond", "survivor").alias("survivor"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("beyond").isNotNull().alias("moved")),
            "lineage",
        )
        discard(now)
        now = moved.drop("moved")
        now._stored_at = moved._stored_at
        if moved.filter("moved").isEmpty():
            return now


def lead(edges: DataFrame, lineage: DataFrame, clean: bool = False) -> DataFrame:
    """Edges with both ends at the last survivors; ``clean`` as in ``resolution.repoint``."""
    return repoint(edges, survivors(lineage).select("entity_id", "survivor"), clean)
