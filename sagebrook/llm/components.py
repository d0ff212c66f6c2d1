"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations by node that combine before the shuffle and two joins that
Spark may split where a node is hot; no neighbour list is ever gathered.  The rounds end with
the first whose edges are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NARROW_ROWS, discard, materialize

#: More rounds than any graph needs: the method ends after O(log n) of them.
MAX_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether ``edges`` (u, v) are stars: every u has one v, and no v is a u."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("to"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.node").agg(
        F.min("e.to").alias("lo"), F.max("e.to").alias("hi"), F.max(F.col("e.to").isNull()).alias("below")
    )
    return nodes.filter("lo < hi or (lo is not null and below)").count() == 0


def _round(edges: DataFrame, few: bool) -> DataFrame:
    """A large star and a small star.  ``few``: the least neighbours of all nodes may be
    sent to every executor, which spares the shuffles of the edges."""
    # Few rows need no more tasks and files than there are cores, whatever the number of shuffle partitions.
    cores = edges.sparkSession.sparkContext.defaultParallelism

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df.coalesce(cores)) if few else df

    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Both stars have a row for each edge at most, so one distinct at the end will do.
    down = both.filter(F.col("v") > F.col("u")).join(sent(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(sent(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = hung.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
    return out.coalesce(cores) if few else out


def stars(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v), a stored table: the least node v reachable from every other node u of ``edges`` (u, v).

    Self-links and repeated links change nothing; null ends are ignored; without links the
    result is empty.
    """
    now = materialize(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u is not null and v is not null and u <> v"),
        name,
    )
    n = now.count()
    for _ in range(MAX_ROUNDS if n else 0):
        before, now = now, materialize(_round(now, 2 * n <= NARROW_ROWS), name)
        discard(before)
        if _settled(now):
            break
    else:
        if n:
            raise RuntimeError("components did not settle")
    return now


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the least node reachable from every node of ``edges`` (u, v)."""
    rooted = stars(edges, name).select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = rooted.select(F.col("component").alias("node"), "component").distinct()
    return rooted.union(roots)
