"""Bounded neighbourhoods in the graph of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..sources.stored import materialize
from .places import numbered


#: Seeds that share a word of bits.
WORD = 64
#: Neighbours of a node that may share its place with others.
TWIN_NEIGHBOURS = 64


def _both_ways(edges: DataFrame, state: str | None) -> DataFrame:
    used = edges if state is None else edges.filter(F.col("lifecycle_state") == state)
    one = used.select(F.col("source_entity_id").alias("entity_id"), F.col("target_entity_id").alias("next"))
    return one.unionByName(one.select(F.col("next").alias("entity_id"), F.col("entity_id").alias("next")))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int = CONFIG.max_hops, state: str | None = "TRUSTED") -> DataFrame:
    """(seed, entity_id, hop): what is reached from each seed (entity_id) over edges in either
    direction, at the least number of hops.

    Seeds are numbered, and what 64 of them have reached is one word of bits a node: a hop joins
    the words of the frontier with the edges and takes the bits of a node together, so that a hub
    is expanded once for 64 seeds.  Bits that a node has already leave the frontier.  Frontiers are
    written as tables; only the result has a row a seed.
    """
    both = _both_ways(edges, state)
    distinct = seeds.select("entity_id").distinct()
    known = materialize(numbered(distinct.withColumn("__all", F.lit(0)), ["__all"], [F.col("entity_id")], "seeds").select(F.col("entity_id").alias("seed"), "pos"), "seeds")
    bit = F.expr(f"shiftleft(1L, cast(pos % {WORD} as int))")
    start = known.select(F.col("seed").alias("entity_id"), F.expr(f"pos div {WORD}").alias("word"), bit.alias("bits"))
    frontier = materialize(start.withColumn("hop", F.lit(0)), "frontier")
    reached = frontier
    for hop in range(1, hops + 1):
        step = frontier.select("entity_id", "word", "bits").join(both, "entity_id").groupBy(F.col("next").alias("entity_id"), "word").agg(F.bit_or("bits").alias("bits"))
        seen = reached.groupBy("entity_id", "word").agg(F.bit_or("bits").alias("seen"))
        fresh = step.join(seen, ["entity_id", "word"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0)))))
        frontier = materialize(fresh.filter("bits <> 0").select("entity_id", "word", "bits", F.lit(hop).alias("hop")), "frontier")
        reached = reached.unionByName(frontier)
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("bits", i) == 1)
    rows = reached.select("entity_id", "hop", "word", F.explode(places).alias("bit")).withColumn("pos", F.col("word") * WORD + F.col("bit"))
    return rows.join(known, "pos").select("seed", "entity_id", "hop")


def _classes(edges: DataFrame, seeds: DataFrame, state: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with the same few neighbours are one class: stored (entity_id, class) of all nodes of edges and
    of ``seeds``, (class, n) with its nodes, and (entity_id, next) between classes, in either direction."""
    both = materialize(_both_ways(edges, state).filter("entity_id <> next").distinct(), "neighbours")
    degrees = both.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    few = degrees.filter(F.col("n") <= TWIN_NEIGHBOURS).select("entity_id")
    lists = both.join(few, "entity_id", "left_semi").groupBy("entity_id").agg(F.array_sort(F.collect_list("next")).alias("all"))
    led = lists.groupBy("all").agg(F.min("entity_id").alias("class"))
    twins = lists.join(led, "all").select("entity_id", "class")
    nodes = degrees.select("entity_id").union(seeds.select("entity_id").filter("entity_id is not null")).distinct()
    of = materialize(nodes.join(twins, "entity_id", "left").select("entity_id", F.coalesce("class", "entity_id").alias("class")), "classes")
    sizes = materialize(of.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class-sizes")
    # All nodes of a class have the neighbours of its first.
    led = both.join(sizes.select(F.col("class").alias("entity_id")), "entity_id", "left_semi")
    between = led.join(of.withColumnRenamed("entity_id", "next"), "next").select("entity_id", F.col("class").alias("next")).distinct()
    return of, sizes, materialize(between, "class-edges")


def k_hop_counts(edges: DataFrame, seeds: DataFrame, hops: int = CONFIG.max_hops, state: str | None = "TRUSTED") -> DataFrame:
    """(seed, hop, n): how many nodes ``k_hop`` reaches from each seed at each hop.

    Nodes with the same neighbours are reached at the same hops by all others, and reach the same ones, so
    the search is over classes of them, which count as many nodes as they have; the others of a seed's
    own class are two hops away, over any neighbour.  An edge that lacks an end is none here.
    """
    of, sizes, between = _classes(edges, seeds, state)
    asked = of.join(seeds.select("entity_id").distinct(), "entity_id", "left_semi")
    found = k_hop(between.select(F.col("entity_id").alias("source_entity_id"), F.col("next").alias("target_entity_id")), asked.select(F.col("class").alias("entity_id")), hops, None)
    others = found.filter("hop > 0").join(sizes, found["entity_id"] == sizes["class"]).select(F.col("seed").alias("class"), "hop", "n")
    if hops >= 2:
        own = sizes.filter("n > 1").select("class", F.lit(2).alias("hop"), (F.col("n") - 1).alias("n"))
        others = others.unionByName(own.join(asked.select("class").distinct(), "class", "left_semi"))
    counted = others.groupBy("class", "hop").agg(F.sum("n").alias("n"))
    self_ = asked.select(F.col("entity_id").alias("seed"), F.lit(0).alias("hop"), F.lit(1).cast("long").alias("n"))
    return self_.unionByName(asked.join(counted, "class").select(F.col("entity_id").alias("seed"), "hop", "n"))
