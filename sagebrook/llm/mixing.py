"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within each source.  What a source still needs after
whole passes over it is first shared out in proportion to those counts; the remainder, which
no longer depends on the size of the corpus, is fitted by bounded-knapsack dynamic programming
over what may still be added and what may be taken back.  The documents of a length are then
taken in the order of a seeded hash.

Only (source, length, count) rows are grouped: as many as there are distinct lengths.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel
from .common import batched, materialize, table

#: Weights of the sources in the order of their names, repeated.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and how often a document may be taken.
SHARE = 1.5
REPEATS = 2
SEED = 17
#: Lengths, the shortest ones, that are tried before all.
FIRST = 256
#: Bits of all sets of sums of one source at most.
BITS = 1 << 32


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) of (source, source_size): shares by weight, none above
    ``repeats`` times its source; what is above goes to the others by weight.

    The targets are min(cap, level * weight) for the one level at which they add up.
    """
    cap = F.col("source_size") * F.lit(float(repeats))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    all_ = Window.partitionBy()
    rows = sizes.withColumn("weight", weight).withColumn("cap", cap)
    rows = rows.withColumn("total", F.sum("source_size").over(all_) * F.lit(float(share)))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    after = by_need.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after),
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    # Levels fit from the right source on and fall after it: the greatest that fits is it.
    rows = rows.withColumn("level", F.max(fits).over(all_))
    return rows.select(
        "source",
        "source_size",
        F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"),
    )


def _reach(lengths: list[int], counts: list[int], most: int) -> list[int]:
    """Bit sets of the sums up to ``most`` of the first 0, 1, ... lengths, each up to its count.
    A count is split in binary, so a length takes as many shifts as its count has digits."""
    mask, out = (1 << (most + 1)) - 1, [1]
    for length, count in zip(lengths, counts):
        sums, left, step = out[-1], min(count, most // length), 1
        while left > 0:
            step = min(step, left)
            sums |= sums << (step * length) & mask
            left, step = left - step, step * 2
        out.append(sums)
    return out


def _taken(reach: list[int], lengths: list[int], sum_: int) -> list[int]:
    """How many of each length make up a sum that ``reach`` has."""
    out = [0] * len(lengths)
    for i in range(len(lengths) - 1, -1, -1):
        while not reach[i] >> sum_ & 1:
            sum_ -= lengths[i]
            out[i] += 1
    return out


def _nearest(more: int, less: int, gap: int, way: int, within: int) -> int | None:
    """The least e >= 0, up to ``within``, for which a sum of ``more`` and one of ``less`` differ by
    gap + way * e.  Bits are smeared over doubled widths, then the width is halved down."""

    def meet(low: int, width: int) -> bool:
        # Some e with low <= e < low + width: smear the sums of ``more``, then compare.
        at = gap + low if way > 0 else gap - low - width + 1
        smeared, have = more, 1
        while have < width:
            step = min(have, width - have)
            smeared, have = smeared | smeared >> step, have + step
        return bool((smeared >> at if at >= 0 else more_left(smeared, more, -at, width)) & less)

    def more_left(smeared: int, plain: int, shift: int, width: int) -> int:
        # Sums of ``more`` below zero's place are smeared to the left before the shift.
        out, have = plain << shift, 1
        while have < width:
            step = min(have, width - have)
            out, have = out | out >> step, have + step
        return out

    low, width = 0, 1
    while not meet(low, width):
        low, width = low + width, width * 2
        if low > within:
            return None
    while width > 1:
        width //= 2
        low = low if meet(low, width) else low + width
    return low if low <= within else None


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many items of each length to take for a sum as near to ``budget`` as possible, below it
    at equal distance.

    Lengths are divided by their common divisor.  The budget is shared out in proportion to the
    counts, then longest first.  What is still missing is settled by bounded-knapsack dynamic
    programming over what may be added and what may be taken back: sums of either kind are bit
    sets, first up to a few of the longest lengths, then up to more, until the nearest sum there
    can be is found or sums reach twice the square of the longest length, beyond which no better
    one needs to look.  Only if that takes over ``BITS`` bits for all lengths is the best one found
    before taken: documents of many different lengths of which none fits, and tens of thousands of
    words long.
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    total = int((lengths * counts).sum())
    taken = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return counts.copy()
    there = np.flatnonzero((counts > 0) & (lengths > 0))
    unit = int(np.gcd.reduce(lengths[there]))
    sizes, have = (lengths[there] // unit).tolist(), counts[there].tolist()
    wanted, over = divmod(budget, unit)
    whole = total // unit
    took = [c * wanted // whole for c in have]
    gap = wanted - sum(n * t for n, t in zip(sizes, took))
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        more = min(have[i] - took[i], gap // sizes[i])
        took[i] += more
        gap -= more * sizes[i]
    longest = max(sizes)
    farthest = min(whole, 2 * longest * longest + gap)
    # The shortest lengths nearly always hit the budget; if not, all lengths are tried.
    by_size = sorted(range(len(sizes)), key=lambda i: sizes[i])
    used, most = by_size[:FIRST], 0
    while True:
        n = [sizes[i] for i in used]
        most = min(farthest, most * 8 or 8 * n[-1] + gap)
        more = _reach(n, [have[i] - took[i] for i in used], most)
        less = _reach(n, [took[i] for i in used], most)
        # Sums at or under the budget miss it by ``over`` and whole units, those above by the rest.
        down = _nearest(more[-1], less[-1], gap, -1, gap)
        up = _nearest(more[-1], less[-1], gap + 1, 1, down)
        if down == 0 and (over * 2 <= unit or up == 0):
            break
        if len(used) < len(sizes):
            following = by_size, 0
        elif most < farthest:
            following = by_size, most
        else:
            break
        if len(sizes) * (following[1] * 8 or 8 * longest + gap) > BITS:
            break
        used, most = following
    near = up is None or down * unit + over <= (up + 1) * unit - over
    aim = gap - down if near else gap + 1 + up
    both = more[-1] >> aim & less[-1] if aim >= 0 else more[-1] << -aim & less[-1]
    back = (both & -both).bit_length() - 1
    added, removed = _taken(more, n, back + aim), _taken(less, n, back)
    for i, x, y in zip(used, added, removed):
        took[i] += x - y
    taken[there] = took
    return taken


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    """The takes of one source's lengths: ``passes`` for all, one more for ``extra`` of them."""
    group = group.sort_values("size", kind="stable").reset_index(drop=True)
    budget, whole = int(round(float(group["target"].iloc[0]))), int(group["source_size"].iloc[0])
    passes = min(budget // whole, REPEATS) if whole else 0
    extra = fill(group["size"].to_numpy(), group["n"].to_numpy(), budget - passes * whole) if passes < REPEATS else 0
    return pd.DataFrame({"sid": group["sid"], "size": group["size"], "n": group["n"], "passes": passes, "extra": extra})


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(kernel.count_words(batch.column(2))), batch.column(3)],
        names=["doc_id", "source", "size", "h"],
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, seed: int = SEED, name: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``.

    A size is the number of words (runs of non-spaces), 0 for a null or empty text; such rows
    are never taken.  A null source is a source of its own, last in order.  Null and repeated
    doc_ids are documents like any other; equal rows are interchangeable.  A document is
    taken 0, 1 or 2 times (``taken`` counts words).  Other columns are ignored; an empty
    table gives an empty result.
    """
    measured = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("text").cast("string").alias("text"),
        # The order in which documents are taken; those without an id are interchangeable.
        F.when(F.col("doc_id").isNull(), F.floor(F.rand(seed) * 2**53)).otherwise(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed))).alias("h"),
    )
    sized = materialize(batched(measured, _measure, "doc_id long, source string, size long, h long"), f"{name}-sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(by_source, weights, share).withColumn(
        "sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")
    )
    wanted = materialize(wanted, f"{name}-targets")
    known = wanted.select(F.col("source").alias("__source"), "sid", "source_size", "target")
    placed = sized.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("source", "__source")

    counts = sized.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(known, F.col("source").eqNullSafe(F.col("__source"))).select("sid", "size", "n", "source_size", "target")
    plan = counts.groupBy("sid").applyInPandas(_plan, "sid long, size long, n long, passes long, extra long")
    plan = materialize(plan, f"{name}-plan")

    rows = placed.join(plan, ["sid", "size"], "left")
    some = "extra > 0 and extra < n"
    # A length with many documents is dealt out by about the square root of their number of
    # hash ranges: whole ranges first, then documents of the range where the take ends.
    ranged = F.expr("pmod(h, 1048576L) * shiftleft(1L, cast(ceil(log2(n) / 2) as int))")
    rows = rows.withColumn("b", F.when(F.expr(some), F.floor(ranged / F.lit(1048576)).cast("long")))
    split = rows.filter(some).select("sid", "size", "extra", "b", "h", "doc_id")
    per = split.groupBy("sid", "size", "b").agg(F.count(F.lit(1)).alias("m"), F.max("extra").alias("extra"))
    run = Window.partitionBy("sid", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("m").over(run), F.lit(0))).select(
        "sid", "size", "b", F.greatest(F.least(F.col("extra") - F.col("before"), "m"), F.lit(0)).alias("quota")
    )
    rows = rows.join(per, ["sid", "size", "b"], "left")
    within = Window.partitionBy("sid", "size", "b", F.when(F.expr(some), F.lit(0)).otherwise(F.col("h")), "quota").orderBy("h", "doc_id")
    place = F.row_number().over(within)
    once_more = F.when(F.expr(some), (place <= F.col("quota")).cast("long")).otherwise(
        F.when(F.col("extra") > 0, F.lit(1)).otherwise(F.lit(0))
    )
    return rows.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.coalesce("passes", F.lit(0)) + once_more)).cast("long").alias("taken"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(table(spark, sf_dir, "documents"))
