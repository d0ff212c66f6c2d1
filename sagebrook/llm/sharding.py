"""Placement of documents on shards through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table: a start
and a step taken from its name.  Shards take turns claiming the first free slot of their
order until the table is full, so shares differ by at most one slot and adding or removing a
shard moves few slots.  The table has a fixed number of rows; it is broadcast, and a document
finds its shard by the hash of its id in constant time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHARDS = 16
#: A prime, well over 100 times the number of shards; the bound of what is broadcast.
SLOTS = 65537


def _number(name: str, salt: str) -> int:
    return int(hashlib.sha256(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (position in ``names``) of every slot."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need distinct names")
    if slots < len(names) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table's size must be a prime and no less than the number of shards")
    at = [_number(n, "start") % slots for n in names]
    step = [_number(n, "step") % (slots - 1) + 1 for n in names]
    owner = [-1] * slots
    free = slots
    while True:
        for i in range(len(names)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                return owner


def slot_of(column: Column, slots: int = SLOTS) -> Column:
    """The slot of an id; a missing one counts as the empty string."""
    digest = F.md5(F.coalesce(column.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def shard_names(shards: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(shards)]


def place(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with columns slot (long) and shard (int) added.

    Rows with equal ids, nulls among them, share a shard.  Columns of these names that are
    already there are replaced; an empty table gives an empty result.  Only ids are hashed,
    so texts of any length, or missing, make no difference.
    """
    spark = docs.sparkSession
    owners = lookup_table(shard_names(shards), slots)
    lookup = spark.createDataFrame(list(enumerate(owners)), "slot long, shard int")
    kept = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    # Numbered, so that no name of theirs is one of the lookup's.
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], slot_of(F.col(f"`{id_col}`"), slots).alias("slot"))
    placed = rows.join(F.broadcast(lookup), "slot").select(*[f"c{i}" for i in range(len(kept))], "slot", "shard")
    return placed.toDF(*kept, "slot", "shard")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return place(table(spark, sf_dir, "documents").select("doc_id"))


def op10_sql(shards: int = SHARDS, slots: int = SLOTS) -> str:
    """The same placement, with the table spelt as a string of one letter a slot."""
    letters = "".join(chr(97 + s) for s in lookup_table(shard_names(shards), slots))
    slot = f"CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {slots}"
    return (
        f"SELECT doc_id, slot, CAST(ascii(substr('{letters}', CAST(slot + 1 AS INTEGER), 1)) - 97 AS INTEGER) AS shard "
        f"FROM (SELECT doc_id, {slot} AS slot FROM documents)"
    )
