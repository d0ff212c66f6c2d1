"""Working memory and cache: keyed state with expiry, at an explicit moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.text import query_hash, stable_id

VALUES = ("value", "agent", "step_number", "expires_at")


def upsert(writes: DataFrame, stored: DataFrame | None = None, keep_seq: bool = False) -> DataFrame:
    """State after writes (session_id, key, value, agent, step_number, created_at, expires_at,
    seq): the last write's values, the first one's time of creation.

    With ``keep_seq`` the state also has ``seq`` and ``first_seq``, so that a write that comes
    late finds its place; a stored state without them is before every write.
    """
    columns = ["session_id", "key", *VALUES, "created_at"]
    rows = writes.select(*columns, "seq", F.col("seq").alias("first_seq"))
    if stored is not None:
        known = [F.col(c) if c in stored.columns else F.lit(-1).cast("long").alias(c) for c in ("seq", "first_seq")]
        rows = stored.select(*columns, *known).unionByName(rows)
    out = merged(rows)
    return out if keep_seq else out.drop("seq", "first_seq")


def merged(rows: DataFrame) -> DataFrame:
    """One row a key of states and writes (..., seq, first_seq), in any order and grouping."""
    return (
        rows.groupBy("session_id", "key")
        .agg(
            F.max_by(F.struct(*VALUES), "seq").alias("v"),
            F.min_by("created_at", "first_seq").alias("created_at"),
            F.max("seq").alias("seq"),
            F.min("first_seq").alias("first_seq"),
        )
        .select("session_id", "key", "v.*", "created_at", "seq", "first_seq")
    )


def live(state: DataFrame, as_of: Column) -> DataFrame:
    """What has not expired."""
    return state.filter(F.col("expires_at") > as_of)


def get(state: DataFrame, session_id: str, key: str, as_of: Column) -> DataFrame:
    return live(state, as_of).filter((F.col("session_id") == session_id) & (F.col("key") == key))


def get_all(state: DataFrame, session_id: str, as_of: Column) -> DataFrame:
    return live(state, as_of).filter(F.col("session_id") == session_id).orderBy("step_number", "created_at", "key")


def delete(state: DataFrame, session_id: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with how many went) of a key or a whole session."""
    hit = F.col("session_id") == session_id
    if key is not None:
        hit = hit & (F.col("key") == key)
    hit = F.coalesce(hit, F.lit(False))
    return state.filter(~hit), state.agg(F.count_if(hit).alias("deleted"))


def cleanup(state: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with how many went) when what expired before ``as_of`` goes."""
    old = F.coalesce(F.col("expires_at") < as_of, F.lit(False))
    return state.filter(~old), state.agg(F.count_if(old).alias("deleted"))


def cache_put(entries: DataFrame, as_of: Column, ttl_seconds: int = CONFIG.cache_ttl_seconds) -> DataFrame:
    """Cache rows of entries (query_text, response_json, confidence, query_embedding)."""
    return entries.select(
        stable_id(query_hash(F.col("query_text")), as_of.cast("string")).alias("id"),
        "query_text",
        query_hash(F.col("query_text")).alias("query_hash"),
        "query_embedding",
        "response_json",
        "confidence",
        as_of.alias("created_at"),
        (as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds))).alias("expires_at"),
    )
