"""Inserts and snapshots: new rows by key, errors apart, replacement as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_new(stored: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """Stored rows and those of ``rows`` whose key is not there; a key repeated in ``rows``
    enters once."""
    fresh = rows.dropDuplicates(list(key)).join(stored.select(*key).distinct(), list(key), "left_anti")
    return stored.unionByName(fresh.select(*[c for c in stored.columns if c in fresh.columns]), allowMissingColumns=True)


def insert_entities(stored: DataFrame, rows: DataFrame, as_of: Column) -> DataFrame:
    """Loaded entities (entity_id, entity_type, name) enter as staged, nearly certain."""
    new = rows.select(
        "entity_id", "entity_type", F.lit("STAGING").alias("lifecycle_state"), F.lit(0.95).alias("confidence"), F.col("name").alias("source_sentence"), as_of.alias("created_at")
    )
    return insert_new(stored, new, "entity_id")


def insert_edges(stored: DataFrame, entities: DataFrame, rows: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(edges, errors): loaded edges with both ends in ``entities`` enter, others are errors."""
    ids = entities.select("entity_id").distinct()
    a = ids.select(F.col("entity_id").alias("source_entity_id"))
    b = ids.select(F.col("entity_id").alias("target_entity_id"))
    whole = rows.join(a, "source_entity_id", "left_semi").join(b, "target_entity_id", "left_semi")
    errors = rows.join(whole.select("relationship_id"), "relationship_id", "left_anti").withColumn("error", F.lit("an end does not exist"))
    new = whole.withColumns({"lifecycle_state": F.lit("STAGING"), "confidence": F.lit(0.95), "created_at": as_of})
    return insert_new(stored, new, "relationship_id"), errors


def insert_rules(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Rules by name, enabled, with their expression as JSON."""
    new = rows.withColumn("rule_expression", F.to_json(F.struct(F.col("condition")))).withColumns(
        {"enabled": F.lit(True), "times_applied": F.lit(0), "times_violated": F.lit(0)}
    )
    return insert_new(stored, new, "rule_name")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _files(spark: SparkSession, path: str):
    """(file system, path, path of the snapshot before it) of a snapshot."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    at = make(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at, make(f"{path}.old")


def snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The snapshot at ``path``, or None where there has never been one.

    Where a writer stopped between its two renames, the snapshot before it is put back.  A
    snapshot that cannot be read is an error, never taken for a missing one.
    """
    fs, at, old = _files(spark, path)
    if not fs.exists(at):
        if not fs.exists(old):
            return None
        if not fs.rename(old, at):
            raise OSError(f"{path}.old could not be put back")
    return spark.read.parquet(path)


def swap(df: DataFrame, path: str) -> None:
    """Replace a snapshot as a whole: written beside it, then put in its place by two renames.

    One writer at a time.  If it is stopped between the renames, ``snapshot`` finds the one
    before; ``df`` may read the snapshot that it replaces.
    """
    fresh = f"{path}.{uuid.uuid4().hex}.new"
    df.write.parquet(fresh)
    fs, at, old = _files(df.sparkSession, path)
    if fs.exists(at):
        fs.delete(old, True)
        if not fs.rename(at, old):
            raise OSError(f"{path} could not be moved aside")
    if not fs.rename(df.sparkSession._jvm.org.apache.hadoop.fs.Path(fresh), at):
        raise OSError(f"{fresh} could not be put in place")
    fs.delete(old, True)


def truncate(spark: SparkSession, path: str, confirm: bool = False) -> None:
    """Empty a snapshot; asks to be meant."""
    if not confirm:
        raise ValueError("truncation needs confirm=True")
    stored = snapshot(spark, path)
    if stored is not None:
        swap(stored.limit(0), path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def store_response(bundles: DataFrame, answers: DataFrame, bundle_path: str, response_path: str, as_of: Column) -> None:
    """Append the contexts of questions and their answers, joined by ids that depend on the
    question and the moment."""
    key = F.md5(F.concat_ws("|", F.col("query_id").cast("string"), as_of.cast("string")))
    append(bundles.withColumns({"id": key, "created_at": as_of}), bundle_path)
    append(answers.withColumns({"bundle_id": key, "created_at": as_of}), response_path)


def store_turn(turns: DataFrame, path: str, as_of: Column, ttl_days: int = 30) -> None:
    """Append session turns (session_id, query_text, response_text) with their expiry."""
    append(turns.withColumns({"created_at": as_of, "expires_at": as_of + F.make_dt_interval(F.lit(ttl_days))}), path)
