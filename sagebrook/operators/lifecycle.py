"""The staged trust lifecycle of entities and edges, as snapshot transforms.

Every mutator returns a new snapshot; changed rows carry ``updated_at`` where the snapshot
has that column and an ``as_of`` is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG, Config


def changed(df: DataFrame, condition: Column, values: dict[str, Column], as_of: Column | None = None) -> DataFrame:
    """``df`` with new values in the rows of a condition, and their update time."""
    hit = F.coalesce(condition, F.lit(False))
    new = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}
    if as_of is not None and "updated_at" in df.columns:
        new["updated_at"] = F.when(hit, as_of).otherwise(F.col("updated_at"))
    return df.withColumns(new)


def _moved(entities: DataFrame, ids: DataFrame, source: str, target: str, as_of: Column | None) -> tuple[DataFrame, DataFrame]:
    wanted = ids.select("entity_id").distinct().withColumn("asked", F.lit(True))
    joined = entities.join(wanted, "entity_id", "left")
    hit = F.col("asked") & (F.col("lifecycle_state") == source)
    out = changed(joined, hit, {"lifecycle_state": F.lit(target)}, as_of).drop("asked")
    found = wanted.join(entities.select("entity_id", "lifecycle_state"), "entity_id", "left")
    status = (
        F.when(F.col("lifecycle_state").isNull(), F.lit("not_found")).when(F.col("lifecycle_state") == source, F.lit("ok")).otherwise(F.lit("wrong_state"))
    )
    return out, found.select("entity_id", status.alias("status"))


def promote(entities: DataFrame, ids: DataFrame, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, status): staged ones of ``ids`` become trusted."""
    return _moved(entities, ids, "STAGING", "TRUSTED", as_of)


def demote(entities: DataFrame, ids: DataFrame, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, status): trusted ones of ``ids`` become archived."""
    return _moved(entities, ids, "TRUSTED", "ARCHIVED", as_of)


def promote_edges(edges: DataFrame, entities: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Staged edges become trusted once both ends are."""
    trusted = entities.filter("lifecycle_state = 'TRUSTED'").select("entity_id").distinct()
    a = trusted.select(F.col("entity_id").alias("source_entity_id"), F.lit(True).alias("a"))
    b = trusted.select(F.col("entity_id").alias("target_entity_id"), F.lit(True).alias("b"))
    joined = edges.join(a, "source_entity_id", "left").join(b, "target_entity_id", "left")
    hit = (F.col("lifecycle_state") == "STAGING") & F.col("a") & F.col("b")
    return changed(joined, hit, {"lifecycle_state": F.lit("TRUSTED")}, as_of).select(*edges.columns)


def promote_all(entities: DataFrame, edges: DataFrame, min_confidence: float = CONFIG.promote_confidence, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Every staged entity that is certain enough becomes trusted, then edges follow."""
    hit = (F.col("lifecycle_state") == "STAGING") & (F.col("confidence") >= min_confidence)
    out = changed(entities, hit, {"lifecycle_state": F.lit("TRUSTED")}, as_of)
    return out, promote_edges(edges, out, as_of)


def evidence(entities: DataFrame, min_confidence: float = CONFIG.evidence_promote_confidence, min_sources: int = CONFIG.min_sources) -> DataFrame:
    """Staged entities with the evidence of their (type, name) group and what follows.

    The group's best confidence and its distinct documents decide for all its members.
    """
    staged = entities.filter("lifecycle_state = 'STAGING'").withColumn(
        "name_key", F.lower(F.coalesce("extracted_text", "source_sentence", F.lit("")))
    )
    document = F.when(F.col("source_document_id") != "", F.col("source_document_id"))
    groups = staged.groupBy("entity_type", "name_key").agg(
        F.max("confidence").alias("best"), F.countDistinct(document).alias("sources"), F.count(F.lit(1)).alias("members")
    )
    decision = (
        F.when(F.col("best") < min_confidence, F.lit("low_confidence")).when(F.col("sources") < min_sources, F.lit("few_sources")).otherwise(F.lit("promote"))
    )
    return staged.join(groups.withColumn("decision", decision), ["entity_type", "name_key"])


def promote_with_evidence(entities: DataFrame, edges: DataFrame, min_confidence: float = CONFIG.evidence_promote_confidence, min_sources: int = CONFIG.min_sources, as_of: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, counts by decision)."""
    decided = evidence(entities, min_confidence, min_sources)
    passed = decided.filter("decision = 'promote'").select("entity_id", F.lit(True).alias("passed"))
    joined = entities.join(passed, "entity_id", "left")
    hit = F.col("passed") & (F.col("lifecycle_state") == "STAGING")
    out = changed(joined, hit, {"lifecycle_state": F.lit("TRUSTED")}, as_of).drop("passed")
    return out, promote_edges(edges, out, as_of), decided.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def duplicate_names(entities: DataFrame, state: str = "TRUSTED") -> DataFrame:
    """(entity_type, name_key, ids, n) of names that occur more than once in a state."""
    named = entities.filter(F.col("lifecycle_state") == state).withColumn("name_key", F.lower(F.coalesce("extracted_text", "source_sentence")))
    return (
        named.groupBy("entity_type", "name_key")
        .agg(F.array_sort(F.collect_list("entity_id")).alias("ids"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )


def conflicts(entities: DataFrame) -> DataFrame:
    """Duplicate names (medium) and unresolved trusted entities (high)."""
    names = duplicate_names(entities).select(
        F.lit("duplicate").alias("kind"), F.lit("medium").alias("severity"), "entity_type", F.concat_ws(",", "ids").alias("entity_ids")
    )
    flagged = entities.filter("lifecycle_state = 'TRUSTED' and not resolved").select(
        F.lit("unresolved").alias("kind"), F.lit("high").alias("severity"), "entity_type", F.col("entity_id").alias("entity_ids")
    )
    return names.unionByName(flagged)


def stale(entities: DataFrame, as_of: Column, config: Config = CONFIG) -> DataFrame:
    """Trusted entities not accessed for long, least used first, a bounded report."""
    old = F.col("last_accessed").isNull() | (F.col("last_accessed") < as_of - F.make_dt_interval(F.lit(config.stale_days)))
    trusted = entities.filter((F.col("lifecycle_state") == "TRUSTED") & old)
    return trusted.orderBy(F.col("access_count"), F.col("last_accessed").asc_nulls_first(), "entity_id").limit(config.stale_rows)
