"""Filtered, paged listings and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given."""
    out = F.lit(True)
    for condition in conditions:
        if condition is not None:
            out = out & condition
    return out


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + limit in an order that ends in a unique key."""
    return df.orderBy(*order).offset(offset).limit(limit)


def list_entities(entities: DataFrame, type_: str | None = None, name: str | None = None, state: str = "TRUSTED", min_confidence: float = 0.0) -> DataFrame:
    named = None if name is None else contains(F.col("extracted_text"), F.lit(name)) | contains(F.col("source_sentence"), F.lit(name))
    return entities.filter(
        all_of(
            F.col("lifecycle_state") == state,
            F.col("confidence") >= min_confidence,
            None if type_ is None else F.col("entity_type") == type_,
            named,
        )
    )


def by_confidence(key: str) -> list[Column]:
    return [F.col("confidence").desc(), F.col(key)]


def display_name(prefix: str = "") -> Column:
    return F.coalesce(f"{prefix}extracted_text", f"{prefix}source_sentence", F.lit(""))


def with_endpoints(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the names, types and states of both ends; dangling edges are left out."""

    def side(prefix: str) -> DataFrame:
        return entities.select(
            F.col("entity_id").alias(f"{prefix}_entity_id"),
            display_name().alias(f"{prefix}_name"),
            F.col("entity_type").alias(f"{prefix}_type"),
            F.col("lifecycle_state").alias(f"{prefix}_state"),
        )

    return edges.join(side("source"), "source_entity_id").join(side("target"), "target_entity_id")


def list_relationships(edges: DataFrame, entities: DataFrame, source_type: str | None = None, target_type: str | None = None, relationship_type: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    """Edges in any state whose ends exist."""
    joined = with_endpoints(edges.filter(F.col("confidence") >= min_confidence), entities)
    return joined.filter(
        all_of(
            None if source_type is None else F.col("source_type") == source_type,
            None if target_type is None else F.col("target_type") == target_type,
            None if relationship_type is None else F.col("relationship_type") == relationship_type,
        )
    )


def list_chunks(chunks: DataFrame, query: str | None = None, title: str | None = None, doc_type: str | None = None) -> DataFrame:
    matched = None if query is None else contains(F.col("chunk_text"), F.lit(query)) | contains(F.col("document_title"), F.lit(query))
    return chunks.filter(
        all_of(
            matched,
            None if title is None else contains(F.col("document_title"), F.lit(title)),
            None if doc_type is None else F.col("document_type") == doc_type,
        )
    )


def document_chunks(chunks: DataFrame, document_id: str) -> DataFrame:
    return chunks.filter(F.col("document_id") == document_id).orderBy("chunk_index")


def entity(entities: DataFrame, entity_id: str) -> DataFrame:
    return entities.filter(F.col("entity_id") == entity_id)


def neighbours(edges: DataFrame, entities: DataFrame, entity_id: str) -> DataFrame:
    """Edges at either end of an entity, with names."""
    touching = edges.filter((F.col("source_entity_id") == entity_id) | (F.col("target_entity_id") == entity_id))
    return with_endpoints(touching, entities)


def state_counts(df: DataFrame) -> DataFrame:
    """One row: total, trusted, staging, archived."""
    def state(name: str) -> Column:
        return F.count_if(F.col("lifecycle_state") == name)

    return df.agg(
        F.count(F.lit(1)).alias("total"), state("TRUSTED").alias("trusted"), state("STAGING").alias("staging"), state("ARCHIVED").alias("archived")
    )


def stats(**tables: DataFrame) -> DataFrame:
    """(metric, value): counts of every table, states of entities, distinct documents."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([], "metric string, value long")
    for name, df in tables.items():
        if name == "entities":
            counts = state_counts(df)
            pairs = F.array(*[F.struct(F.lit(f"entities_{c}").alias("metric"), F.col(c).cast("long").alias("value")) for c in counts.columns])
            out = out.unionByName(counts.select(F.explode(pairs).alias("p")).select("p.metric", "p.value"))
        else:
            out = out.unionByName(df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value"))
        if name == "chunks":
            out = out.unionByName(df.agg(F.countDistinct("document_id").alias("value")).select(F.lit("documents").alias("metric"), "value"))
    return out


def staging_summary(entities: DataFrame, edges: DataFrame, document_id: str) -> DataFrame:
    """Staged entities and edges of one document, counted by type."""
    def counts(df: DataFrame, kind: str, column: str) -> DataFrame:
        staged = df.filter((F.col("source_document_id") == document_id) & (F.col("lifecycle_state") == "STAGING"))
        return staged.groupBy(F.col(column).alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "type", "n")

    return counts(entities, "entity", "entity_type").unionByName(counts(edges, "edge", "relationship_type"))


def staging_sample(entities: DataFrame, document_id: str, n: int = 10) -> DataFrame:
    staged = entities.filter((F.col("source_document_id") == document_id) & (F.col("lifecycle_state") == "STAGING"))
    return staged.orderBy(*by_confidence("entity_id")).limit(n)
