"""The engine's tables as StructTypes, and checks of their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATES = ("STAGING", "TRUSTED", "ARCHIVED")
JUDGMENTS = ("correct", "incorrect", "partial", "uncertain")
SEVERITIES = ("critical", "major", "minor")


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


DDL = {
    "entities": """entity_id string, entity_type string, lifecycle_state string, confidence double,
        source_document_id string, source_section string, source_sentence string, source_span_start int,
        source_span_end int, extracted_text string, extraction_method string, extraction_confidence double,
        created_at timestamp_ntz, updated_at timestamp_ntz, promoted_at timestamp_ntz, archived_at timestamp_ntz,
        last_accessed timestamp_ntz, access_count int, conflicts array<struct<merged_into:string,reason:string>>,
        resolved boolean""",
    "edges": """relationship_id string, source_entity_id string, target_entity_id string, relationship_type string,
        lifecycle_state string, confidence double, source_document_id string, source_sentence string,
        created_at timestamp_ntz, updated_at timestamp_ntz""",
    "chunks": """id string, document_id string, document_type string, document_title string, chunk_text string,
        chunk_index int, embedding array<float>, entity_ids array<string>, created_at timestamp_ntz,
        last_accessed timestamp_ntz, access_count int""",
    "sessions": """id string, session_id string, query_text string, response_text string, context_bundle_id string,
        accessed_entities array<string>, created_at timestamp_ntz, expires_at timestamp_ntz, latency_ms int,
        success boolean""",
    "rules": """id string, rule_name string, rule_type string, rule_expression string, rule_description string,
        priority int, enabled boolean, applies_to_entity_types array<string>,
        applies_to_relationship_types array<string>, times_applied int, times_violated int,
        last_applied timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz""",
    "feedback": """id string, bundle_id string, query_text string, response_text string, judgment string,
        error_type string, human_correction string, severity string, confidence_was double,
        entities_involved array<string>, rules_applied array<string>, processed boolean, learning_action string,
        created_at timestamp_ntz, processed_at timestamp_ntz""",
    "learning_log": """cycle_date date, feedback_count int, promoted_count int, demoted_count int, archived_count int,
        rule_count int, calibration_error double, confidence_buckets map<string,struct<predicted:double,actual:double>>,
        threshold_adjustments string, patterns_identified string, recommendations array<string>""",
    "bundles": """id string, query_text string, session_id string, overall_confidence double, recommendation string,
        high_confidence_facts int, medium_confidence_facts int, low_confidence_facts int,
        low_confidence_items array<struct<fact:string,confidence:double>>, uncertainty_reasons array<string>""",
    "responses": """id string, bundle_id string, answer string, confidence double, confidence_level string,
        evidence_chain array<struct<fact:string,source:map<string,string>,confidence:double>>,
        rules_checked array<string>, rules_passed boolean, validation_failures string, alternatives string,
        total_latency_ms int""",
    "cache": """id string, query_text string, query_hash string, query_embedding array<float>, response_json string,
        confidence double, created_at timestamp_ntz, expires_at timestamp_ntz""",
    "working_memory": """id string, session_id string, key string, value string, agent string, step_number int,
        created_at timestamp_ntz, expires_at timestamp_ntz""",
    "wiki_pages": """id string, entity_type string, title string, markdown string, entity_ids array<string>,
        source_document_ids array<string>, confidence_avg double, created_at timestamp_ntz, updated_at timestamp_ntz""",
}


def schema(table: str) -> T.StructType:
    return _struct(DDL[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table, cast to its types; absent ones are null."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)]
    )


def valid(table: str) -> Column:
    """Whether a row satisfies the table's value checks."""
    unit = F.col("confidence").between(0.0, 1.0)
    if table in ("entities", "edges"):
        return unit & F.col("lifecycle_state").isin(*STATES)
    if table == "feedback":
        severity = F.col("severity").isNull() | F.col("severity").isin(*SEVERITIES)
        return F.col("judgment").isin(*JUDGMENTS) & severity
    return F.lit(True)
