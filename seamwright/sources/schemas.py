"""Schemas of the domain tables: explicit, never inferred, columns only ever added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = {
    "projects": "id string, repo_url string, owner string, repo string, default_branch string, repository_revision string, source_type string, source_location string, source_identity string, status string, primary_language string, frameworks_json string, analysis_json string, error_message string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "repo_files": "id long, project_id string, path string, extension string, language string, size long, content string, summary string, importance double, is_core boolean, imports_json string, exports_json string, symbols_json string",
    "code_chunks": "id long, project_id string, repository_revision string, language string, path string, chunk_type string, symbol_name string, qualified_name string, parent_symbol string, start_line int, end_line int, content string, content_hash string, created_at timestamp_ntz",
    "code_chunk_embeddings": "id long, code_chunk_id long, content_hash string, embedding_input_hash string, model_name string, model_revision string, identity_schema_version string, wrapper_model_identity string, resolved_revision string, identity_eligible boolean, text_format_version string, embedding_config_hash string, embedding_dimension int, embedding_dtype string, normalized boolean, vector_blob binary, created_at timestamp_ntz, updated_at timestamp_ntz",
    "learning_events": "event_id string, idempotency_key string, learner_id string, project_id string, repository_id string, repository_revision string, goal_id string, plan_id string, step_id string, target_id string, task_id string, attempt_id string, evaluation_id string, event_type string, provenance string, validated_outcome_json string, event_order long, state_update_rule_version int, schema_version int, created_at timestamp_ntz",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def conformed(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the columns of a table in their order: missing ones null, others dropped, types cast."""
    want = schema(table)
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
