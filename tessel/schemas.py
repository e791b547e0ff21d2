"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "array<float>": T.ArrayType(T.FloatType()),
}


def _struct(fields: str) -> T.StructType:
    """A schema from ``name kind`` pairs; needs no session, unlike the DDL parser."""
    pairs = (f.rsplit(" ", 1) for f in fields.split(", "))
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


VECTORS = _struct(
    "namespace string, project_id string, chunk_id string, file_path string, chunk_type string, symbol_name string, "
    "line_number int, content string, metadata string, embedding array<float>, created_at timestamp"
)
JOBS = _struct(
    "job_id string, namespace string, project_id string, filename string, status string, source string, owner string, repo string, "
    "ref string, total_vectors int, persist_dir string, embedder string, webhook_url string, error string, created_at timestamp, "
    "updated_at timestamp"
)
INDEX_META = _struct(
    "namespace string, project_id string, embedder string, model string, embedding_dim int, use_cloud boolean, "
    "created_at timestamp, updated_at timestamp"
)
PROJECTS = _struct(
    "id string, name string, namespace string, description string, github_owner string, github_repo string, github_ref string, "
    "created_at string, updated_at string"
)
