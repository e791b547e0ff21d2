"""Metadata of chunks as JSON text, and scalar codecs for stores that take no lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

LIST_FIELDS = ("params", "calls", "called_by", "external_calls", "depends_on", "imported_by")


def encode(row: Column) -> Column:
    """A struct as JSON text; null fields are left out."""
    return F.to_json(row)


def field(metadata: Column, name: str) -> Column:
    """A text field of JSON metadata; null for null, malformed and cut-off JSON and missing fields."""
    return F.try_variant_get(F.try_parse_json(metadata), f"$.{name}", "string")


def flat(rows: DataFrame) -> DataFrame:
    """Scalar metadata: lists as JSON (``[]`` if empty or null), nulls as empty text, the rest as text."""
    def one(name: str, kind: DataType) -> Column:
        if isinstance(kind, ArrayType):
            return F.coalesce(F.to_json(F.col(name)), F.lit("[]")).alias(name)
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    return rows.select(*(one(f.name, f.dataType) for f in rows.schema.fields))


def restored(rows: DataFrame, *list_fields: str) -> DataFrame:
    """List fields parsed again; malformed JSON gives an empty list."""
    none = F.array().cast("array<string>")
    fields = list_fields or tuple(c for c in LIST_FIELDS if c in rows.columns)
    return rows.withColumns({c: F.coalesce(F.from_json(c, "array<string>"), none) for c in fields})
