"""One event as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The largest integer a JSON reader with double numbers keeps exactly.
MAX_SAFE = 2**53 - 1


def _safe(value: Column) -> Column:
    big = F.abs(value.cast("decimal(20,0)")) > MAX_SAFE
    return F.when(big, value.cast("string").cast("variant")).otherwise(value.cast("variant"))


def _view(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(kind, T.LongType):
        return _safe(value)
    if isinstance(kind, T.StructType):
        fields = [_view(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _view(v, kind.elementType))
    return value


def json_text(schema: T.StructType, fields: list[str] | None = None) -> Column:
    """The present fields of a row: bytes as hex, integers past 2**53 - 1 as text."""
    wanted = [f for f in schema.fields if fields is None or f.name in fields]
    return F.to_json(F.struct(*[_view(F.col(f.name), f.dataType).alias(f.name) for f in wanted]))


def event_json(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    return df.withColumn("json", json_text(df.schema, fields))
