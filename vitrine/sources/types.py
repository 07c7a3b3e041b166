"""Arrow types of files as types that Spark has."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


def plain_type(kind: pa.DataType) -> pa.DataType:
    """The nearest type that Spark can hold without loss of values; units and signs are in the footer for whoever needs them."""
    t = pa.types
    if t.is_dictionary(kind):
        return plain_type(kind.value_type)
    if t.is_uint8(kind):
        return pa.int16()
    if t.is_uint16(kind):
        return pa.int32()
    if t.is_uint32(kind):
        return pa.int64()
    if t.is_uint64(kind):
        return pa.decimal128(20, 0)
    if t.is_float16(kind):
        return pa.float32()
    if t.is_large_string(kind) or kind == pa.string_view():
        return pa.string()
    if t.is_large_binary(kind) or t.is_fixed_size_binary(kind) or kind == pa.binary_view():
        return pa.binary()
    if t.is_date64(kind):
        return pa.date32()
    if t.is_timestamp(kind):
        return pa.int64() if kind.unit == "ns" else pa.timestamp("us", "UTC" if kind.tz else None)
    if t.is_time(kind) or t.is_duration(kind):
        return pa.int64()
    if t.is_null(kind):
        return pa.int32()
    if t.is_large_list(kind) or t.is_fixed_size_list(kind) or t.is_list(kind):
        return pa.list_(plain_type(kind.value_type))
    if t.is_map(kind):
        return pa.map_(plain_type(kind.key_type), plain_type(kind.item_type))
    if t.is_struct(kind):
        return pa.struct([pa.field(f.name, plain_type(f.type), f.nullable) for f in kind])
    return kind


def plain_schema(schema: pa.Schema) -> pa.Schema:
    return pa.schema([pa.field(f.name, plain_type(f.type), True) for f in schema])


def spark_schema(schema: pa.Schema) -> StructType:
    return from_arrow_schema(plain_schema(schema), prefer_timestamp_ntz=True)


def loadable(kind: pa.DataType) -> bool:
    """Whether Spark's own Parquet reader reads the type."""
    return not (pa.types.is_float16(kind) or pa.types.is_time(kind))


def as_plain(table: pa.Table | pa.RecordBatch, schema: pa.Schema) -> list[pa.Array]:
    found = []
    for column, field in zip(table.columns, schema, strict=True):
        kind = column.type
        if column.type != field.type:
            if pa.types.is_time32(kind):
                column = column.cast(pa.int32())
            column = column.cast(field.type)
        found.append(column)
    return found
