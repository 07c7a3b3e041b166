"""Cells as bounded text: of Arrow values on the driver, and as Columns for whole DataFrames.

Text depends on the type in the file (signs, units, time zones), which Spark's types don't keep."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.shipping import pickled_by_value

LIMIT = 1024
NULL = "null"
#: The short names of timestamp units, and types' names where a value isn't shown.
UNITS = {"s": "s", "ms": "ms", "us": "us", "ns": "ns"}
_NAMES = {"halffloat": "Float16", "bool": "Boolean", "float": "Float32", "double": "Float64", "string": "Utf8", "large_string": "LargeUtf8", "string_view": "Utf8View", "binary": "Binary", "large_binary": "LargeBinary", "binary_view": "BinaryView", "date32[day]": "Date32", "date64[ms]": "Date64", "null": "Null"}
_UNIT_NAMES = {"s": "Second", "ms": "Millisecond", "us": "Microsecond", "ns": "Nanosecond"}


def type_name(kind: pa.DataType) -> str:
    t = pa.types
    if t.is_integer(kind):
        return str(kind).replace("uint", "UInt").replace("int", "Int") if str(kind).startswith("u") else str(kind).replace("int", "Int")
    if t.is_timestamp(kind):
        zone = f'Some("{kind.tz}")' if kind.tz else "None"
        return f"Timestamp({_UNIT_NAMES[kind.unit]}, {zone})"
    if t.is_time32(kind) or t.is_time64(kind):
        return f"Time{32 if t.is_time32(kind) else 64}({_UNIT_NAMES[kind.unit]})"
    if t.is_duration(kind):
        return f"Duration({_UNIT_NAMES[kind.unit]})"
    if t.is_decimal(kind):
        return f"Decimal{kind.bit_width}({kind.precision}, {kind.scale})"
    if t.is_fixed_size_binary(kind):
        return f"FixedSizeBinary({kind.byte_width})"
    if t.is_dictionary(kind):
        return f"Dictionary({type_name(kind.index_type)}, {type_name(kind.value_type)})"
    if t.is_list(kind) or t.is_large_list(kind):
        return f"{'Large' if t.is_large_list(kind) else ''}List({type_name(kind.value_type)})"
    if t.is_struct(kind):
        return "Struct(" + ", ".join(f'"{f.name}": {type_name(f.type)}' for f in kind) + ")"
    if t.is_map(kind):
        return f"Map({type_name(kind.key_type)}, {type_name(kind.item_type)})"
    return _NAMES.get(str(kind), str(kind))


def truncated(text: str, limit: int = LIMIT) -> str:
    """At most limit UTF-8 bytes, cut between characters, with three dots if something was cut."""
    data = text.encode(errors="surrogatepass")
    return text if len(data) <= limit else data[:limit].decode(errors="ignore") + "..."


def float_text(value: float, kind: pa.DataType) -> str:
    """The shortest digits that give the value back, never with an exponent."""
    if np.isnan(value):
        return "NaN"
    number = np.float32(value) if pa.types.is_float32(kind) else np.float64(value)
    return np.format_float_positional(number, unique=True, trim="-")


def format_cell(array: pa.Array | pa.ChunkedArray, row: int, limit: int = LIMIT, kind: pa.DataType | None = None) -> str:
    """kind: the type in the file, if the array's own is what Spark made of it."""
    if not 0 <= row < len(array):
        return NULL
    t, kind, scalar = pa.types, kind or array.type, array[row]
    if t.is_null(kind):
        return type_name(kind)
    if not scalar.is_valid:
        return NULL
    value_kind = scalar.type
    if t.is_boolean(kind):
        return "true" if scalar.as_py() else "false"
    if t.is_integer(kind):
        return str(int(scalar.as_py()))
    if t.is_float32(kind) or t.is_float64(kind):
        return float_text(scalar.as_py(), kind)
    if t.is_string(kind) or t.is_large_string(kind):
        return truncated(scalar.as_py(), limit)
    if t.is_binary(kind) or t.is_large_binary(kind):
        data = scalar.as_py()
        return data[: limit // 2].hex() + ("..." if len(data) > limit // 2 else "")
    if t.is_date32(kind):
        return f"date32:{scalar.cast(pa.int32()).as_py()}"
    if t.is_date64(kind):
        ms = scalar.cast(pa.int32()).as_py() * 86_400_000 if t.is_date32(value_kind) else scalar.cast(pa.int64()).as_py()
        return f"date64_ms:{ms}"
    if t.is_timestamp(kind):
        raw = scalar.cast(pa.int64()).as_py()
        if t.is_timestamp(value_kind) and value_kind.unit == "us":
            raw = raw // {"s": 1_000_000, "ms": 1000, "us": 1, "ns": 1}[kind.unit]
        return f"timestamp_{UNITS[kind.unit]}:{raw} {kind.tz or 'UTC'}"
    return type_name(kind)


def format_column(column: Column, kind: pa.DataType, limit: int = LIMIT) -> Column:
    """The same for a whole column. All but floats and texts that are cut is built in."""
    t = pa.types
    if t.is_boolean(kind) or t.is_integer(kind):
        text = column.cast("string")
    elif t.is_float32(kind) or t.is_float64(kind):
        single = t.is_float32(kind)
        pickled_by_value("vitrine.functions")
        text = F.pandas_udf(lambda s: s.map(lambda v: None if v is None else float_text(v, pa.float32() if single else pa.float64())), "string")(F.when(F.isnan(column), None).otherwise(column))
        text = F.when(F.isnan(column), "NaN").when(column.isNotNull(), text)
    elif t.is_string(kind) or t.is_large_string(kind):
        # the longest run of whole characters that fits is found from the bytes: at most three of them belong to a character that is cut
        data = column.cast("binary")
        cuts = []
        for back in range(3):
            byte = F.conv(F.hex(F.substring(data, limit + 1 - back, 1)), 16, 10).cast("int")
            cuts.append(F.when((byte < 128) | (byte >= 192), F.lit(limit - back)))
        cut = F.coalesce(*cuts, F.lit(limit - 3))
        text = F.when(F.octet_length(column) <= limit, column).otherwise(F.concat(F.decode(F.substring(data, F.lit(1), cut), "UTF-8"), F.lit("...")))
    elif t.is_binary(kind) or t.is_large_binary(kind):
        text = F.concat(F.lower(F.hex(F.substring(column, 1, limit // 2))), F.when(F.octet_length(column) > limit // 2, "...").otherwise(""))
    elif t.is_date32(kind):
        text = F.concat(F.lit("date32:"), F.unix_date(column).cast("string"))
    elif t.is_date64(kind):
        text = F.concat(F.lit("date64_ms:"), (F.unix_date(column).cast("long") * 86_400_000).cast("string"))
    elif t.is_timestamp(kind):
        raw = column
        if kind.unit != "ns":
            since = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'") if not kind.tz else F.expr("timestamp'1970-01-01 00:00:00Z'"), column)
            raw = F.floor(since / {"s": 1_000_000, "ms": 1000, "us": 1}[kind.unit]) if kind.unit != "us" else since
        text = F.concat(F.lit(f"timestamp_{UNITS[kind.unit]}:"), raw.cast("string"), F.lit(f" {kind.tz or 'UTC'}"))
    else:
        text = F.when(column.isNotNull(), type_name(kind))
    return F.coalesce(text, F.lit(NULL))
