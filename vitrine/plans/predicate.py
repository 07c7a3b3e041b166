"""Predicates on one column: text to expression, expression to a Column that Catalyst can push down.

Numbers compare as 64-bit floats under IEEE rules (NaN is unequal to all, itself included, and in no order), nulls never
match. Where a comparison of integers gives the same answer it is used instead, as only that is pushed down to the scan."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.errors import ViewError

#: The operators in the order in which they are looked for.
OPERATORS = ("==", "!=", ">=", "<=", ">", "<")
CONTAINS = "contains"
#: Fixed value: what is a number.
NUMBER = re.compile(r"[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)", re.IGNORECASE | re.ASCII)


@dataclass(frozen=True)
class FilterExpr:
    column: str
    op: str
    value: str

    @classmethod
    def parse(cls, text: str) -> FilterExpr:
        text = text.strip()
        if not text:
            raise ViewError("the filter is empty")
        for needle in (f" {CONTAINS} ", *OPERATORS):
            column, found, value = text.partition(needle)
            if found:
                return cls(column.strip(), needle.strip(), unquoted(value.strip()))
        raise ViewError(f"the filter has no operator that is known: {text}")

    def column_index(self, names: list[str]) -> int:
        """An unsigned number is an index, whatever columns are called; other text is the name of the first column that has it."""
        if re.fullmatch(r"\+?[0-9]+", self.column):
            if int(self.column) >= len(names):
                raise ViewError(f"filter column {self.column} is out of range: there are {len(names)} columns")
            return int(self.column)
        if self.column not in names:
            raise ViewError(f"there is no column {self.column!r}")
        return names.index(self.column)

    def condition(self, column: Column, kind: pa.DataType) -> Column:
        """For a where clause, which drops nulls too. kind: the column's type in the file."""
        if pa.types.is_boolean(kind):
            return self._boolean(column)
        if pa.types.is_integer(kind):
            return self._integer(column, kind)
        if pa.types.is_float32(kind) or pa.types.is_float64(kind):
            return self._float(column.cast("double"))
        if pa.types.is_string(kind) or pa.types.is_large_string(kind):
            return column.contains(self.value) if self.op == CONTAINS else compared(column, self.op, F.lit(self.value))
        raise ViewError(f"filtering is not supported for {kind} columns")

    def _boolean(self, column: Column) -> Column:
        if self.op not in ("==", "!="):
            raise ViewError(f"{self.op} doesn't apply to booleans")
        if self.value not in ("true", "false"):
            raise ViewError(f"{self.value!r} is neither true nor false")
        return compared(column, self.op, F.lit(self.value == "true"))

    def number(self) -> float:
        if self.op == CONTAINS:
            raise ViewError("contains doesn't apply to numbers")
        if not NUMBER.fullmatch(self.value):
            raise ViewError(f"{self.value!r} is not a number")
        return float(self.value)

    def _integer(self, column: Column, kind: pa.DataType) -> Column:
        value = self.number()
        if math.isnan(value):
            return column.isNotNull() if self.op == "!=" else F.lit(False)
        if math.isinf(value) or abs(value) >= 2**53 or kind == pa.uint64():
            return compared(column.cast("double"), self.op, F.lit(value))
        whole = math.floor(value)
        if whole == value:
            return compared(column, self.op, F.lit(whole))
        if self.op in ("==", "!="):
            return F.lit(False) if self.op == "==" else column.isNotNull()
        return column > whole if self.op in (">", ">=") else column <= whole

    def _float(self, column: Column) -> Column:
        value = self.number()
        if math.isnan(value):
            return column.isNotNull() if self.op == "!=" else F.lit(False)
        found = compared(column, self.op, F.lit(value))
        if self.op == "!=":
            return found | F.isnan(column)
        return found if self.op in ("<", "<=") else found & ~F.isnan(column)


def compared(a: Column, op: str, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def unquoted(value: str) -> str:
    """Without one pair of matching quotes around it."""
    return value[1:-1] if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'" else value


def might_match(expr: FilterExpr, kind: pa.DataType, low: object, high: object) -> bool:
    """Whether values between low and high can match, None if not known: what a scan decides by itself for each row group. NaN counts as possible."""
    if low is None or high is None or expr.op == CONTAINS:
        return True
    if pa.types.is_boolean(kind):
        if expr.value not in ("true", "false") or expr.op not in ("==", "!="):
            return True
        value: object = expr.value == "true"
    elif pa.types.is_string(kind) or pa.types.is_large_string(kind):
        value = expr.value.encode()
        low, high = (x.encode() if isinstance(x, str) else x for x in (low, high))
    elif pa.types.is_integer(kind) or pa.types.is_floating(kind):
        if not NUMBER.fullmatch(expr.value):
            return True
        value, low, high = float(expr.value), float(low), float(high)  # type: ignore[arg-type]
        if math.isnan(value):
            return expr.op == "!="
    else:
        return True
    if expr.op == "!=":
        return pa.types.is_floating(kind) or not low == high == value
    return {"==": low <= value <= high, ">": high > value, ">=": high >= value, "<": low < value, "<=": low <= value}[expr.op]  # type: ignore[operator]
