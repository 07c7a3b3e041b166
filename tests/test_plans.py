import math
import struct

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from vitrine.errors import ViewError
from vitrine.plans.predicate import NUMBER, FilterExpr, might_match, unquoted
from vitrine.plans.projection import Projection, parse_columns
from vitrine.plans.window import RowWindow
from vitrine.sources.footer import MOST_ROWS, DatasetMetadata


def test_projection():
    assert Projection.all(3).indexes == (0, 1, 2)
    assert Projection.columns([], 3).indexes == (0, 1, 2)
    assert Projection.columns([2, 0], 3).indexes == (2, 0)
    assert Projection.columns([2, 0], 3).file_order == (0, 2)
    assert Projection.columns([2, 0], 3) != Projection.columns([0, 2], 3)
    for bad in ([3], [1, 1], [-1]):
        with pytest.raises(ViewError):
            Projection.columns(bad, 3)


def test_parse_columns():
    assert parse_columns(None, 2).indexes == (0, 1)
    assert parse_columns(" 1 , +0", 2).indexes == (1, 0)
    for bad in ("", "1,", ",1", "a", "-1", "1.0", "2", "0,0", "²"):
        with pytest.raises(ViewError):
            parse_columns(bad, 2)


def test_windows_and_pages():
    assert [RowWindow.for_page(i, 10_000) for i in range(3)] == [RowWindow(0, 4096), RowWindow(4096, 4096), RowWindow(8192, 1808)]
    assert RowWindow.for_page(2, 8192) == RowWindow(8192, 0)
    assert RowWindow(4, 9).clipped(6) == RowWindow(4, 2)
    assert RowWindow(6, 1).clipped(6) == RowWindow(6, 0)
    with pytest.raises(ViewError):
        RowWindow(7, 1).clipped(6)
    with pytest.raises(ViewError):
        RowWindow(-1, 1).clipped(6)


def test_row_groups():
    m = DatasetMetadata.build(pa.schema([]), [3, 0, 4])
    assert [g.first_row for g in m.row_groups] == [0, 3, 3] and m.row_count == 7
    assert m.row_group_for_row(3).index == 2 and m.row_group_for_row(7) is None and m.row_group_for_row(-1) is None
    assert m.overlapping(0, 5) == [0, 1, 2] and m.overlapping(3, 1) == [2]
    m = DatasetMetadata.build(pa.schema([]), [3, 4, 5])
    assert m.overlapping(2, 6) == [0, 1, 2] and m.overlapping(3, 4) == [1] and m.overlapping(12, 1) == []
    with pytest.raises(ViewError):
        DatasetMetadata.build(pa.schema([]), [MOST_ROWS, 1])


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('name contains "abc"', ("name", "contains", "abc")),
        ("0 >= 42", ("0", ">=", "42")),
        ("0<=42", ("0", "<=", "42")),
        ("0 == 42", ("0", "==", "42")),
        ("0 != '4'", ("0", "!=", "4")),
        (" 0 > 42 ", ("0", ">", "42")),
        ("0 < 42", ("0", "<", "42")),
        ('s == "a contains b"', ('s == "a', "contains", 'b"')),
        ('s > "a==b"', ('s > "a', "==", 'b"')),
        ("x ==", ("x", "==", "")),
    ],
)
def test_parse_filter(text, expected):
    e = FilterExpr.parse(text)
    assert (e.column, e.op, e.value) == expected


@pytest.mark.parametrize("text", ["", "  ", "abc", "a = 1", "name contains", "name CONTAINS a"])
def test_parse_filter_fails(text):
    with pytest.raises(ViewError):
        FilterExpr.parse(text)


def test_resolve_and_unquote():
    names = ["x", "X", "0", "x"]
    assert FilterExpr("x", "==", "").column_index(names) == 0
    assert FilterExpr("X", "==", "").column_index(names) == 1
    assert FilterExpr("0", "==", "").column_index(names) == 0
    for bad in ("4", "y"):
        with pytest.raises(ViewError):
            FilterExpr(bad, "==", "").column_index(names)
    assert [unquoted(x) for x in ('"a"', "'a'", "\"a'", '"', "''", '""a""')] == ["a", "a", "\"a'", '"', "", '"a"']


def test_numbers():
    assert all(NUMBER.fullmatch(x) for x in ("1e3", ".5", "5.", "+1", "-1", "inf", "-Infinity", "NaN", "1E-2"))
    assert not any(NUMBER.fullmatch(x) for x in ("", " 1", "1_000", "0x1", "5d", "1e", ".", "e1", "١"))


def test_statistics():
    for text, expected in (("x == 10", True), ("x > 19", True), ("x != 9", True), ("x == 9", False), ("x > 20", False), ("x contains 1", True), ("x == what", True)):
        assert might_match(FilterExpr.parse(text), pa.int32(), 10, 20) is expected
    assert might_match(FilterExpr.parse("x != 1"), pa.float64(), 1.0, 1.0)  # NaN may be there
    assert not might_match(FilterExpr.parse("x == false"), pa.bool_(), True, True)
    assert not might_match(FilterExpr.parse("x < a"), pa.string(), "b", "c")
    assert might_match(FilterExpr.parse("x == 1"), pa.int32(), None, None)


@given(st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False, allow_infinity=False).filter(lambda v: abs(v) < 2**53), st.sampled_from(["==", "!=", "<", "<=", ">", ">="]))
def test_integer_rule_is_the_float_rule(number, literal, op):
    """The comparisons of longs that the predicate compiler uses instead of floats give the same answers."""
    test = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    expected = test[op](struct.unpack("d", struct.pack("d", float(number)))[0], literal)
    whole = math.floor(literal)
    if whole == literal:
        assert test[op](number, whole) == expected
    elif op in ("==", "!="):
        assert (op == "!=") == expected
    else:
        assert (number > whole if op in (">", ">=") else number <= whole) == expected
