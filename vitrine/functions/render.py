"""A table of text in box-drawing characters."""

from __future__ import annotations

import pyarrow as pa

from vitrine.functions.cells import format_cell

#: The widths of columns, and that of row numbers.
LEAST, MOST, NUMBERS = 4, 32, 3


def cut(text: str, width: int) -> str:
    return text if len(text) <= width else text[: width - 1] + "…"


def render(table: pa.Table, kinds: list[pa.DataType] | None = None) -> str:
    """kinds: the types in the file. Row numbers are those in the result, from 1. Headers are shown whole."""
    if not table.num_columns:
        return f"Preview: {table.num_rows} rows × 0 columns\n(no columns)\n"
    kinds = kinds or list(table.schema.types)
    cells = [[format_cell(table.column(i), row, kind=kinds[i]) for row in range(table.num_rows)] for i in range(table.num_columns)]
    first = max(NUMBERS, len(str(table.num_rows)))
    widths = [min(MOST, max(LEAST, len(name), *map(len, column), 0)) for name, column in zip(table.column_names, cells, strict=True)]

    def border(left: str, middle: str, right: str) -> str:
        return left + middle.join("─" * (w + 2) for w in (first, *widths)) + right

    def line(values: list[str]) -> str:
        return "│" + "│".join(f" {v} " for v in values) + "│"

    shown = [f"Preview: {table.num_rows} rows × {table.num_columns} columns", border("┌", "┬", "┐")]
    shown.append(line(["#".rjust(first), *(name.ljust(w) for name, w in zip(table.column_names, widths, strict=True))]))
    shown.append(border("├", "┼", "┤"))
    for row in range(table.num_rows):
        shown.append(line([str(row + 1).rjust(first), *(cut(column[row], w).ljust(w) for column, w in zip(cells, widths, strict=True))]))
    shown.append(border("└", "┴", "┘"))
    return "\n".join(shown) + "\n"
