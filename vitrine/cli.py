"""python -m vitrine FILE [--head N] [--columns 0,2] [--filter 'x >= 2']: a dataset's layout and a preview."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from vitrine.errors import ViewError
from vitrine.functions.cells import type_name
from vitrine.functions.render import render
from vitrine.operators.viewport import ParquetSource
from vitrine.plans.predicate import FilterExpr
from vitrine.plans.projection import parse_columns

SHOWN_GROUPS = 10


def whole_number(text: str) -> int:
    if not text.isascii() or not text.removeprefix("+").isdigit():
        raise argparse.ArgumentTypeError(f"{text!r} is no number of rows")
    return int(text)


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser("vitrine", description="Shows what is in a Parquet file.")
    parser.add_argument("file")
    parser.add_argument("--head", type=whole_number, default=10, help="rows to show")
    parser.add_argument("--columns", help="indexes of columns, with commas between")
    parser.add_argument("--filter", help="a predicate on one column, such as 'price >= 10'")
    return parser.parse_args(args)


def report(source: ParquetSource) -> str:
    lines = [f"Rows: {source.row_count}", f"Columns: {source.column_count}", f"Row groups: {len(source.row_groups)}", "", "Schema:"]
    lines += [f"{i:>3} {f.name:<20} {type_name(f.type)}" for i, f in enumerate(source.schema)]
    lines += ["", "Row groups:"]
    for g in source.row_groups[:SHOWN_GROUPS]:
        lines.append(f"{g.index:>3} " + (f"rows {g.first_row}..={g.end - 1} ({g.row_count} rows)" if g.row_count else "empty"))
    if len(source.row_groups) > SHOWN_GROUPS:
        lines.append("...")
    return "\n".join(lines) + "\n"


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = arguments(args)
    try:
        spark = spark or SparkSession.builder.appName("vitrine").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        source = ParquetSource.open(spark, given.file)
        projection = parse_columns(given.columns, source.column_count)
        print(report(source))
        if given.filter is not None:
            table = source.read_filtered_window(FilterExpr.parse(given.filter), 0, given.head, projection)
        else:
            table = source.read_window(0, given.head, projection)
        print(render(table, [source.schema.field(i).type for i in projection.indexes]), end="")
    except ViewError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
