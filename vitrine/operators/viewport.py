"""A Parquet dataset as something to look into: windows of rows in file order, pages, and filtered windows.

A row's position is its place in its file, after those of the files before. Windows read the row groups they touch;
filtered windows are a scan with the predicate pushed down, ordered by position."""

from __future__ import annotations

import bisect
import functools
import itertools
from collections.abc import Sequence
from threading import Lock

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrine.errors import ViewError
from vitrine.operators.pagecache import DataPage, PageCache, PageCacheLimits, PageKey
from vitrine.plans.predicate import FilterExpr, might_match
from vitrine.plans.projection import Projection
from vitrine.plans.window import FetchRequest, RowWindow
from vitrine.sources.footer import DatasetMetadata, FilePart, RowGroup, each_file, group_ranges, read_footers
from vitrine.sources.rowgroups import POSITION, read_groups
from vitrine.sources.types import loadable, spark_schema

#: Above so many rows to pass over and return, matches are counted by runs of rows first, instead of sorting all that come before.
COUNTED_FROM = 200_000
RUN = 1 << 20
#: Windows of more row groups than this are read by Spark's own scan of the files that they are in.
MOST_GROUPS = 4096


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class ParquetSource:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.metadata, self.parts = read_footers(spark, path)
        self._cache, self._lock = PageCache(), Lock()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ParquetSource:
        return cls(spark, path)

    @property
    def schema(self) -> pa.Schema:
        return self.metadata.schema

    @property
    def row_count(self) -> int:
        return self.metadata.row_count

    @property
    def column_count(self) -> int:
        return self.metadata.column_count

    @property
    def row_groups(self) -> tuple[RowGroup, ...]:
        return self.metadata.row_groups

    def set_cache_limits(self, limits: PageCacheLimits) -> None:
        """A new, empty cache."""
        with self._lock:
            self._cache = PageCache(limits)

    def projection(self, columns: Sequence[int] | Projection | None) -> Projection:
        if isinstance(columns, Projection):
            return columns
        return Projection.columns(list(columns or ()), self.column_count)

    # windows by position

    def window_frame(self, first_row: int, row_count: int, columns: Sequence[int] | Projection | None = None) -> DataFrame:
        """The window as a DataFrame in file order, with its projection."""
        projection = self.projection(columns)
        window = RowWindow(first_row, row_count).clipped(self.row_count)
        if len(self.metadata.overlapping(window.first_row, window.row_count)) > MOST_GROUPS and all(loadable(self.schema.field(i).type) for i in projection.indexes):
            parts = [p for p in self.parts if p.first_row < window.end and p.first_row + p.row_count > window.first_row]
            rows = self.scan(parts).filter((F.col(POSITION) >= window.first_row) & (F.col(POSITION) < window.end))
            rows = rows.select(*(quoted(n) for n in projection.names(self.schema.names)), POSITION)
        else:
            rows = read_groups(self.spark, self.metadata, self.parts, window, projection.indexes)
        return rows.orderBy(POSITION).drop(POSITION)

    def read_window(self, first_row: int, row_count: int, columns: Sequence[int] | Projection | None = None) -> pa.Table:
        return self.window_frame(first_row, row_count, columns).toArrow()

    def fetch(self, request: FetchRequest) -> pa.Table:
        return self.read_window(request.first_row, request.row_count, request.projection)

    def head(self, rows: int) -> pa.Table:
        return self.read_window(0, rows)

    def read_page(self, page: int, columns: Sequence[int] | Projection | None = None) -> DataPage:
        """A page of PAGE_ROWS rows, from the cache if it is there. To ask for a page past the end is an error, for one at the end not."""
        key = PageKey(page, self.projection(columns))
        with self._lock:
            if held := self._cache.get(key):
                return held
        window = RowWindow.for_page(page, self.row_count)
        found = DataPage.of(key, window, self.read_window(window.first_row, window.row_count, key.projection))
        with self._lock:
            self._cache.insert(found)
        return found

    # scans

    def scan(self, parts: list[FilePart] | None = None) -> DataFrame:
        """All columns that Spark's reader has a type for, and POSITION, of all files or of some."""
        parts = parts or self.parts
        fields = [f for f in self.schema if loadable(f.type)]
        if len({f.name.lower() for f in fields}) < len(fields):
            self.spark.conf.set("spark.sql.caseSensitive", "true")  # else such names can't be told apart
        if any(pa.types.is_timestamp(f.type) and f.type.unit == "ns" for f in fields):
            self.spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
        reader = self.spark.read
        if len(fields) < self.column_count:
            reader = reader.schema(StructType(spark_schema(pa.schema(fields)).fields))
        rows = reader.parquet(*(p.path for p in parts))
        place = F.col("_metadata.row_index")
        if len(parts) == 1:
            return rows.select("*", (place + parts[0].first_row).alias(POSITION))
        firsts = self.spark.createDataFrame([(p.path, p.first_row) for p in parts], "__file string, __first long")  # a row per file
        file = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
        return rows.select("*", place.alias("__place"), file.alias("__path")).join(F.broadcast(firsts), F.col("__path") == F.col("__file")).withColumn(POSITION, F.col("__first") + F.col("__place")).drop("__place", "__path", "__file", "__first")

    def matches(self, expr: FilterExpr, columns: Sequence[int] | Projection | None = None, parts: list[FilePart] | None = None) -> DataFrame:
        """All rows that match, projected, with POSITION, of all files or of some. The condition is on the column named, wherever it is in the projection."""
        names = self.schema.names
        projection = self.projection(columns)
        field = self.schema.field(expr.column_index(names))
        condition = expr.condition(quoted(field.name), field.type)
        for i in (*projection.indexes, names.index(field.name)):
            if not loadable(self.schema.field(i).type):
                raise ViewError(f"{names[i]} has a type that filtered windows can't read: {self.schema.field(i).type}")
        return self.scan(parts).filter(condition).select(*(quoted(names[i]) for i in projection.indexes), POSITION)

    def groups_that_might_match(self, expr: FilterExpr) -> list[int]:
        """Row groups that their statistics don't rule out. Without statistics, or with columns inside others, none is."""
        column = expr.column_index(self.schema.names)
        name, kind = self.schema.names[column], self.schema.field(column).type
        ranges = each_file(self.spark, [p.path for p in self.parts], functools.partial(group_ranges, column=name))
        return [p.first_group + g for p, own in zip(self.parts, ranges, strict=True) for g, (low, high) in enumerate(own) if might_match(expr, kind, low, high)]

    def filtered_frame(self, expr: FilterExpr | str, first_match: int, row_count: int, columns: Sequence[int] | Projection | None = None) -> DataFrame:
        expr = FilterExpr.parse(expr) if isinstance(expr, str) else expr
        if row_count == 0:
            projection = self.projection(columns)
            return self.spark.createDataFrame([], spark_schema(pa.schema([self.schema.field(i) for i in projection.indexes])))
        groups = self.groups_that_might_match(expr)
        # files of which no group is left aren't opened; in the others, the scan leaves out groups by the condition pushed down
        ends = [p.first_group + p.group_count for p in self.parts]
        used = sorted({bisect.bisect_right(ends, g) for g in groups})
        found = self.matches(expr, columns, [self.parts[i] for i in used] or self.parts[:1])
        if not groups:
            return found.limit(0).drop(POSITION)
        if first_match + row_count > COUNTED_FROM:
            return self._counted(found, first_match, row_count)
        return found.orderBy(POSITION).offset(first_match).limit(row_count).drop(POSITION)

    def _counted(self, found: DataFrame, first_match: int, row_count: int) -> DataFrame:
        """Counts by runs of positions tell in which of them the window is; only their rows are sorted."""
        run = (F.col(POSITION) / RUN).cast("long")
        counts = sorted((r["run"], r["count"]) for r in found.groupBy(run.alias("run")).count().collect())  # a row per RUN rows
        ends = list(itertools.accumulate(n for _, n in counts))
        inside = [(r, end - n) for (r, n), end in zip(counts, ends, strict=True) if end > first_match and end - n < first_match + row_count]
        if not inside:
            return found.limit(0).drop(POSITION)
        low, high = inside[0][0] * RUN, (inside[-1][0] + 1) * RUN
        near = found.filter((F.col(POSITION) >= low) & (F.col(POSITION) < high))
        return near.orderBy(POSITION).offset(first_match - inside[0][1]).limit(row_count).drop(POSITION)

    def read_filtered_window(self, expr: FilterExpr | str, first_match: int, row_count: int, columns: Sequence[int] | Projection | None = None) -> pa.Table:
        """OFFSET first_match LIMIT row_count over the matches in file order."""
        return self.filtered_frame(expr, first_match, row_count, columns).toArrow()

    def row_group_frame(self) -> DataFrame:
        return self.metadata.frame(self.spark)


__all__ = ["DatasetMetadata", "ParquetSource"]
