"""What Parquet footers say: schema, rows, row groups. Nothing else of a file is read."""

from __future__ import annotations

import bisect
import itertools
import pickle
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from vitrine.errors import ViewError
from vitrine.shipping import pickled_by_value

#: Row counts are unsigned 64-bit numbers.
MOST_ROWS = (1 << 64) - 1


@dataclass(frozen=True)
class RowGroup:
    index: int
    first_row: int
    row_count: int

    @property
    def end(self) -> int:
        return self.first_row + self.row_count


@dataclass(frozen=True)
class FilePart:
    """A file's place among all rows, and which of its row groups are which of all."""

    path: str
    first_row: int
    row_count: int
    first_group: int
    group_count: int


@dataclass(frozen=True)
class DatasetMetadata:
    schema: pa.Schema
    row_groups: tuple[RowGroup, ...]
    row_count: int

    @classmethod
    def build(cls, schema: pa.Schema, counts: list[int]) -> DatasetMetadata:
        """counts: the rows of each group; empty ones keep their place."""
        ends = list(itertools.accumulate(counts, initial=0))
        if ends[-1] > MOST_ROWS:
            raise ViewError("the row counts of the groups overflow")
        return cls(schema, tuple(RowGroup(i, first, n) for i, (first, n) in enumerate(zip(ends, counts, strict=False))), ends[-1])

    @property
    def column_count(self) -> int:
        return len(self.schema)

    def row_group_for_row(self, row: int) -> RowGroup | None:
        if not 0 <= row < self.row_count:
            return None
        # of groups that start at the same row, all but the last are empty
        return self.row_groups[bisect.bisect_right(self.row_groups, row, key=lambda g: g.first_row) - 1]

    def overlapping(self, first_row: int, row_count: int) -> list[int]:
        """Groups that a window touches. An empty group counts if the window holds rows on both its sides."""
        first = bisect.bisect_right(self.row_groups, first_row, key=lambda g: g.end)
        return list(range(first, max(first, bisect.bisect_left(self.row_groups, first_row + row_count, key=lambda g: g.first_row))))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(g.index, g.first_row, g.row_count) for g in self.row_groups], "index int, first_row long, row_count long")


#: More footers than this are read by a Spark job instead of the driver's threads.
MOST_FOOTERS = 256


def opened(path: str) -> pq.ParquetFile:
    """A file by its path, or by a URI of any file system that there is a client for."""
    if "://" in path:
        system, inner = pafs.FileSystem.from_uri(path)
        return pq.ParquetFile(inner, filesystem=system)
    return pq.ParquetFile(path)


def _files(path: str) -> list[str]:
    """A file itself, or the Parquet files of a folder by name: paths of local files, URIs of others."""
    try:
        system, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        before = "" if isinstance(system, pafs.LocalFileSystem) else path[: len(path.rstrip("/")) - len(inner.rstrip("/"))] if path.rstrip("/").endswith(inner.rstrip("/")) else path.split("://")[0] + "://"
        info = system.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise ViewError(f"{path} cannot be opened: there is no such file")
        if info.type == pafs.FileType.File:
            return [before + inner]
        found = system.get_file_info(pafs.FileSelector(inner, recursive=True))
    except (OSError, pa.ArrowException) as e:
        raise ViewError(f"{path} cannot be opened: {e}") from e
    files = sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))
    if not files:
        raise ViewError(f"{path} cannot be opened: it has no Parquet file")
    return [before + f for f in files]


def footer(file: str) -> tuple[pa.Schema, list[int]]:
    """Schema and rows of each group."""
    try:
        with opened(file) as found:
            return found.schema_arrow, [found.metadata.row_group(i).num_rows for i in range(found.metadata.num_row_groups)]
    except (OSError, pa.ArrowException) as e:
        raise ViewError(f"the footer of {file} cannot be read: {e}") from e


def group_ranges(file: str, column: str) -> list[tuple[object, object]]:
    """The least and the largest value of a column in each group, None where statistics don't say or columns are inside others."""
    with opened(file) as found:
        names, metadata = found.schema_arrow.names, found.metadata
        flat = metadata.num_columns == len(names)
        ranges = []
        for i in range(metadata.num_row_groups):
            stats = metadata.row_group(i).column(names.index(column)).statistics if flat else None
            ranges.append((stats.min, stats.max) if stats is not None and stats.has_min_max else (None, None))
        return ranges


def each_file(spark: SparkSession, files: list[str], f: Callable) -> list:
    """f of each file, in order: by threads, or of many files by a job."""
    if len(files) <= MOST_FOOTERS:
        with ThreadPoolExecutor(min(32, len(files))) as pool:
            return list(pool.map(f, files))
    pickled_by_value("vitrine.errors", "vitrine.plans", "vitrine.sources", "vitrine.sources.footer")

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            yield pa.RecordBatch.from_arrays([batch["number"], pa.array([pickle.dumps(f(x)) for x in batch["file"].to_pylist()], pa.binary())], names=["number", "found"])

    tasks = -(-len(files) // MOST_FOOTERS)
    rows = spark.createDataFrame(list(enumerate(files)), "number long, file string").repartition(tasks).mapInArrow(run, "number long, found binary")
    return [pickle.loads(r["found"]) for r in sorted(rows.collect(), key=lambda r: r["number"])]


def same_columns(a: pa.Schema, b: pa.Schema) -> bool:
    """Whether two files have the same columns: in the same order, or of names that are told apart in another one."""
    kinds = [[(f.name, f.type) for f in x] for x in (a, b)]
    return kinds[0] == kinds[1] or len(set(a.names)) == len(a.names) and sorted(kinds[0], key=str) == sorted(kinds[1], key=str)


def read_footers(spark: SparkSession, path: str) -> tuple[DatasetMetadata, list[FilePart]]:
    """Several files make one dataset, in the order of their names, with the columns as the first one has them. Files with other columns are an error."""
    files = _files(path)
    footers = each_file(spark, files, footer)
    schema = footers[0][0]
    parts, row, group = [], 0, 0
    for file, (own, counts) in zip(files, footers, strict=True):
        if not same_columns(schema, own):
            raise ViewError(f"{file} has other columns than {files[0]}")
        parts.append(FilePart(file, row, sum(counts), group, len(counts)))
        row, group = row + sum(counts), group + len(counts)
    return DatasetMetadata.build(schema, [n for _, counts in footers for n in counts]), parts
