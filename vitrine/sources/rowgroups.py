"""A data source that reads the row groups a window touches and no others: a partition for each.

Spark's own scan applies conditions on row positions after decoding; here the cost of a window is that of its
groups, wherever in the dataset it is."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType

from vitrine.plans.window import RowWindow
from vitrine.shipping import pickled_by_value
from vitrine.sources.footer import DatasetMetadata, FilePart, opened
from vitrine.sources.types import as_plain, plain_schema, spark_schema

#: The column with a row's place in the dataset.
POSITION = "__position"
NAME = "vitrine_rowgroups"


@dataclass
class GroupPartition(InputPartition):
    path: str
    group: int
    first_row: int
    skip: int
    take: int


def group_partitions(metadata: DatasetMetadata, parts: list[FilePart], window: RowWindow) -> list[GroupPartition]:
    found, at = [], 0
    for index in metadata.overlapping(window.first_row, window.row_count) if window.row_count else []:
        group = metadata.row_groups[index]
        skip = max(0, window.first_row - group.first_row)
        take = min(group.end, window.end) - group.first_row - skip
        while at + 1 < len(parts) and parts[at + 1].first_group <= index:
            at += 1
        if take > 0:
            found.append(GroupPartition(parts[at].path, index - parts[at].first_group, group.first_row, skip, take))
    return found


class RowGroupReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.parts = [GroupPartition(*p) for p in json.loads(options["groups"])]
        self.columns, self.names = json.loads(options["columns"]), json.loads(options["names"])

    def partitions(self) -> list[GroupPartition]:
        return self.parts or [GroupPartition("", -1, 0, 0, 0)]

    def read(self, partition: GroupPartition) -> Iterator[pa.RecordBatch]:
        if partition.group < 0:
            return
        with opened(partition.path) as file:
            schema = file.schema_arrow
            # a file of a folder may have its columns in another order
            places = self.columns if schema.names == self.names else [schema.names.index(self.names[i]) for i in self.columns]
            wanted = pa.schema([schema.field(i) for i in places])
            target = plain_schema(wanted)
            at, end = 0, partition.skip + partition.take
            for batch in file.iter_batches(row_groups=[partition.group], columns=[schema.field(i).name for i in places] or [schema.field(0).name]):
                first, last = max(at, partition.skip), min(at + len(batch), end)
                if first < last:
                    cut = batch.slice(first - at, last - first)
                    columns = as_plain(cut.select(list(wanted.names)), target)
                    place = pa.array(range(partition.first_row + first, partition.first_row + last), pa.int64())
                    yield pa.RecordBatch.from_arrays([*columns, place], names=[*target.names, POSITION])
                at += len(batch)
                if at >= end:
                    return


class RowGroupSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> RowGroupReader:
        return RowGroupReader(dict(self.options))


def read_groups(spark: SparkSession, metadata: DatasetMetadata, parts: list[FilePart], window: RowWindow, columns: tuple[int, ...]) -> DataFrame:
    """The window's rows, in the order of the columns, with POSITION."""
    pickled_by_value("vitrine.errors", "vitrine.plans", "vitrine.sources")
    spark.dataSource.register(RowGroupSource)
    schema = spark_schema(pa.schema([metadata.schema.field(i) for i in columns]))
    groups = [[p.path, p.group, p.first_row, p.skip, p.take] for p in group_partitions(metadata, parts, window)]
    whole = StructType([*schema.fields, StructField(POSITION, LongType())])
    return spark.read.format(NAME).schema(whole).option("groups", json.dumps(groups)).option("columns", json.dumps(list(columns))).option("names", json.dumps(metadata.schema.names)).load()
