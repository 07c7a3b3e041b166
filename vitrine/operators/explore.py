"""Beyond windows: sorted pages, statistics of columns, data for charts. Each is one pass or two of built-in aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.viewport import ParquetSource, quoted
from vitrine.sources.rowgroups import POSITION


def sorted_page(source: ParquetSource, column: int, offset: int, row_count: int, columns: list[int] | None = None, descending: bool = False) -> DataFrame:
    """Rows in the order of a column, nulls last, equal ones in file order: only offset + row_count rows of each task are kept."""
    names = source.schema.names
    key = quoted(names[column])
    wanted = [quoted(n).alias(f"__{i}") for i, n in enumerate(source.projection(columns).names(names))]
    rows = source.scan().select(*wanted, key.alias("__key"), POSITION)
    order = F.col("__key").desc_nulls_last() if descending else F.col("__key").asc_nulls_last()
    page = rows.orderBy(order, POSITION).offset(offset).limit(row_count)
    return page.select(*(F.col(f"__{i}").alias(n) for i, n in enumerate(source.projection(columns).names(names))))


def column_stats(source: ParquetSource, columns: list[int] | None = None) -> DataFrame:
    """A row per column: count, nulls, smallest, largest (as text), mean, standard deviation, about how many values differ."""
    names = source.projection(columns).names(source.schema.names)
    rows = source.scan().select(*(quoted(n).alias(f"c{i}") for i, n in enumerate(names)))
    numeric = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")}
    ordered = {f.name for f in rows.schema.fields if f.dataType.typeName() not in ("map", "variant")}
    none = F.lit(None).cast("double")
    parts = []
    for i in range(len(names)):
        c = F.col(f"c{i}")
        parts.append(
            F.struct(
                F.lit(names[i]).alias("column_name"), F.count(c).alias("n"), F.count_if(c.isNull()).alias("n_null"),
                (F.min(c).cast("string") if f"c{i}" in ordered else F.lit(None).cast("string")).alias("lo"), (F.max(c).cast("string") if f"c{i}" in ordered else F.lit(None).cast("string")).alias("hi"),
                (F.avg(c).cast("double") if f"c{i}" in numeric else none).alias("mean"), (F.stddev(c) if f"c{i}" in numeric else none).alias("deviation"),
                (F.approx_count_distinct(c) if f"c{i}" in ordered else F.lit(None).cast("long")).alias("distinct_about"))
        )
    return rows.agg(F.array(*parts).alias("stats")).select(F.inline("stats"))


def histogram(source: ParquetSource, column: int, bins: int = 20) -> DataFrame:
    """bin, low, high, n: equal steps from the smallest to the largest number; bins without rows too. NaN and nulls are left out."""
    value = quoted(source.schema.names[column]).cast("double")
    rows = source.scan().select(value.alias("v")).filter("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')")
    ends = rows.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    if ends["low"] is None:
        return rows.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    low, step = ends["low"], (ends["high"] - ends["low"]) / bins or 1.0
    at = F.least(F.floor((F.col("v") - low) / step).cast("int"), F.lit(bins - 1)).alias("bin")
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    counts = every.join(rows.groupBy(at).agg(F.count("*").alias("n")), "bin", "left")
    return counts.select("bin", (low + F.col("bin") * step).alias("low"), (low + (F.col("bin") + 1) * step).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top_values(source: ParquetSource, column: int, most: int = 20) -> DataFrame:
    """value, n: the most frequent values, ties by value."""
    value = quoted(source.schema.names[column])
    counts = source.scan().select(value.alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(most)
