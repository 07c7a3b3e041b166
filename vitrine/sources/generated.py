"""The generated dataset for stress tests, and the Parquet sink it goes to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 1_000_000_000
GROUP_ROWS = 1_000_000


def generated(spark: SparkSession, rows: int = ROWS) -> DataFrame:
    number = F.col("id")
    return spark.range(rows).select(
        "id",
        (number % 1_000_000).alias("user_id"),
        (number % 100).alias("category_id"),
        (number * 10).alias("value_int"),
        (number * F.lit(0.001)).alias("value_float"),
        (number % 2 == 0).alias("is_even"),
        (number % 10 == 0).alias("is_special"),
        F.concat(F.lit("dummy_"), (number % 1000).cast("string")).alias("label"),
        (number % 50).cast("int").alias("group_id"),
        (number % 7).cast("tinyint").alias("day_of_week"),
    )


def write_parquet(df: DataFrame, path: str, group_rows: int = GROUP_ROWS, compression: str = "zstd") -> None:
    df.write.option("compression", compression).option("parquet.block.row.count.limit", str(group_rows)).parquet(path)
