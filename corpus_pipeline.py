"""A corpus pipeline in five stages, each an operator of vitrine.llm: run(), or the stages one by one.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written, and read again as the next one's docs. The
classifiers learn from the labelled documents in sf_dir outside their held-out folds. All stages but the last return
the columns that they got. What the first two return runs with short batches of texts, a setting of the session that the
third sets back. Each stage begins with a collection of the executors' garbage (free_heaps)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import decontaminate, language, packing, quality, simhash
from vitrine.llm.common import free_heaps, keep_batches_short, usual_batches, written

#: Rows with texts that Python gets at once in the stages whose result is rows that it has passed on.
BATCH = 1024
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    free_heaps(spark)
    keep_batches_short(spark, BATCH)
    return quality.keep_good(docs, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages learnt go."""
    free_heaps(spark)
    keep_batches_short(spark, BATCH)
    return language.keep_known(docs, _table(spark, sf_dir, "documents"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    free_heaps(spark)
    usual_batches(spark)
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go."""
    free_heaps(spark)
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, packed into sequences."""
    free_heaps(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality", good_quality), ("language", known_language), ("near_dedup", near_dedup), ("decontaminate", without_benchmark), ("pack", packed)]

#: SQL can't express the classifiers, the near-duplicates and the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
