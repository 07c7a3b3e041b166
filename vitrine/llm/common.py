"""What the operators share: intermediate tables, code on the workers, hashing of folds."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrine.shipping import ship  # noqa: F401  the operators take it from here


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset, a local one, if all runs in one process; on a cluster that is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vitrine/{name}-{uuid.uuid4().hex}"


_ROWS, _USUAL = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.vitrine.usualRecordsPerBatch"


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs in it send Python at most so many rows at once: of long texts and sets, the usual number takes hundreds of MB on both sides."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def keep_batches_short(spark: SparkSession, rows: int) -> None:
    """As short_batches(), for a result that runs after its function has returned: it holds until usual_batches()."""
    before = spark.conf.get(_ROWS)
    if spark.conf.get(_USUAL, None) is None:
        spark.conf.set(_USUAL, before)
    spark.conf.set(_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))


def usual_batches(spark: SparkSession) -> None:
    """The session's own number of rows holds again."""
    if before := spark.conf.get(_USUAL, None):
        spark.conf.set(_ROWS, before)
        spark.conf.unset(_USUAL)


def written(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """df as a table in the shared folder: lost executors don't lose it, and it isn't computed twice. batch: rows that Python gets at once, at most."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with short_batches(spark, batch) if batch else contextlib.nullcontext():
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.vitrine_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Deletes a table that written() made, once nothing reads it any more."""
    if df is not None:
        delete_path(df.sparkSession, df.vitrine_path)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fold(doc_id, parts: int) -> int:
    """crc32 of the id as text, modulo parts. A null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def fold_column(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def batches(rows: list, schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches from row tuples."""
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


def give_back() -> None:
    """Memory that a Python worker has freed goes back to the system: the next tasks may be the JVM's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def free_heaps(spark: SparkSession) -> None:
    """A full collection on each executor: what its JVM's heap and direct buffers have grown by goes back to the system, where the Python workers of what follows need it.

    A job of a task for each core, which Spark deals to all executors that are idle; where one gets none, its heap stays as it is. Nothing that is computed depends on it."""
    context = spark.sparkContext
    tasks = 1 if context._jsc.sc().isLocal() else context.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; VITRINE_TOKENIZERS names another folder."""
    if folder := os.environ.get("VITRINE_TOKENIZERS"):
        return str(Path(folder, name))
    import public_tokenizers

    return public_tokenizers.path(name)


def bytes_of(column: pa.Array):
    """The UTF-8 bytes of all texts of a column one after another, and where each begins and the last ends. A null is an empty text."""
    import numpy as np

    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and len(column.buffers()[2]) else np.zeros(0, np.uint8)
    return data, ends


def spans(ends, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most `most` bytes together; a longer text is a run of its own."""
    first = 0
    for i in range(1, len(ends)):
        if ends[i] - ends[first] > most and i - 1 > first:
            yield first, i - 1
            first = i - 1
    if len(ends) - 1 > first:
        yield first, len(ends) - 1


def bounded_sample(rows: DataFrame, label: str, per_label: int, columns: list[Column]) -> tuple[list, dict]:
    """About per_label rows of each label, chosen by a hash of id and text, as a list of the given columns after the label; and how many rows each label has."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect() if r[label] is not None}
    if not counts:
        return [], counts
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    chosen = F.lit(False)
    for value, n in sorted(counts.items()):
        chosen = chosen | ((F.col(label) == F.lit(value)) & (part < F.lit(max(1, -(-(per_label << 20) // n)))))
    found = rows.filter(chosen).select(F.col(label).alias("label"), *columns).distinct().collect()
    found.sort(key=lambda r: tuple(map(str, r)))
    return found, counts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> tuple[DataFrame, dict]:
    """About per_label labelled ids of each label 0 and 1, chosen by a hash, as labelled_id, label and the whole text; and how many ids of docs have each label.

    What counts are ids that docs has: labels of other documents, of a held-out fold too, change nothing. The ids are chosen among the labels, so that a bounded number of them,
    and no document, is moved to join the two."""
    marked = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label")).distinct()
    present = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r["label"]: r["count"] for r in present.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = F.lit(False)
    for value, n in sorted(counts.items()):
        chosen = chosen | ((F.col("label") == F.lit(value)) & (place < F.lit(max(1, -(-(per_label << 20) // n)))))
    side = F.broadcast(present.filter(chosen).select(F.col("doc_id").alias("labelled_id"), "label"))  # about 2 x per_label ids
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(side, F.col("doc_id") == F.col("labelled_id"))
    return rows.groupBy("labelled_id", "label").agg(F.min("text").alias("text")), counts  # of rows that share an id, one


def unused(name: str, df: DataFrame) -> str:
    """A name for a further column of df: the given one, or the first with underscores after it that no column has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def extended(schema: StructType, ddl: str) -> StructType:
    """A schema with further fields."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


#: Rows of a frequent key that are looked up in one task, about: between these, a share of all rows of 1 / SHARES.
PART_LEAST, PART_MOST, SHARES = 256, 16_384, 1024


def looked_up(rows: DataFrame, key: str, known: DataFrame, settled: Column | None = None, total: int | None = None) -> DataFrame:
    """rows, left-joined with known (one row for each key, with `n`, how many rows have it, and values that rows has no columns for), without moving the rows of a frequent key to one task.

    A frequent key's rows are dealt to parts by a hash of the row, and its values are sent to each of these. What is broadcast are the keys with more than a part and
    how many parts they have: at most SHARES keys, or one for every PART_MOST rows.
    settled: which rows need no values. They and those without a key are spread evenly. total: how many rows there are, about, where the caller knows."""
    values = [c for c in known.columns if c not in (key, "n")]
    total = (known.agg(F.sum("n")).first()[0] or 0) if total is None else total
    part = min(max(total // SHARES, PART_LEAST), PART_MOST)
    known = known.filter(F.col(key).isNotNull())
    many = F.ceil(F.col("n") / part).cast("long")
    often = known.filter(F.col("n") > part).select(F.col(key).alias("_often"), many.alias("_parts"))
    columns = rows.columns
    spread = F.xxhash64(*columns)
    rows = rows.join(F.broadcast(often), F.col(key) == F.col("_often"), "left")
    idle = F.col(key).isNull() | (F.lit(False) if settled is None else F.coalesce(settled, F.lit(False)))
    rows = rows.withColumn("_part", F.when(idle, -1 - F.pmod(spread, F.lit(1 << 20))).otherwise(F.pmod(spread, F.coalesce("_parts", F.lit(1).cast("long")))))
    known = known.select(F.col(key).alias("_key"), F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("_of"), *(F.col(c).alias(f"_{c}") for c in values))
    rows = rows.join(known, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_of")), "left")
    return rows.select(*columns, *(F.col(f"_{c}").alias(c) for c in values))
