import zlib

from pyspark.sql import functions as F

from vitrine.llm.common import bounded_sample, fold, fold_column, labelled_sample, looked_up


def test_folds(spark, edges):
    for r in edges.select("doc_id", fold_column(F.col("doc_id"), 5).alias("fold")).collect():
        assert r["fold"] == zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == fold(r["doc_id"], 5)


def test_looked_up_with_frequent_keys(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise(F.col("id").cast("string")).alias("key"))
    known = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("largest"))
    found = {r["id"]: (r["key"], r["largest"]) for r in looked_up(rows, "key", known).collect()}
    assert len(found) == 3000
    for i, (key, largest) in found.items():
        assert largest == (2997 if key == "hot" else None if key is None else i)


def test_samples_are_bounded(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"))
    found, counts = bounded_sample(rows, "lang", 500, [F.col("text")])
    assert counts == {"a": 10_000, "b": 10_000} and 800 < len(found) < 1200
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    absent = spark.range(50_000, 90_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    found, counts = labelled_sample(rows.unionByName(rows), labels.unionByName(absent), "toxic", 100)
    found = found.collect()
    assert counts == {0: 15_000, 1: 5_000} and 120 < len(found) < 280 and all(r["label"] == (int(r["text"]) % 4 == 0) for r in found)


def test_a_frequent_key_is_dealt_to_many_tasks(spark):
    """By the plan, with neither broadcasts of the looked-up side nor splits of skewed partitions to help."""
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    known = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("largest"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = looked_up(rows, "key", known)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(key" in plan and "_part" in plan.split("hashpartitioning(key", 1)[1][:60]
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 30_000 and max(sizes) < 3_000  # a third in one task would be 10,000
        assert found.filter("largest IS NULL").isEmpty() and found.filter("key = 'hot' AND largest <> 29997").isEmpty()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_short_batches(spark):
    """Python gets so many rows at once, and the session's number is as it was."""
    from vitrine.llm.common import written

    def count(batches):
        for batch in batches:
            yield type(batch).from_pydict({"n": [len(batch)]})

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    sizes = [r["n"] for r in written(spark.range(0, 1000, 1, 1).mapInArrow(count, "n long"), "sizes", 64).collect()]
    assert max(sizes) == 64 and sum(sizes) == 1000 and spark.conf.get(key) == before


def test_heaps_are_freed(spark):
    """A full collection, on executors too; here they are in the driver's process."""
    from vitrine.llm.common import free_heaps

    def collected():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    before = collected()
    free_heaps(spark)
    assert collected() > before
