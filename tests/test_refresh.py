"""The stateful refresh: only content that differs is a change, across micro-batches and restarts."""

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import watch

SCHEMA = "path string, ts timestamp, text string"


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, old)


def test_content_equal_rewrites_are_no_change(spark, tmp_path, rocks):
    files, check, out = (str(tmp_path / n) for n in ("in", "check", "out"))
    n = 0

    def run(*rows):
        nonlocal n
        n += 1
        df = spark.createDataFrame([(p, f"2024-01-01 00:00:{s:02}", t) for p, s, t in rows], "path string, ts string, text string")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(files)
        seen = watch.refresh(spark.readStream.schema(SCHEMA).parquet(files))
        # A new query each time: what it knows comes from the checkpoint.
        one = lambda d, i: d.write.mode("append").parquet(f"{out}/{n}-{i}")
        query = seen.writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(one).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return {tuple(r) for r in spark.read.schema("path string, change string").option("recursiveFileLookup", True).parquet(out).collect()}

    first = run(("a", 1, "one"), ("b", 1, "two"), ("c", 1, None))
    assert first == {("a", "added"), ("b", "added")}
    # The same content at another time, and another content that is taken back in the same batch.
    assert run(("a", 2, "one"), ("b", 2, "other"), ("b", 3, "two")) == first
    assert run(("a", 4, "more"), ("b", 5, None)) == first | {("a", "changed"), ("b", "removed")}
    assert run(("b", 6, None), ("a", 7, "more")) == first | {("a", "changed"), ("b", "removed")}
