"""Written tables that cut lineage, in the folder driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


@atexit.register
def _drop_local() -> None:
    """Written tables on a mounted file system go with the driver; `discard` drops others."""
    for at in _made:
        if at.startswith("file://"):
            shutil.rmtree(at.removeprefix("file://"), ignore_errors=True)


def discard(spark: SparkSession) -> None:
    """Delete every table written so far by this driver; DataFrames that read them can't be used any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def is_one_machine(spark: SparkSession) -> bool:
    """A local master; executors of `local-cluster` are processes of their own and may see other folders."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; on a local master without one, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not is_one_machine(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    at = os.path.join(tempfile.gettempdir(), "tidemark-shared")
    os.makedirs(at, exist_ok=True)
    return "file://" + at


def new_path(spark: SparkSession, what: str) -> str:
    """A place of ours in the shared folder."""
    at = f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}"
    _made.append(at)
    return at


#: Written tables are read a few times at most, so they are packed as small as that is cheap.
CODEC = "zstd"


def written(df: DataFrame, what: str, order: tuple[str, ...] = ()) -> DataFrame:
    """`df` written once and read again: later plans start here, and a lost executor costs no recomputation.

    `order`: what rows are sorted by within a file, for tables of many keys, which pack better beside their like.
    """
    at = new_path(df.sparkSession, what)
    schema = df.schema
    (df.sortWithinPartitions(*order) if order else df).write.option("compression", CODEC).parquet(at)
    return df.sparkSession.read.schema(schema).parquet(at)


def dropped(df: DataFrame) -> None:
    """Delete the folders of a written table that nothing reads any more; frames that read it can't be used after."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    inside = {jvm.org.apache.hadoop.fs.Path(f).getParent().toUri().getPath() for f in df.inputFiles()}
    for at in [a for a in _made if jvm.org.apache.hadoop.fs.Path(a).toUri().getPath() in inside]:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)
        _made.remove(at)
