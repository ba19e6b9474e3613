"""Tables in buckets by a hash of keys, which a join or an aggregate on those keys reads without a shuffle.

Files lie in the shared folder (see `workdir`); the catalog holds an entry only as long as its name is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workdir import CODEC, new_path


def bucket_count(spark: SparkSession) -> int:
    """As many buckets as a shuffle has partitions, so that shuffled rows meet them one to one."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _quoted(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


class Rounds:
    """Rows that come in rounds, in buckets by `keys`: a round is read alone by its number, all of them without a shuffle.

    Rounds are folders of their own. A round is written by Spark's commit protocol, so a task that runs again leaves its
    rows once. The rows of `df` should already be partitioned by `keys` in as many parts as there are buckets, as after an
    aggregate on them; then a task writes one file. Otherwise each task writes a file for each bucket it has rows of.
    """

    def __init__(self, spark: SparkSession, what: str, schema: str, keys: Sequence[str], number: str = "hops"):
        self.spark, self.number = spark, number
        self.path = new_path(spark, what)
        self.name = "tidemark_" + self.path.rpartition("-")[2]
        self.schema = f"{schema}, {number} int"
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema]
        spark.sql(
            f"CREATE TABLE {self.name} ({self.schema}) USING parquet OPTIONS (compression '{CODEC}') PARTITIONED BY ({number}) "
            f"CLUSTERED BY ({_quoted(keys)}) INTO {bucket_count(spark)} BUCKETS LOCATION '{self.path}'"
        )

    def append(self, df: DataFrame, number: int) -> DataFrame:
        """Write the rows as a round; returns them as they were written."""
        df.select(*self.columns, F.lit(number).alias(self.number)).write.insertInto(self.name)
        return self.all().where(F.col(self.number) == number)

    def all(self) -> DataFrame:
        return self.spark.table(self.name)

    def closed(self) -> DataFrame:
        """All rows, read by their path; the catalog's entry goes, and no round can be added."""
        self.spark.sql(f"DROP TABLE {self.name}")
        return self.spark.read.schema(self.schema).parquet(self.path)


def bucketed(df: DataFrame, what: str, key: str) -> DataFrame:
    """`df` written in buckets by a key, sorted by it, and read again; a filter by named keys reads their buckets only."""
    spark = df.sparkSession
    path = new_path(spark, what)
    name = "tidemark_" + path.rpartition("-")[2]
    n = bucket_count(spark)
    df.repartition(n, key).write.format("parquet").option("compression", CODEC).bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    # The frame keeps the files and their buckets; the name isn't needed any more.
    found = spark.table(name)
    found.schema  # noqa: B018 - resolved while the name is there
    spark.sql(f"DROP TABLE {name}")
    return found
