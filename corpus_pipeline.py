"""The training-data pipeline: quality rules, near-dedup, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, mixing, quality, sharding, simhash
from tidemark.llm.common import kept

SHARDS = 8
#: A line that is in fewer documents is not common, whatever its share.
COMMON_DOCS = 20
#: What sharding says of a row.
PLACE = ("size", "text_crc32", "law", "shard", "slot")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    return quality.clean(docs, common_docs=COMMON_DOCS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them."""
    return mixing.mix(docs)


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix with its shard and slot, beside the columns of documents.

    A column of documents by the name of one of the results (letter case aside) is returned as `input_<name>`.
    """
    taken = {*PLACE, *(c.lower() for c in docs.columns if c.lower() not in PLACE)}
    names = {}
    for c in docs.columns:
        name = c
        while c.lower() in PLACE and name.lower() in taken:
            name = f"input_{name}"
        taken.add(name.lower())
        names[c] = name
    placed = sharding.shard(docs, SHARDS, keep=True)
    return placed.select(*[F.col("row").getField(c).alias(name) for c, name in names.items()], *PLACE)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("shard_rows", shard_rows),
]

#: SimHash and the language of its rules can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
