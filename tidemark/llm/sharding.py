"""Sharding: a Feistel permutation over global row numbers gives every row a shard and a slot.

Law `rows`: shard sizes, counted in rows, differ by one at most. Everything here is DataFrame functions only.

A row's global number is its place in the order (id, text hash), found without gathering rows anywhere: rows are
range-partitioned and sorted, the place inside a partition comes with the row, and the partition's base is a prefix
sum over per-partition counts. The number then goes through a keyed bijection of [0, N): an alternating Feistel network
on an a x b grid with a * b >= N > (a - 1) * b, whose few outputs beyond N are walked along their cycle back into range.
Position p belongs to shard p mod S at slot p div S, so a slot is gapless by construction and `Permutation.position`
computes anyone's place from the row number alone.

Defined cases: null text counts size 1 and CRC of no bytes; a null id sorts first; equal ids are ordered by text hash and
rows equal in all three are interchangeable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept, partitions

_PRIME = 2**31 - 1
_ROUNDS = 6
#: The first step is unconditional; so many more are taken while a point lies outside [0, N).
_WALK = 16


@dataclass(frozen=True)
class Permutation:
    """A bijection of [0, n), fixed by n and seed."""

    n: int
    seed: int = 0

    @property
    def grid(self) -> tuple[int, int]:
        a = max(1, math.isqrt(max(self.n - 1, 0)) + 1)
        return a, max(1, -(-self.n // a))

    @property
    def keys(self) -> list[tuple[int, int, int]]:
        out = []
        for i in range(_ROUNDS):
            h = hashlib.sha256(f"{self.seed}/{self.n}/{i}".encode()).digest()
            out.append(tuple(1 + int.from_bytes(h[8 * j : 8 * j + 8], "big") % (_PRIME - 1) for j in range(3)))
        return out

    def step(self, x: int) -> int:
        """One pass through the network, on all of the grid."""
        wl, wr = self.grid
        left, right = divmod(x, wr)
        for k1, k2, k3 in self.keys:
            t = (right + k1) % _PRIME
            t = (t * t % _PRIME * k2 + k3) % _PRIME
            left, right = right, (left + t) % wl
            wl, wr = wr, wl
        return left * wr + right

    def position(self, row: int) -> int:
        x = self.step(row)
        while x >= self.n:
            x = self.step(x)
        return x

    def step_column(self, x: Column) -> Column:
        wl, wr = self.grid
        left, right = F.call_function("div", x, F.lit(wr)), x % F.lit(wr)
        for k1, k2, k3 in self.keys:
            t = (right + F.lit(k1)) % F.lit(_PRIME)
            t = (t * t % F.lit(_PRIME) * F.lit(k2) + F.lit(k3)) % F.lit(_PRIME)
            left, right = right, (left + t) % F.lit(wl)
            wl, wr = wr, wl
        return left * F.lit(wr) + right

    def _inside(self, x: Column) -> Column:
        return x < F.lit(self.n)

    def walk_column(self, x: Column) -> Column:
        """At most _WALK more steps, for points that lie outside."""
        steps = F.sequence(F.lit(1), F.lit(_WALK))
        return F.aggregate(steps, x, lambda at, _: F.when(self._inside(at), at).otherwise(self.step_column(at)))

    def ends_in_walk(self, spark) -> bool:
        """Whether every point beyond n comes back within the walk; there are fewer than sqrt(n) + 1 such points."""
        a, b = self.grid
        outside = spark.range(self.n, a * b, numPartitions=1).select(self.walk_column(F.col("id")).alias("at"))
        return outside.where(~self._inside(F.col("at"))).isEmpty()

    def apply(self, df: DataFrame, row: str, out: str) -> DataFrame:
        once = df.withColumn(out, self.step_column(F.col(row)))
        at = F.col(out)
        return once.withColumn(out, F.when(self._inside(at), at).otherwise(self.walk_column(at)))


def permutation(spark, n: int, seed: int = 0) -> Permutation:
    """The first permutation from `seed` on whose walks all end; chosen by n and seed alone."""
    while not (p := Permutation(n, seed)).ends_in_walk(spark):
        seed += 1
    return p


def row_numbers(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """`df` with its 0-based place in `order`, as a written table.

    A salt splits a run of equal rows over partitions. The sorted rows are written before they are counted, so that
    counts and places come from the same partitions, also when an executor is lost.
    """
    spark = df.sparkSession
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1024)))
    placed = (
        salted.repartitionByRange(partitions(spark), *order, "_salt")
        .sortWithinPartitions(*order, "_salt")
        .drop("_salt")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = kept(placed, "rows").withColumns(
        {"_part": F.shiftright("_at", 33), "_local": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    # A row for each partition: its bound is the partition count, so one task and a broadcast will do.
    bases = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select(
            "_part",
            F.coalesce(
                F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_base"),
        )
    )
    joined = placed.join(F.broadcast(bases), "_part")
    return joined.withColumn(out, F.col("_base") + F.col("_local")).drop("_at", "_part", "_local", "_base")


def shard(
    docs: DataFrame, shards: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", keep: bool = False
) -> DataFrame:
    """Every row with shard and slot.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard; with `keep`, the input's columns as a struct
    `row` as well (they are then shuffled along).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    columns = [
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"),
    ]
    if keep:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    numbered = row_numbers(docs.select(*columns), ["doc_id", "_hash"], "_row")
    n = numbered.count()
    at = permutation(spark, n, seed).apply(numbered, "_row", "_place") if n else numbered.withColumn("_place", F.lit(0))
    return at.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("_place"), F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(["row"] if keep else []),
    )
