"""Connected components of a link table by alternating large-star and small-star steps, each a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def _links(df: DataFrame) -> DataFrame:
    """Links as hi > lo, each once."""
    return (
        df.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .where(F.col("hi") != F.col("lo"))
        .distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the least of the node and its neighbours."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(links.select("lo", "hi"))
    least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    larger = links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    return larger.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node, are linked to the least of them."""
    least = kept(links.groupBy("hi").agg(F.min("lo").alias("m")), "least")
    moved = links.join(least, "hi").select(F.col("lo").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select(F.col("hi").alias("a"), F.col("m").alias("b")))


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root) of every node that has a link to another; root is the least node of its component.

    The group of a node is never gathered: its least neighbour is an aggregate, written before it is joined back, so that
    a node of many links can be split over tasks. Ends when a round changes nothing; the rounds grow with the logarithm of the component's size. Nulls make no link; no links, no rows.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    now = kept(_links(links), "links")
    seen = None
    while True:
        now = kept(_links(_small_star(_links(_large_star(now)))), "links")
        # Equal sums over two independent hashes: the table is the same set of links as a round ago.
        sign = now.agg(
            F.count("*"),
            F.sum(F.xxhash64("hi", "lo") % (1 << 30)),
            F.sum(F.xxhash64("lo", "hi") % (1 << 30)),
        ).first()
        if tuple(sign) == seen:
            break
        seen = tuple(sign)
    roots = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
