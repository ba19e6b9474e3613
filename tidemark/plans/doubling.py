"""Chains of links followed by doubling: after k joins every row has gone 2^k steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workdir import written


def after_steps(links: DataFrame, doublings: int, key: str = "key", to: str = "to") -> DataFrame:
    """(key, to): where 2^doublings steps lead; a key without a link stays where it is, and a step onto it ends a chain.

    `links` has one row for each key; a null `to` is no link.
    """
    own = F.coalesce(F.col(to), F.col(key)).alias("to")
    at = written(links.select(F.col(key).alias("key"), own), "steps")
    for _ in range(doublings):
        # A chain may leave the table: such an end has no row and stays.
        more = at.select(F.col("key").alias("to"), F.col("to").alias("_more"))
        at = written(at.join(more, "to", "left").select("key", F.coalesce("_more", "to").alias("to")), "steps")
    return at


def any_above(rows: DataFrame, key: str, parent: str, flag: str) -> DataFrame:
    """(key, flag): whether the flag holds for a row or for any row above it by `parent`; cycles end.

    Rows that have reached the top take no part in further rounds, and a round doubles the distance, so a chain of n rows
    takes log2(n) rounds.
    """
    open_rows = written(
        rows.select(F.col(key).alias("key"), F.col(parent).alias("up"), F.coalesce(F.col(flag), F.lit(False)).alias("flag")), "above"
    )
    jumps, done, steps = open_rows, [], 1
    total = open_rows.count()
    while True:
        # A row that holds needs no more, nor does one at the top.
        ends = F.col("flag") | F.col("up").isNull()
        done.append(open_rows.where(ends).select("key", "flag"))
        open_rows = open_rows.where(~ends)
        if steps > 2 * max(1, total) or open_rows.isEmpty():
            # What is still open goes round in a circle that doesn't hold.
            done.append(open_rows.select("key", "flag"))
            break
        more = jumps.select(F.col("key").alias("up"), F.col("up").alias("_up"), F.col("flag").alias("_flag"))

        def joined(df: DataFrame, more: DataFrame = more) -> DataFrame:
            both = df.join(more, "up", "left")
            return written(both.select("key", F.col("_up").alias("up"), (F.col("flag") | F.coalesce("_flag", F.lit(False))).alias("flag")), "above")

        open_rows, jumps, steps = joined(open_rows), joined(jumps), 2 * steps
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
