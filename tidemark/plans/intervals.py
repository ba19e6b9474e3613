"""Interval-overlap and longest-prefix joins as equi-joins with a residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: A range over more cells than this isn't dealt by cells.
_MOST_CELLS = 16


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    bucket: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """Pairs with equal `on` columns whose closed integer ranges overlap.

    With `bucket`, ranges are also dealt by cells of that width, so that one hot `on` value spreads; a pair is reported
    only from the cell where its overlap begins, hence once. A range over more than a few cells, such as a whole file's,
    meets the other side by the `on` columns alone: it overlaps most of what it meets. `how` is inner or left; left
    takes no bucket.
    """
    if not bucket:
        return _joined(left, right, on, left_range, right_range, how)
    if how != "inner":
        raise ValueError("a bucketed interval join is an inner join")

    def cells(df: DataFrame, ends: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
        a, b = (F.call_function("div", F.col(c), F.lit(bucket)) for c in ends)
        wide = b - a >= _MOST_CELLS
        return df.where(~wide).withColumn("_cell", F.explode(F.sequence(a, b))), df.where(wide)

    (near, wide), (near_right, wide_right) = cells(left, left_range), cells(right, right_range)
    return (
        _joined(near, near_right, on, left_range, right_range, how, bucket)
        .unionByName(_joined(near.where(_first_cell(left_range[0], bucket)).drop("_cell"), wide_right, on, left_range, right_range, how))
        .unionByName(_joined(wide, right, on, left_range, right_range, how))
    )


def _first_cell(start: str, bucket: int) -> Column:
    return F.col("_cell") == F.call_function("div", F.col(start), F.lit(bucket))


def _joined(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    how: str,
    bucket: int | None = None,
) -> DataFrame:
    (a, b), (c, d) = left_range, right_range
    condition = (F.col(f"l.{a}") <= F.col(f"r.{d}")) & (F.col(f"r.{c}") <= F.col(f"l.{b}"))
    for k in on:
        condition = condition & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    if bucket:
        begin = F.greatest(F.col(f"l.{a}"), F.col(f"r.{c}"))
        condition = condition & (F.col("l._cell") == F.col("r._cell")) & (F.call_function("div", begin, F.lit(bucket)) == F.col("l._cell"))
    joined = left.alias("l").join(right.alias("r"), condition, how)
    keep = [F.col(f"l.{x}") for x in left.columns if x != "_cell"]
    keep += [F.col(f"r.{x}") for x in right.columns if x not in (*on, "_cell")]
    return joined.select(*keep)


def longest_prefix(
    paths: DataFrame, path: str, prefixes: DataFrame, prefix: str, order: str, separator: str = "/"
) -> DataFrame:
    """Each path with the longest prefix that ends at a separator; of equal ones the least by `order`.

    Every path lists its own ancestors, at most as many as it has separators, and looks them up by equality; no pair of
    all paths and prefixes is formed. Paths without a prefix stay, with nulls.
    """
    deep = F.size(F.split(path, separator, -1))
    ancestors = F.transform(
        F.sequence(F.lit(1), deep), lambda i: F.call_function("substring_index", F.col(path), F.lit(separator), i)
    )
    best = Window.partitionBy(prefix).orderBy(order)
    firsts = prefixes.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    listed = paths.select(path).distinct().withColumn("_up", F.explode(ancestors))
    found = listed.join(firsts, F.col("_up") == F.col(prefix)).where(F.length("_up") < F.length(path))
    by_path = found.groupBy(path).agg(
        F.max_by(F.struct(*[F.col(c) for c in prefixes.columns]), F.length("_up")).alias("_best")
    )
    return paths.join(by_path, path, "left").select(
        *[F.col(c) for c in paths.columns], *[F.col("_best").getField(c).alias(c) for c in prefixes.columns]
    )
