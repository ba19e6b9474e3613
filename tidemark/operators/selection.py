"""Tests that a change can affect, in run order, and the first wave of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import fqn, full_class_name
from ..plans.fixpoint import union_all
from ..schemas import WAVE_FRACTION

#: Hops of a test that only a widened project selects; such tests come last.
UNREACHED = 2_147_483_647


def named_tests(tests: DataFrame) -> DataFrame:
    """Tests with their full class and qualified names."""
    return tests.withColumns(
        {
            "full_class": full_class_name(F.col("namespace"), F.col("class_name")),
            "fqn": fqn(F.col("namespace"), F.col("class_name"), F.col("method_name")),
        }
    )


def select_tests(tests: DataFrame, reached: DataFrame, widened: DataFrame) -> DataFrame:
    """Tests reached by their method or class, or whose project is widened, with the fewest hops.

    `tests` as from `named_tests`; `reached`: key, hops; `widened`: project.
    """
    hops = reached.select("key", "hops")
    by_method = hops.select(F.col("key").alias("symbol_key"), F.col("hops").alias("_m"))
    by_class = hops.select(F.col("key").alias("class_key"), F.col("hops").alias("_c"))
    wide = widened.select("project").distinct().withColumn("_w", F.lit(True))
    joined = tests.join(by_method, "symbol_key", "left").join(by_class, "class_key", "left").join(wide, "project", "left")
    least = F.least(F.coalesce("_m", F.lit(UNREACHED)), F.coalesce("_c", F.lit(UNREACHED)))
    chosen = joined.where(F.col("_m").isNotNull() | F.col("_c").isNotNull() | F.col("_w"))
    return chosen.withColumn("hops", least).drop("_m", "_c", "_w")


def run_order(selected: DataFrame) -> DataFrame:
    """Rank in each project, nearest first, then by qualified name."""
    order = Window.partitionBy("project").orderBy("hops", "fqn", "symbol_key")
    return selected.withColumn("rank", F.row_number().over(order))


def first_wave(ranked: DataFrame, fraction: float = WAVE_FRACTION) -> DataFrame:
    """whether each ranked test is in its project's first wave.

    Classes come in the order of their first test; a class is in the wave if the tests of the classes before it are still
    fewer than the target, a fraction of the selection, rounded up. Windows run over classes, not tests.
    """
    classes = ranked.groupBy("project", "full_class").agg(F.min("rank").alias("first"), F.count("*").alias("size"))
    totals = classes.groupBy("project").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("project").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    target = F.greatest(F.lit(1), F.ceil(F.col("total") * fraction))
    taken = classes.withColumn("taken", F.coalesce(F.sum("size").over(before), F.lit(0))).join(totals, "project")
    waves = taken.select("project", "full_class", (F.col("taken") < target).alias("in_wave"))
    return ranked.join(waves, ["project", "full_class"])


def widened_projects(*causes: DataFrame) -> DataFrame:
    """Projects that widenings widen; report-only ones don't count."""
    return union_all([c.where("widens").select("project") for c in causes]).distinct()
