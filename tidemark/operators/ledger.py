"""Is selection worth it: verdicts over past runs, and break-even figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import EXTRA_INVOCATION_SECONDS, LEDGER_LEAST_RUNS, LEDGER_ROWS, SPLIT_MARGIN


def keep_last(runs: DataFrame, seq: str = "seq", rows: int = LEDGER_ROWS) -> DataFrame:
    """the last rows of a ledger; a ledger is one file of a hundred rows, and the limit is its feature."""
    return runs.orderBy(F.col(seq).desc()).limit(rows)


def verdict(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per ledger its selective runs, A, f, T, whether T was seen, A + f * T, and what a run saves.

    Usable runs have tests and took time. T is the mean of full runs, else the most that any run took. Null figures if
    there are fewer than three usable runs or none was selective.
    """
    usable = runs.where((F.col("totalTests") > 0) & (F.col("suiteSeconds") > 0))
    selective = ~F.col("fullRun")
    summed = usable.groupBy(*(by or [])).agg(
        F.count("*").alias("usable"),
        F.count_if(selective).alias("runs"),
        F.avg(F.when(selective, F.col("analysisSeconds"))).alias("analysis_seconds"),
        F.avg(F.when(selective, F.col("selectedTests") / F.col("totalTests"))).alias("selected_fraction"),
        F.avg(F.when(F.col("fullRun"), F.col("suiteSeconds"))).alias("_full"),
        F.max("suiteSeconds").alias("_most"),
    )
    told = (F.col("usable") >= LEDGER_LEAST_RUNS) & (F.col("runs") > 0)
    out = summed.withColumns(
        {
            "suite_seconds": F.coalesce("_full", "_most"),
            "suite_observed": F.col("_full").isNotNull(),
            "told": told,
        }
    ).withColumn(
        "selective_seconds", F.col("analysis_seconds") + F.col("selected_fraction") * F.col("suite_seconds")
    )
    figures = ["analysis_seconds", "selected_fraction", "suite_seconds", "selective_seconds"]
    return out.select(
        *(by or []),
        "usable",
        "runs",
        *[F.when(F.col("told"), F.col(c)).alias(c) for c in figures],
        F.when(F.col("told"), F.col("suite_observed")).alias("suite_observed"),
        F.when(F.col("told"), F.col("suite_seconds") - F.col("selective_seconds")).alias("net_seconds"),
    )


def split_saving(suite_seconds: Column, first_wave: Column, selected: Column, total: Column) -> Column:
    """Seconds by which a failure shows sooner with a first wave."""
    return (0.5 - first_wave / selected) * (suite_seconds * selected / total)


def split_pays(suite_seconds: Column, first_wave: Column, selected: Column, total: Column) -> Column:
    """Whether the saving covers an extra invocation with its margin; false without a verdict or tests."""
    some = (first_wave > 0) & (selected > 0) & (total > 0)
    saving = split_saving(suite_seconds, first_wave, F.nullif(selected, F.lit(0)), F.nullif(total, F.lit(0)))
    return F.coalesce(some & (saving >= SPLIT_MARGIN * EXTRA_INVOCATION_SECONDS), F.lit(False))


def break_even(analysis_seconds: Column, fraction: Column) -> Column:
    """A / (1 - f); null if everything is selected or the analysis took no time."""
    return F.when((fraction < 1) & (analysis_seconds > 0), analysis_seconds / F.when(fraction < 1, 1 - fraction))


def advice(net_seconds: Column) -> Column:
    """What the verdict says."""
    return (
        F.when(net_seconds.isNull(), "not enough runs")
        .when(net_seconds >= 0, "selection saves time")
        .otherwise("selection costs more than it saves")
    )


def append_run(runs: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """A19 without the file: a run more, the last hundred kept."""
    top = runs.agg(F.coalesce(F.max(seq), F.lit(-1))).first()[0]
    numbered = new.withColumn(seq, F.lit(top) + F.row_number().over(Window.orderBy("at")))
    return keep_last(runs.unionByName(numbered.select(*runs.columns)), seq)
