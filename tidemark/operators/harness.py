"""Trust in a selection: missed failures, verdicts, and figures over samples and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import normalize_test_name


def missed_failures(failures: DataFrame, selected: DataFrame, unfiltered: DataFrame) -> DataFrame:
    """Failures (project, test) that the selection leaves out.

    A failure is covered if its project runs unfiltered, or its raw or normalised name is selected. Names are compared by
    equality, each failure under both names.
    """
    rest = failures.select("project", "test").distinct().join(unfiltered.select("project"), "project", "left_anti")
    plain = rest.withColumn("name", normalize_test_name(F.col("test")))
    names = selected.select("project", F.col("fqn").alias("name")).distinct()
    unnamed = plain.join(names, ["project", "name"], "left_anti")
    raw = names.withColumnRenamed("name", "test")
    return unnamed.join(raw, ["project", "test"], "left_anti").select("project", "test")


def silent_projects(failed: DataFrame, selections: DataFrame) -> DataFrame:
    """Failed projects of which nothing was selected and that weren't run whole."""
    state = selections.select("project", "selected", "filtered")
    joined = failed.select("project").distinct().join(state, "project", "left")
    none = F.coalesce("selected", F.lit(0)) == 0
    return joined.where(none & F.coalesce("filtered", F.lit(True))).select("project")


def shadow_verdict(counts: DataFrame) -> DataFrame:
    """From (misses, failures, unobserved, timed_out) the verdict and the exit code."""
    verdict = (
        F.when(F.col("misses") > 0, "Miss")
        .when((F.col("unobserved") > 0) | (F.col("timed_out") > 0), "Inconclusive")
        .when(F.col("failures") == 0, "NoFailures")
        .otherwise("Clean")
    )
    code = F.when(F.col("verdict") == "Miss", 1).when(F.col("verdict") == "Inconclusive", 2).otherwise(0)
    return counts.withColumn("verdict", verdict).withColumn("exit_code", code)


def default_selections(descriptors: DataFrame, selections: DataFrame) -> DataFrame:
    """Every test project; one without a selection is filtered and empty."""
    return descriptors.where("is_test").select(F.col("name").alias("project")).join(
        selections, "project", "left"
    ).select(
        "project",
        F.coalesce("selected", F.lit(0)).alias("selected"),
        F.coalesce("filtered", F.lit(True)).alias("filtered"),
    )


def first_failures(ranked: DataFrame, by: list[str]) -> DataFrame:
    """for each run the first rank with a failure, and how many tests were ordered; null if none failed."""
    return ranked.groupBy(*by).agg(
        F.min(F.when(F.col("failed"), F.col("rank"))).alias("first_failure"), F.count("*").alias("ordered")
    )


def time_to_failure(samples: DataFrame) -> DataFrame:
    """Over samples whose first failure is known, its mean share of the order, and what chance would give."""
    located = samples.where(F.col("first_failure").isNotNull() & (F.col("ordered") > 0))
    return located.agg(
        F.count("*").alias("located"),
        F.avg(F.col("first_failure") / F.col("ordered")).alias("ordered_share"),
        F.avg((F.col("ordered") + 1) / (2 * F.col("ordered"))).alias("expected_share"),
    )


def mutation_summary(samples: DataFrame, project_granularity: bool = False) -> DataFrame:
    """Usable, skipped, timed out, misses, and whether the gate is passed."""
    usable = F.col("outcome").isin("Clean", "Miss")
    out = samples.agg(
        F.count_if(usable).alias("usable"),
        F.count_if(F.col("outcome") == "Skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "TimedOut").alias("timed_out"),
        F.coalesce(F.sum(F.size(F.coalesce("misses", F.array().cast("array<string>")))), F.lit(0)).alias("misses"),
    )
    return out.withColumn(
        "passed", (F.col("misses") == 0) & (F.col("usable") > 0) & F.lit(not project_granularity)
    )


def skip_reasons(samples: DataFrame, n: int = 3) -> DataFrame:
    """The n most frequent reasons, ties by name; the limit is the report's."""
    counted = samples.where(F.col("skip_reason").isNotNull()).groupBy("skip_reason").agg(F.count("*").alias("times"))
    return counted.orderBy(F.col("times").desc(), "skip_reason").limit(n)


def replay_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean selected share (nothing to select counts as all), rates of full and widened runs, mean seconds."""
    share = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("selected") / F.nullif(F.col("total"), F.lit(0)))
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("commits"),
        F.avg(share).alias("selection_ratio"),
        F.avg(F.col("full_run").cast("int")).alias("full_run_rate"),
        F.avg((F.col("widenings") > 0).cast("int")).alias("widening_rate"),
        F.avg("seconds").alias("seconds"),
    )


def replay_table(rows: DataFrame) -> DataFrame:
    """Lines of the markdown table, in the order of `ord`."""
    share = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("selected") / F.nullif(F.col("total"), F.lit(0)))
    line = F.concat_ws(
        " | ",
        F.concat(F.lit("| "), F.left("commit", F.lit(9))),
        F.replace("subject", F.lit("|"), F.lit("\\|")),
        F.concat(F.col("selected"), F.lit("/"), F.col("total")),
        F.concat(F.bround(share * 100, 1), F.lit(" %")),
        F.when(F.col("full_run"), "full").otherwise("selective"),
        F.concat(F.bround("seconds", 1), F.lit(" s |")),
    )
    return rows.select("ord", line.alias("line")).orderBy("ord")


def rank_in_run(outcomes: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Ranks within each run, for `first_failures`."""
    return outcomes.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
