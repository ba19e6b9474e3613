"""Reports: totals per project, widenings, explanations, the nested document of an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import edge_text
from ..plans.fixpoint import union_all
from ..plans.workdir import written
from .graph import paths_to


def project_totals(tests: DataFrame, plans: DataFrame) -> DataFrame:
    """Per project tests, impacted ones (`selected`), and tests that run: all of an unfiltered project."""
    counted = tests.groupBy("project").agg(F.count("*").alias("tests"), F.count_if("selected").alias("impacted"))
    joined = counted.join(plans.select("project", "filtered"), "project", "left")
    runs = (
        F.when(F.col("impacted") == 0, F.lit(0))
        .when(F.coalesce("filtered", F.lit(False)), F.col("impacted"))
        .otherwise(F.col("tests"))
    )
    return joined.select("project", "tests", "impacted", runs.alias("selected"))


def totals(projects: DataFrame) -> DataFrame:
    """Sums over projects."""
    return projects.agg(
        F.coalesce(F.sum("tests"), F.lit(0)).alias("tests"),
        F.coalesce(F.sum("impacted"), F.lit(0)).alias("impacted"),
        F.coalesce(F.sum("selected"), F.lit(0)).alias("selected"),
    )


def all_widenings(changes: DataFrame, closure: DataFrame, unmapped: DataFrame, plans: DataFrame) -> DataFrame:
    """The change set's widenings, dependents of widened projects, unmapped changes and unfiltered projects."""
    direct = changes.select("project", "cause", "detail")
    named = changes.where("widens").select("project").distinct()
    dependents = closure.join(named, "project", "left_anti").select(
        "project", F.lit("Dependent").alias("cause"), F.lit("references a widened project").alias("detail")
    )
    lost = unmapped.select(F.lit(None).cast("string").alias("project"), F.lit("Unmapped").alias("cause"), "detail")
    unfiltered = plans.where((F.col("selected") > 0) & ~F.col("filtered")).select(
        "project", F.lit("Unfiltered").alias("cause"), F.col("reason").alias("detail")
    )
    return union_all([direct, dependents, lost, unfiltered]).distinct()


def explain_matches(tests: DataFrame, query: str) -> DataFrame:
    """C17: tests whose name ends with the query, letter case aside; where none does, those that hold it (`near`)."""
    low = F.lower("fqn")
    ends = F.endswith(low, F.lit(query.lower()))
    hits = tests.where(F.contains(low, F.lit(query.lower()))).withColumn("exact", ends)
    exact = hits.where("exact")
    return exact if not exact.isEmpty() else hits


def explain_verdict(reached: Column, selected: Column, project_selected: Column, filtered: Column) -> Column:
    """Why a test runs, or doesn't."""
    return (
        F.when(reached, "Reached")
        .when(project_selected == 0, "Absent")
        .when(~filtered, "Unfiltered")
        .when(selected, "Widened")
        .otherwise("NotReached")
    )


def explain(tests: DataFrame, walked: DataFrame, plans: DataFrame, query: str) -> DataFrame:
    """(fqn, project, exact, verdict, will_run, line) of the tests that `query` names.

    `tests` with `selected`, `walked` with predecessors, `plans` per project. The line is the chain from a changed symbol
    to the test's method, or to its class where that alone was reached; null where none was.
    """
    named = explain_matches(tests, query).select("fqn", "project", "symbol_key", "class_key", "selected", "exact")
    reached = walked.select("key").distinct()
    by_method = reached.select(F.col("key").alias("symbol_key"), F.col("key").alias("_method"))
    by_class = reached.select(F.col("key").alias("class_key"), F.col("key").alias("_class"))
    found = named.join(by_method, "symbol_key", "left").join(by_class, "class_key", "left")
    found = written(found.withColumn("target", F.coalesce("_method", "_class")), "explained")
    lines = path_lines(paths_to(walked, found.where(F.col("target").isNotNull()).select(F.col("target").alias("key")).distinct()))
    state = plans.select("project", F.col("selected").alias("_n"), "filtered")
    told = found.join(lines, "target", "left").join(state, "project", "left")
    verdict = explain_verdict(F.col("target").isNotNull(), F.col("selected"), F.coalesce("_n", F.lit(0)), F.coalesce("filtered", F.lit(True)))
    return told.withColumn("verdict", verdict).select(
        "fqn", "project", "exact", "verdict", F.col("verdict").isin("Reached", "Unfiltered", "Widened").alias("will_run"), "line"
    )


def path_lines(paths: DataFrame) -> DataFrame:
    """Chains of `paths_to` as text: keys, each behind what its edge says."""
    said = F.transform(
        "path",
        lambda p: F.when(p["kind"].isNull(), p["key"]).otherwise(F.concat(F.lit("--"), edge_text(p["kind"]), F.lit("--> "), p["key"])),
    )
    return paths.select("target", F.array_join(said, " ").alias("line"))


def json_of(columns: list[str]) -> Column:
    """Columns as a JSON object with camel-case names; nulls are left out."""

    def camel(name: str) -> str:
        head, *rest = name.split("_")
        return head + "".join(x.title() for x in rest)

    return F.to_json(F.struct(*[F.col(f"`{c}`").alias(camel(c)) for c in columns]))


def report_json(report: DataFrame) -> DataFrame:
    """Each row as a JSON object."""
    return report.select(json_of(report.columns).alias("json"))


def graph_json(summary: DataFrame, tests: DataFrame) -> DataFrame:
    """JSON objects, the graph's summary and then each test, in column `json`; `ord` is 0 for the summary."""
    graph = summary.select(F.lit(0).alias("ord"), json_of(summary.columns).alias("json"))
    columns = ["fully_qualified_name", "project_name", "framework", "is_parameterized"]
    named = tests.select(F.col("fqn").alias(columns[0]), F.col("project").alias(columns[1]), *columns[2:])
    return graph.unionByName(named.select(F.lit(1).alias("ord"), json_of(columns).alias("json")))


def test_command(
    project_file: Column, vstest_mode: Column, platform_runner: Column, arguments: Column, passthrough: Column
) -> Column:
    """The words of a test command; platform runners behind a VSTest-mode SDK get their filter after `--`."""
    none = F.array().cast("array<string>")
    given = F.coalesce(arguments, none)
    head = F.when(
        vstest_mode, F.array(F.lit("dotnet"), F.lit("test"), project_file)
    ).otherwise(F.array(F.lit("dotnet"), F.lit("test"), F.lit("--project"), project_file))
    dashes = F.when(vstest_mode & platform_runner & (F.size(given) > 0), F.array(F.lit("--"))).otherwise(none)
    return F.concat(head, F.coalesce(passthrough, none), dashes, given)
