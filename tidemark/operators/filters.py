"""Filters for test runners: class collapse, dialects, extra matches, plans for one run or two waves.

Tables of tests have project, full_class, fqn, namespace, class_name, method_name and selected. A dialect is an object with
a name and functions from such a table to (project, arguments) and to extra matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import escape_tree_node, escape_vstest
from ..plans.buckets import bucket_count
from ..plans.fixpoint import union_all
from ..plans.workdir import written
from ..schemas import COVERAGE_LIMIT, FILTER_LENGTH_LIMIT, WAVE_LEAST_TESTS


def class_counts(tests: DataFrame) -> DataFrame:
    """D3: tests and selected ones of each class."""
    return tests.groupBy("project", "full_class").agg(
        F.count("*").alias("total"), F.count_if("selected").alias("selected")
    )


def collapse_classes(tests: DataFrame) -> DataFrame:
    """Classes with `whole`: more than one test selected, and all that it has."""
    counts = class_counts(tests)
    return counts.withColumn("whole", (F.col("selected") > 1) & (F.col("selected") == F.col("total")))


def _collapsed(tests: DataFrame) -> DataFrame:
    """Selected tests with `whole` of their class, and their rank (by `rank` if there, else by name)."""
    ranked = tests if "rank" in tests.columns else tests.withColumn("rank", F.lit(0))
    whole = collapse_classes(tests).select("project", "full_class", "whole")
    return ranked.where("selected").join(whole, ["project", "full_class"])


def terms(tests: DataFrame) -> DataFrame:
    """Search terms of a selection, (project, ord, term): `class.` of whole classes, then names of the other tests."""
    chosen = _collapsed(tests)
    term = F.when(F.col("whole"), F.concat("full_class", F.lit("."))).otherwise(F.col("fqn"))
    return (
        chosen.withColumn("term", term)
        .groupBy("project", "term")
        .agg(F.min(F.struct((~F.col("whole")).alias("single"), "rank", "term")).alias("ord"))
        .select("project", "ord", "term")
    )


def _joined(rows: DataFrame, value: Column, separator: str) -> DataFrame:
    """Values of each project in the order of `ord`, joined."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", value.alias("v"))))
    return rows.groupBy("project").agg(F.array_join(F.transform(ordered, lambda s: s["v"]), separator).alias("text"))


def _passes(sizes: dict[str, int], pass_bytes: int) -> list[tuple[list[str], int, int]]:
    """(projects, part, parts) of each pass: small projects together, a large one alone and in parts."""
    out: list[tuple[list[str], int, int]] = []
    some: list[str] = []
    room = pass_bytes
    for project, size in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        if size > pass_bytes:
            parts = -(-size // pass_bytes)
            out += [([project], i, parts) for i in range(parts)]
            continue
        if size > room and some:
            out.append((some, 0, 1))
            some, room = [], pass_bytes
        some.append(project)
        room -= size
    return [*out, (some, 0, 1)] if some else out


def holding(names: DataFrame, asked: DataFrame, pass_bytes: int = 8 << 20) -> DataFrame:
    """Of `names` (project, fqn), those that hold one of the terms asked for in their project (project, term).

    Terms go out in passes of about `pass_bytes` bytes, each of whole projects or of a part of one that is larger, so a
    pass reads the names of its projects only. Names lie in files by project and name; a worker makes an Aho-Corasick
    automaton of a project's terms when it first meets the project, and reads each name once, however many terms end alike.
    Names and terms that are null are held by nothing.
    """
    asked = written(asked.where("project IS NOT NULL AND length(term) > 0").distinct(), "asked")
    sizes = asked.groupBy("project").agg(F.sum(F.octet_length("term") + F.octet_length("project")).alias("bytes")).collect()
    names = names.where("fqn IS NOT NULL").select("project", "fqn")
    if not sizes:
        return names.limit(0)
    names = names.join(asked.select("project").distinct(), "project", "left_semi")
    names = written(names.repartitionByRange(bucket_count(names.sparkSession), "project", "fqn"), "names", ("project", "fqn"))
    out = None
    for projects, part, parts in _passes({r["project"]: r["bytes"] for r in sizes}, pass_bytes):
        here = F.col("project").isin(projects)
        # Terms are distinct, so a hash deals them evenly.
        some = asked.where(here & (F.pmod(F.xxhash64("project", "term"), F.lit(parts)) == part) if parts > 1 else here)
        by_project: dict[str, list[str]] = {}
        for r in some.collect():
            by_project.setdefault(r["project"], []).append(r["term"])
        sent = names.sparkSession.sparkContext.broadcast(by_project)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            built: dict[str, object] = {}
            for batch in batches:
                keep = []
                for project, fqn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if project not in built:
                        found = ahocorasick.Automaton()
                        for term in sent.value.get(project, ()):
                            found.add_word(term, 1)
                        if len(found):
                            found.make_automaton()
                        built[project] = found if len(found) else None
                    keep.append(built[project] is not None and next(built[project].iter(fqn), None) is not None)
                yield batch.filter(pa.array(keep, pa.bool_()))

        hit = names.where(here).mapInArrow(run, names.schema)
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


@dataclass(frozen=True)
class VsTest:
    """One argument of `FullyQualifiedName~term` terms; a term is found anywhere in a name, hence extra matches."""

    name: str = "vstest"
    pass_bytes: int = 8 << 20

    def lengths(self, tests: DataFrame) -> DataFrame:
        """`arguments_length` of each project's arguments, without building them."""
        each = F.length(escape_vstest(F.col("term"))) + len("FullyQualifiedName~|")
        return terms(tests).groupBy("project").agg((F.sum(each) - 1 + len("--filter") + 6).alias("length"))

    def arguments(self, tests: DataFrame) -> DataFrame:
        each = F.concat(F.lit("FullyQualifiedName~"), escape_vstest(F.col("term")))
        return _joined(terms(tests), each, "|").select(
            "project", F.array(F.lit("--filter"), F.col("text")).alias("arguments")
        )

    def extra(self, tests: DataFrame) -> DataFrame:
        """C14: tests that aren't selected but hold a term of their project."""
        names = tests.where("selected").select("project", "fqn").distinct()
        rest = tests.where(~F.col("selected")).select("project", "fqn").distinct().join(names, ["project", "fqn"], "left_anti")
        return holding(rest, terms(tests).select("project", "term"), self.pass_bytes)


@dataclass(frozen=True)
class ClassOrMethod:
    """Repeated `--filter-class` if every selected class is whole, else repeated `--filter-method`; never extra."""

    name: str = "xunit-platform"

    def _pairs(self, tests: DataFrame) -> DataFrame:
        chosen = _collapsed(tests)
        by_class = chosen.groupBy("project").agg(F.bool_and("whole").alias("by_class"))
        pairs = chosen.join(by_class, "project").select(
            "project",
            "rank",
            F.when(F.col("by_class"), F.lit("--filter-class")).otherwise(F.lit("--filter-method")).alias("flag"),
            F.when(F.col("by_class"), F.col("full_class")).otherwise(F.col("fqn")).alias("value"),
        )
        return pairs.groupBy("project", "flag", "value").agg(F.min("rank").alias("rank"))

    def lengths(self, tests: DataFrame) -> DataFrame:
        return self._pairs(tests).groupBy("project").agg(F.sum(F.length("flag") + F.length("value") + 6).alias("length"))

    def arguments(self, tests: DataFrame) -> DataFrame:
        first = self._pairs(tests)
        listed = F.array_sort(F.collect_list(F.struct("rank", "value", "flag")))
        return first.groupBy("project").agg(
            F.flatten(F.transform(listed, lambda s: F.array(s["flag"], s["value"]))).alias("arguments")
        )

    def extra(self, tests: DataFrame) -> DataFrame:
        return tests.select("project", "fqn").limit(0)


def _space() -> Column:
    """A namespace as a path filter has it."""
    return F.when(F.coalesce("namespace", F.lit("")) == "", "*").otherwise(F.col("namespace")).alias("space")


@dataclass(frozen=True)
class TreeNode:
    """One path filter /*/namespaces/classes/methods of alternations; the product of the three is matched."""

    name: str = "treenode"

    def _parts(self, tests: DataFrame) -> DataFrame:
        def distinct(c: Column) -> Column:
            return F.array_sort(F.collect_set(c))

        return _collapsed(tests).groupBy("project").agg(
            distinct(_space()).alias("spaces"),
            distinct(F.col("class_name")).alias("classes"),
            distinct(F.col("method_name")).alias("methods"),
            F.bool_and("whole").alias("all_whole"),
        )

    def lengths(self, tests: DataFrame) -> DataFrame:
        """`arguments_length`, summed over the distinct parts."""
        chosen = written(_collapsed(tests).select("project", _space(), "class_name", "method_name", "whole"), "chosen")

        def size(c: str) -> DataFrame:
            each = chosen.select("project", c).distinct()
            return each.groupBy("project").agg((F.sum(F.length(escape_tree_node(F.col(c))) + 1) - 1).alias(c))

        whole = chosen.groupBy("project").agg(F.bool_and("whole").alias("whole"))
        sized = whole.join(size("space"), "project").join(size("class_name"), "project").join(size("method_name"), "project")
        methods = F.when(F.col("whole"), 1).otherwise(F.col("method_name"))
        fixed = len("--treenode-filter") + len("/*/") + 2 + 2 * 3
        return sized.select("project", (fixed + F.col("space") + F.col("class_name") + methods).cast("long").alias("length"))

    def arguments(self, tests: DataFrame) -> DataFrame:
        """D5, I19."""

        def either(c: str) -> Column:
            return F.array_join(F.transform(c, escape_tree_node), "|")

        methods = F.when(F.col("all_whole"), "*").otherwise(either("methods"))
        text = F.concat(F.lit("/*/"), either("spaces"), F.lit("/"), either("classes"), F.lit("/"), methods)
        return self._parts(tests).select("project", F.array(F.lit("--treenode-filter"), text).alias("arguments"))

    def extra(self, tests: DataFrame) -> DataFrame:
        """C14: unselected tests in the product of the selected namespaces, classes and methods, by a semi-join for each."""
        chosen = written(
            _collapsed(tests).select("project", F.coalesce("namespace", F.lit("")).alias("space"), "class_name", "method_name", "whole"), "chosen"
        )
        whole = chosen.groupBy("project").agg(F.bool_and("whole").alias("all_whole"))
        names = tests.where("selected").select("project", "fqn").distinct()
        rest = tests.where(~F.col("selected")).join(names, ["project", "fqn"], "left_anti").withColumn("space", F.coalesce("namespace", F.lit("")))
        for c in ("space", "class_name"):
            rest = rest.join(chosen.select("project", c).distinct(), ["project", c], "left_semi")
        methods = chosen.select("project", "method_name").distinct().withColumn("_named", F.lit(True))
        found = rest.join(whole, "project").join(methods, ["project", "method_name"], "left")
        return found.where("all_whole OR _named").select("project", "fqn").distinct()


def dialect_for(framework: str, runner: str):
    """The dialect of a framework and a runner."""
    if framework == "TUnit":
        return TreeNode()
    if (framework, runner) == ("XUnitV3", "MicrosoftTestingPlatform"):
        return ClassOrMethod()
    return VsTest()


def dialect_name(framework: Column, runner: Column) -> Column:
    """`dialect_for` as a column."""
    platform = (framework == "XUnitV3") & (runner == "MicrosoftTestingPlatform")
    return F.when(framework == "TUnit", TreeNode.name).when(platform, ClassOrMethod.name).otherwise(VsTest.name)


@dataclass(frozen=True)
class ByProject:
    """Each project's own dialect, named in the tests' column `dialect` (null: that of VSTest)."""

    name: str = "by-project"

    def _each(self, tests: DataFrame, what: str) -> DataFrame:
        own = F.coalesce("dialect", F.lit(VsTest.name))
        return union_all([getattr(d, what)(tests.where(own == d.name)) for d in (VsTest(), ClassOrMethod(), TreeNode())])

    def lengths(self, tests: DataFrame) -> DataFrame:
        return self._each(tests, "lengths")

    def arguments(self, tests: DataFrame) -> DataFrame:
        return self._each(tests, "arguments")

    def extra(self, tests: DataFrame) -> DataFrame:
        return self._each(tests, "extra")


def filter_plans(
    tests: DataFrame,
    dialect,
    coverage: float = COVERAGE_LIMIT,
    length_limit: int = FILTER_LENGTH_LIMIT,
    extras: DataFrame | None = None,
) -> DataFrame:
    """Per project selected, total, filtered, reason, arguments, and how many unselected tests the filter runs as well.

    No filter if nothing is selected, the selection is `coverage` or more of the project, or the filter would be too long.
    `extras`: what `dialect.extra` gives for the tests, if it is there already. Lengths are summed first, and only filters
    that will be used are built.
    """
    counts = tests.groupBy("project").agg(F.count_if("selected").alias("selected"), F.count("*").alias("total"))
    reason = (
        F.when(F.col("selected") == 0, "nothing selected")
        .when(F.col("selected") / F.col("total") >= coverage, "most of the project is selected")
        .when(F.coalesce("length", F.lit(0)) == 0, "the selection can't be a filter")
        .when(F.col("length") > length_limit, "the filter would be too long")
    )
    sized = counts.join(dialect.lengths(tests), "project", "left").withColumn("reason", reason)
    reasoned = written(sized.withColumn("filtered", F.col("reason").isNull()), "reasons")
    used = tests.join(reasoned.where("filtered").select("project"), "project", "left_semi")
    reasoned = reasoned.join(dialect.arguments(used), "project", "left")
    more = (dialect.extra(tests) if extras is None else extras).groupBy("project").agg(F.count("*").alias("more"))
    return reasoned.join(more, "project", "left").select(
        "project",
        "selected",
        "total",
        "filtered",
        "reason",
        "arguments",
        F.when(F.col("filtered"), F.coalesce("more", F.lit(0))).otherwise(0).alias("extra_matches"),
    )


def wave_plans(
    tests: DataFrame, dialect, length_limit: int = FILTER_LENGTH_LIMIT, extras: DataFrame | None = None
) -> DataFrame:
    """Per project whether its selection runs in two waves, and why not; `extras` as for `filter_plans`.

    `tests` also has in_wave (of selected ones). Reasons in order: few, one_class, most, inexpressible (a wave that the
    dialect has no filter for), long, overlap, beyond.
    """
    wave = tests.withColumn("selected", F.col("selected") & F.coalesce("in_wave", F.lit(False)))
    rest = tests.withColumn("selected", F.col("selected") & ~F.coalesce("in_wave", F.lit(False)))
    counts = tests.groupBy("project").agg(
        F.count_if("selected").alias("selected"), F.count_if(F.col("selected") & F.col("in_wave")).alias("wave")
    )

    def sized(t: DataFrame, name: str) -> DataFrame:
        return dialect.lengths(t).withColumnRenamed("length", name)

    extra_wave, extra_rest = written(dialect.extra(wave), "extras"), written(dialect.extra(rest), "extras")
    wave_names = wave.where("selected").select("project", "fqn").distinct()
    rest_names = rest.where("selected").select("project", "fqn").distinct()
    both = extra_wave.intersect(rest_names).unionByName(extra_rest.intersect(wave_names))
    overlap = both.groupBy("project").agg(F.count("*").alias("overlap"))
    single = tests.where("selected").select("project", "fqn").unionByName(dialect.extra(tests) if extras is None else extras)
    outside = extra_wave.unionByName(extra_rest).subtract(single.distinct())
    beyond = outside.groupBy("project").agg(F.count("*").alias("beyond"))
    all_of = (
        counts.join(sized(wave, "wave_length"), "project", "left")
        .join(sized(rest, "rest_length"), "project", "left")
        .join(overlap, "project", "left")
        .join(beyond, "project", "left")
    )
    reason = (
        F.when(F.col("selected") < WAVE_LEAST_TESTS, "few")
        .when(F.col("wave") == F.col("selected"), "one_class")
        .when(F.col("wave") * 2 > F.col("selected"), "most")
        .when(F.coalesce("wave_length", F.lit(0)) * F.coalesce("rest_length", F.lit(0)) == 0, "inexpressible")
        .when(F.greatest("wave_length", "rest_length") > length_limit, "long")
        .when(F.coalesce("overlap", F.lit(0)) > 0, "overlap")
        .when(F.coalesce("beyond", F.lit(0)) > 0, "beyond")
    )
    return all_of.select("project", "selected", "wave", reason.alias("reason"), reason.isNull().alias("split"))
