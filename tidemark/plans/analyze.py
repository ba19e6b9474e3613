"""The whole analysis: from changed lines and graph fragments to ordered tests and a plan for each project."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import file_name
from ..operators import changes, filters, graph, report, routes, safety, selection, typeflow
from ..schemas import GENERATED, OLD_DECLS
from .fixpoint import union_all
from .workdir import written


@dataclass
class Inputs:
    """Tables of `tidemark.schemas`; those of extractors may be left out.

    `diff` is what `changes.resolve_diff` gives: each changed file's ranges on both sides. `documents` says which projects
    compile a file (project, file). `old_decls` are the declarations of changed files at the base revision (file is the
    old path), `foreign` the projects of other languages (name, language, dir), `project_files` every project file there
    is (path), `fragments` the projects with a graph (project), `file_errors` files that don't compile (project, file,
    error) of any project, changed or not, `failures` why a project didn't load (reason), `diagnostics` the same as a
    loader tells it (project, code, message, declared_frameworks, registered), `generated_docs` the types of generated
    documents (project, hint, key). `diff_problem` says why the diff can't be trusted, `branch` where the head is.
    `projects` may tell framework and runner, which choose a project's dialect.
    """

    nodes: DataFrame
    edges: DataFrame
    documents: DataFrame
    sites: DataFrame
    projects: DataFrame
    project_refs: DataFrame
    tests: DataFrame
    diff: DataFrame
    routes: DataFrame
    reflections: DataFrame
    old_decls: DataFrame | None = None
    global_usings: DataFrame | None = None
    trivia_files: DataFrame | None = None
    generated: DataFrame | None = None
    generated_docs: DataFrame | None = None
    foreign: DataFrame | None = None
    project_files: DataFrame | None = None
    fragments: DataFrame | None = None
    file_errors: DataFrame | None = None
    failures: DataFrame | None = None
    type_facts: DataFrame | None = None
    diagnostics: DataFrame | None = None
    diff_problem: str | None = None
    branch: str | None = None


class UnusableInput(ValueError):
    """An input that the analysis can't work with; with `fallback` it means a full run."""


#: Columns that an extractor has to give.
_DEMANDED = {
    "nodes": ("key", "kind", "project", "containing_type"), "edges": ("src", "dst", "kind"), "documents": ("project", "file"),
    "sites": ("project", "file", "start_line", "end_line", "key"), "projects": ("name", "dir"), "project_refs": ("project", "references"),
    "tests": ("symbol_key", "class_key", "project"), "diff": ("path", "old_path", "kind", "side", "ranges"),
}


def check_inputs(inputs: Inputs) -> None:
    """Raise UnusableInput if a table lacks a column."""
    for name, columns in _DEMANDED.items():
        missing = [c for c in columns if c not in getattr(inputs, name).columns]
        if missing:
            raise UnusableInput(f"{name} has no {', '.join(missing)}")


@dataclass
class Options:
    """`dialect`: one for all projects, without it each project's own; `default_branch`: where selection isn't asked for.

    `told`: reasons that an outcome lists; all of them are in its `reason_rows`.
    """

    full: bool = False
    fallback: bool = True
    coverage: float = 0.6
    length_limit: int = 200_000
    dialect: object | None = None
    default_branch: str | None = None
    told: int = 100


@dataclass
class Outcome:
    """`reasons`: why it is a full run, empty if it isn't: the first by text, then how many more; all in `reason_rows`. `tests`: ranked; `plans`, `waves`, `totals`, `widenings`.

    `extras`: unselected tests (project, fqn) that a filter of `plans` runs as well. `walked`: impacted keys with hops and
    predecessors, for `report.explain`.
    """

    reasons: list[str]
    changes: changes.ChangeSet | None
    walked: DataFrame | None
    tests: DataFrame
    plans: DataFrame
    waves: DataFrame
    totals: DataFrame
    extras: DataFrame
    widenings: DataFrame | None
    changed_symbols: int
    reason_rows: DataFrame | None = None


def _or_empty(df: DataFrame | None, inputs: Inputs, schema: str) -> DataFrame:
    return inputs.nodes.sparkSession.createDataFrame([], schema) if df is None else df


def changed_files(inputs: Inputs) -> DataFrame:
    """(path, old_path, kind) of every changed file."""
    return inputs.diff.select("path", "old_path", "kind").distinct()


def content_changes(inputs: Inputs) -> tuple[DataFrame, DataFrame]:
    """Files that are no source: (widenings, errors).

    One widens the project whose folder holds it; else the project of another language that does, of which nothing else
    is known; one that lies below a project file that isn't loaded can't be placed at all, which is an error. Others say
    nothing.
    """
    content = changed_files(inputs).where(safety.is_content(F.col("path"))).select("path").distinct()
    owned = written(changes.owning_project(content, inputs.projects.withColumn("ord", F.col("name"))), "content")
    wide = owned.where(F.col("name").isNotNull()).select(
        F.col("name").alias("project"),
        F.lit("ContentFile").alias("cause"),
        F.concat("path", F.lit(" isn't source and may be read at run time")).alias("detail"),
    )
    foreign = _or_empty(inputs.foreign, inputs, "name string, language string, dir string").withColumn("ord", F.col("name"))
    free = owned.where(F.col("name").isNull()).select("path")
    abroad = written(changes.owning_project(free, foreign).join(foreign.select("name", "language"), "name", "left"), "foreign")
    wide_abroad = abroad.where(F.col("name").isNotNull()).select(
        F.col("name").alias("project"),
        F.lit("ForeignLanguage").alias("cause"),
        F.concat("path", F.lit(" is "), "language", F.lit(", of which no symbol is known")).alias("detail"),
    )
    nowhere = abroad.where(F.col("name").isNull()).select("path")
    listing = _or_empty(inputs.project_files, inputs, "path string")
    errors = changes.nearest_project_file(nowhere, listing).select(
        F.concat("path", F.lit(" belongs to "), file_name(F.col("project_file")), F.lit(", which isn't loaded")).alias("reason")
    )
    return wide.unionByName(wide_abroad).withColumn("widens", F.lit(True)), errors


def _ranges(diff: DataFrame, side: str) -> DataFrame:
    """(path, kind, old_path, start_line, end_line) of a side's ranges."""
    rows = diff.where(F.col("side") == side).select("path", "old_path", "kind", F.explode("ranges").alias("r"))
    return rows.select("path", "old_path", "kind", "r.start_line", "r.end_line")


def source_changes(inputs: Inputs) -> tuple[changes.ChangeSet, DataFrame]:
    """Source files on both sides: (change set, errors).

    On the new side a file counts in every project that compiles it; on the old side, where deleted code is, in the
    project whose folder holds its old path, else in one that compiles it now. A modified file of which only comments or
    layout changed in all its projects leaves a note and nothing else, unless a project's generators could read them.
    """
    session = inputs.nodes.sparkSession
    source = inputs.diff.where(changes.is_source(F.col("path")))
    emitting = _or_empty(inputs.generated, inputs, GENERATED).select("project").distinct()
    modified = source.where("kind = 'Modified'").select(F.col("path").alias("file")).distinct()
    trivia = (
        _or_empty(inputs.trivia_files, inputs, "project string, file string")
        .select("project", "file")
        .distinct()
        .join(emitting, "project", "left_anti")
        .join(modified, "file", "left_semi")
    )
    here = source.where("kind <> 'Deleted'").select(F.col("path").alias("file"), "kind").distinct()
    compiled = written(inputs.documents.select("project", "file").distinct().join(here, "file"), "compiled")
    real = written(compiled.join(trivia, ["project", "file"], "left_anti"), "real")
    quiet = compiled.select("file").distinct().join(real, "file", "left_anti")
    notes = quiet.select(F.concat("file", F.lit(": only comments or formatting")).alias("detail"))

    broken = _or_empty(inputs.file_errors, inputs, "project string, file string, error string").join(real, ["project", "file"], "left_semi")
    errors = broken.groupBy("file").agg(F.min("error").alias("error")).select(
        F.concat("file", F.lit(" doesn't compile: "), "error").alias("reason")
    )
    if inputs.fragments is not None:
        unknown = real.join(inputs.fragments.select("project"), "project", "left_anti")
        errors = errors.unionByName(
            unknown.select(F.concat("file", F.lit(": what "), "project", F.lit(" declares isn't known")).alias("reason"))
        )

    new = _ranges(source, "new").select(F.col("path").alias("file"), "start_line", "end_line").join(real, "file")
    declared = changes.changed_declarations(new.select("project", "file", "start_line", "end_line"), inputs.sites, bucket=256)
    usings = _or_empty(inputs.global_usings, inputs, "project string, file string, start_line int, end_line int")
    found = changes.new_side(written(declared, "declared"), inputs.nodes, real.where("kind = 'Added'"), usings)

    old = _ranges(source, "old").where("kind <> 'Added'").join(quiet, F.col("path") == F.col("file"), "left_anti")
    old = old.withColumn("new_path", F.col("path")).withColumn("path", F.coalesce("old_path", "path"))
    first = compiled.groupBy(F.col("file").alias("new_path")).agg(F.min("project").alias("_now"))
    owned = changes.owning_project(old, inputs.projects.withColumn("ord", F.col("name"))).join(first, "new_path", "left")
    placed = owned.select(F.coalesce("name", "_now").alias("project"), F.col("path").alias("file"), "start_line", "end_line")
    placed = written(placed.where(F.col("project").isNotNull()).distinct(), "old")
    decls = _or_empty(inputs.old_decls, inputs, OLD_DECLS).drop("project").distinct()
    by_project = decls.join(placed.select("project", "file").distinct(), "file")
    before = written(changes.old_side(placed, by_project, *changes.declared_names(inputs.nodes)), "before")
    none = session.createDataFrame([], "detail string")
    noted = changes.ChangeSet(found.seeds.limit(0), found.widenings.limit(0), none, notes)
    return found.union(changes.old_side_changes(before)).union(noted), errors


def emitted_changes(inputs: Inputs) -> changes.ChangeSet | None:
    """Generated code of the projects that hold a changed file; one that holds another file than source can't be compared."""
    if inputs.generated is None:
        return None
    files = changes.owning_project(changed_files(inputs).select("path").distinct(), inputs.projects.withColumn("ord", F.col("name")))
    held = written(files.where(F.col("name").isNotNull()).select(F.col("name").alias("project"), "path"), "held")
    generated = inputs.generated.join(held.select("project").distinct(), "project", "left_semi")
    docs = _or_empty(inputs.generated_docs, inputs, "project string, hint string, key string")
    return changes.generated_changes(generated, docs, held.where(~changes.is_source(F.col("path"))))


def resolve_changes(inputs: Inputs) -> tuple[changes.ChangeSet, DataFrame]:
    """L2: (change set of all changed files, errors (reason) that ask for a full run)."""
    wide, outside = content_changes(inputs)
    found, broken = source_changes(inputs)
    empty = found.notes.limit(0)
    found = found.union(changes.ChangeSet(found.seeds.limit(0), wide, empty, empty))
    emitted = emitted_changes(inputs)
    return (found.union(emitted) if emitted else found), outside.unionByName(broken)


def full_run_rows(inputs: Inputs, options: Options) -> DataFrame:
    """(part, reason): why no narrower run is safe, known before anything is resolved.

    Asked for, on the default branch, a diff that can't be trusted, projects that didn't load, files that steer every build,
    and projects that don't compile, whether they changed or not: nothing can be said of their tests.
    """
    session = inputs.nodes.sparkSession
    given = ["a full run was asked for"] if options.full else []
    if options.default_branch and inputs.branch == options.default_branch:
        given.append(f"the head is on {options.default_branch}, where nothing is left out")
    if inputs.diff_problem:
        given.append(inputs.diff_problem)
    rows = session.createDataFrame([(0, r) for r in given], "part int, reason string")
    failed = _or_empty(inputs.failures, inputs, "reason string").select("reason")
    if inputs.diagnostics is not None:
        # An SDK that is too old is told as such, anything else as it came.
        described = safety.sdk_mismatch(inputs.diagnostics).select(*[F.col(c).alias(f"_{c}") for c in ("project", "code", "message")], "described")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("project", "code", "message")]
        told = inputs.diagnostics.join(described.distinct(), same, "left")
        failed = failed.unionByName(told.select(F.coalesce("described", "message").alias("reason")))
    asked = safety.full_run_reasons(changed_files(inputs)).select("reason")
    broken = _or_empty(inputs.file_errors, inputs, "project string, file string, error string").groupBy("project").agg(
        F.min(F.struct("file", "error")).alias("first"), F.count("*").alias("n")
    )
    errors = broken.select(
        F.concat("project", F.lit(" doesn't compile: "), "first.file", F.lit(": "), "first.error", F.when(F.col("n") > 1, F.concat(F.lit(" and "), (F.col("n") - 1).cast("string"), F.lit(" more"))).otherwise("")).alias("reason")
    )
    for part, df in ((1, failed), (2, asked), (3, errors)):
        rows = rows.unionByName(df.distinct().select(F.lit(part).alias("part"), "reason"))
    return rows


def _told(rows: DataFrame, most: int) -> list[str]:
    """The first reasons, and how many more there are."""
    first = [r["reason"] for r in rows.orderBy("part", "reason").limit(most + 1).collect()]
    if len(first) <= most:
        return first
    return [*first[:most], f"and {rows.count() - most} more"]


def full_run_reasons(inputs: Inputs, options: Options) -> list[str]:
    """The first of `full_run_rows`, as texts."""
    return _told(full_run_rows(inputs, options), options.told)


def analyze(inputs: Inputs, options: Options | None = None) -> Outcome:
    """An input that can't be used means a full run if `fallback` is on; failures of Spark itself are raised."""
    options = options or Options()
    try:
        check_inputs(inputs)
    except UnusableInput as e:
        if not options.fallback:
            raise
        rows = inputs.nodes.sparkSession.createDataFrame([(0, f"the analysis can't be done: {e}")], "part int, reason string")
        return _full(inputs, options, rows)
    rows = written(full_run_rows(inputs, options), "reasons")
    return _selective(inputs, options) if rows.isEmpty() else _full(inputs, options, rows)


def _named_tests(inputs: Inputs, options: Options) -> tuple[DataFrame, object]:
    """Tests with their names, and the dialect of their filters."""
    named = selection.named_tests(inputs.tests)
    if options.dialect is not None:
        return named, options.dialect
    if not {"framework", "runner"} <= set(inputs.projects.columns):
        return named, filters.VsTest()
    chosen = inputs.projects.select(F.col("name").alias("project"), filters.dialect_name(F.col("framework"), F.col("runner")).alias("dialect"))
    return named.join(chosen, "project", "left"), filters.ByProject()


def _plans(tests: DataFrame, dialect: object, options: Options) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    extras = written(dialect.extra(tests), "extras")
    plans = written(filters.filter_plans(tests, dialect, options.coverage, options.length_limit, extras), "plans")
    waves = filters.wave_plans(tests, dialect, options.length_limit, extras)
    run = extras.join(plans.where("filtered").select("project"), "project", "left_semi")
    return plans, waves, report.project_totals(tests, plans), run


def _full(inputs: Inputs, options: Options, rows: DataFrame) -> Outcome:
    named, dialect = _named_tests(inputs, options)
    everything = selection.run_order(named.withColumn("hops", F.lit(1)))
    tests = written(selection.first_wave(everything).withColumn("selected", F.lit(True)), "tests")
    return Outcome(_told(rows, options.told), None, None, tests, *_plans(tests, dialect, options), None, 0, rows.select("reason"))


def _selective(inputs: Inputs, options: Options) -> Outcome:
    found, errors = resolve_changes(inputs)
    errors = written(errors.distinct().withColumn("part", F.lit(0)), "errors")
    if not errors.isEmpty():
        return _full(inputs, options, errors)
    found = found.kept()
    changed_symbols = found.seeds.count()
    by_route = routes.changed_templates(inputs.routes, _ranges(inputs.diff, "new").withColumn("side", F.lit("new")))
    found.widenings = found.widenings.unionByName(
        by_route.select("project", F.lit("Route").alias("cause"), F.col("template").alias("detail"), F.lit(True).alias("widens"))
    )
    found = changes.seed_reflections(found, inputs.reflections)
    edges = written(graph.merge_edges(inputs.edges, routes.match_routes(inputs.routes)), "edges")
    prepared = graph.Graph(inputs.nodes, edges)
    narrow = None
    if inputs.type_facts is not None:
        reflecting = inputs.reflections.where("owner IS NOT NULL").select(
            F.col("owner").alias("member"), F.array().cast("array<string>").alias("obtained"), F.lit(True).alias("is_unknown")
        )
        facts = inputs.type_facts.unionByName(reflecting)
        known, unknown = typeflow.obtainable(inputs.nodes, edges, facts)
        bounded = typeflow.bounded_types(inputs.nodes, edges)
        narrow = lambda pairs: typeflow.narrow(pairs, bounded, facts, known, unknown)
    walked = written(graph.traverse(prepared, found.seeds, narrow, predecessors=True), "impacted")
    wide = found.widenings.where("widens").select("project").distinct()
    closed = written(graph.project_closure(inputs.project_refs, wide), "widened")
    named, dialect = _named_tests(inputs, options)
    chosen = selection.first_wave(selection.run_order(selection.select_tests(named, walked, closed)))
    marks = chosen.select("project", "symbol_key", "hops", "rank", "in_wave", F.lit(True).alias("chosen"))
    tests = written(
        named.join(marks, ["project", "symbol_key"], "left").withColumn("selected", F.coalesce("chosen", F.lit(False))).drop("chosen"),
        "tests",
    )
    plans, waves, totals, extras = _plans(tests, dialect, options)
    told = report.all_widenings(found.widenings, closed, found.unmapped, plans)
    return Outcome([], found, walked, tests, plans, waves, totals, extras, told, changed_symbols)


def merge_fragments(reused: list[DataFrame], rebuilt: list[DataFrame]) -> DataFrame:
    """L1: rows of fragments that are reused and of those built anew, in that order of precedence."""
    return union_all([*reused, *rebuilt])
