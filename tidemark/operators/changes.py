"""From changed files and lines to seeds, project widenings and notes."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import file_name, normalize_path, simple_name, type_path
from ..plans.fixpoint import union_all
from ..plans.intervals import interval_join, longest_prefix
from ..plans.workdir import written
from ..schemas import OUTPUT_FOLDERS, WHOLE_FILE

#: Tiers of a changed range: inside a member, inside a type, elsewhere in a file.
MEMBER, TYPE, FILE = 1, 2, 3


def is_derived_output(path: Column) -> Column:
    """A folder of the path holds derived output; the file's own name doesn't count."""
    parts = F.split(normalize_path(path), "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*map(F.lit, OUTPUT_FOLDERS)))


def is_source(path: Column) -> Column:
    return F.endswith(F.lower(path), F.lit(".cs"))


def resolve_diff(changed: DataFrame, hunks: DataFrame, untracked: DataFrame) -> DataFrame:
    """One row for each side of each changed file with its ranges.

    Derived output goes; untracked files are added ones unless the diff has them; ranges are found by the new path, else by
    the old one; a source file without any is changed as a whole (on the old side only if it isn't new); other files
    have none. Columns path, old_path, kind, side, ranges (array of start, end).
    """
    seen = changed.select("path")
    added = (
        untracked.select("path")
        .distinct()
        .join(seen, "path", "left_anti")
        .select("path", F.lit(None).cast("string").alias("old_path"), F.lit("Added").alias("kind"))
    )
    files = changed.unionByName(added).where(~is_derived_output(F.col("path")))
    ranges = hunks.groupBy("path", "side").agg(
        F.array_sort(F.collect_set(F.struct("start_line", "end_line"))).alias("found")
    )
    sides = files.withColumn("side", F.explode(F.array(F.lit("old"), F.lit("new"))))
    by_new = ranges.select("path", "side", F.col("found").alias("by_new"))
    by_old = ranges.select(F.col("path").alias("old_path"), "side", F.col("found").alias("by_old"))
    joined = sides.join(by_new, ["path", "side"], "left").join(by_old, ["old_path", "side"], "left")
    start, end = WHOLE_FILE
    whole = F.array(F.struct(F.lit(start).alias("start_line"), F.lit(end).alias("end_line")))
    none = F.array().cast("array<struct<start_line:int,end_line:int>>")
    known = F.coalesce("by_new", "by_old")
    any_side = F.max(known.isNotNull()).over(Window.partitionBy("path", "old_path", "kind"))
    return joined.withColumn("any_side", any_side).select(
        "path",
        "old_path",
        "kind",
        "side",
        F.when(~is_source(F.col("path")), none)
        .when(F.col("any_side"), F.coalesce(known, none))
        .when((F.col("side") == "old") & (F.col("kind") == "Added"), none)
        .otherwise(whole)
        .alias("ranges"),
    )


def changed_declarations(hunks: DataFrame, sites: DataFrame, bucket: int | None = None) -> DataFrame:
    """Declarations that changed ranges touch, by tier.

    `hunks`: project, file, start_line, end_line. A range inside members is theirs alone; else the types around it; else
    every type of the file (L4); else it is unmapped, with a null key. Columns project, file, start_line, end_line, tier,
    key, is_inlined.
    """
    on = ["project", "file"]
    site = sites.select(*on, F.col("start_line").alias("s"), F.col("end_line").alias("e"), "key", "is_type", "is_inlined")
    touched = interval_join(hunks, site, on, ("start_line", "end_line"), ("s", "e"), bucket)
    hunk = [*on, "start_line", "end_line"]
    named = touched.select(*hunk, F.when(F.col("is_type"), TYPE).otherwise(MEMBER).alias("tier"), "key", "is_inlined")
    # Every range is in its own file; one shuffle by range finds its least tier and drops repeats.
    whole = hunks.select(*hunk, F.lit(FILE).alias("tier"), F.lit(None).cast("string").alias("key"), F.lit(False).alias("is_inlined"))
    tiers = named.unionByName(whole).withColumn("least", F.min("tier").over(Window.partitionBy(*hunk)))
    best = written(tiers.where("tier = least").drop("least").distinct(), "touched")
    types = sites.where("is_type").select(*on, "key").distinct()
    elsewhere = best.where(F.col("tier") == FILE).drop("key").join(types, on, "left")
    return best.where(F.col("tier") != FILE).unionByName(elsewhere)


@dataclass
class ChangeSet:
    """Seeds (key), widenings (project, cause, detail, widens), unmapped (detail), notes (detail)."""

    seeds: DataFrame
    widenings: DataFrame
    unmapped: DataFrame
    notes: DataFrame

    def kept(self) -> ChangeSet:
        """The same as written tables."""
        return ChangeSet(*[written(getattr(self, f.name), f.name) for f in fields(self)])

    def union(self, other: ChangeSet) -> ChangeSet:
        """H1: seeds and widenings once, unmapped and notes as they are."""
        return ChangeSet(
            self.seeds.unionByName(other.seeds).distinct(),
            self.widenings.unionByName(other.widenings).dropDuplicates(["project", "cause", "detail"]),
            self.unmapped.unionByName(other.unmapped),
            self.notes.unionByName(other.notes),
        )


def _widening(project: Column, cause: str, detail: Column, widens: Column | bool = True) -> list[Column]:
    w = widens if isinstance(widens, Column) else F.lit(widens)
    return [project.alias("project"), F.lit(cause).alias("cause"), detail.alias("detail"), w.alias("widens")]


def new_side(declared: DataFrame, nodes: DataFrame, new_files: DataFrame, global_usings: DataFrame) -> ChangeSet:
    """L3, L4: what `changed_declarations` means.

    An inlined member seeds its containing type and, unless its file is new, widens the project. A range outside all
    declarations that touches a global using widens the project and seeds nothing.
    """
    spark = declared.sparkSession
    hunk = ["project", "file", "start_line", "end_line"]
    usings = global_usings.select("project", "file", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    out_of_all = declared.where(F.col("tier") == FILE)
    by_using = interval_join(
        out_of_all.select(*hunk).distinct(), usings, ["project", "file"], ("start_line", "end_line"), ("s", "e")
    ).select(*hunk).distinct()
    mapped = declared.join(by_using, hunk, "left_anti")
    owners = nodes.select("key", "containing_type", "display")
    found = mapped.where(F.col("key").isNotNull()).join(owners, "key", "left")
    seeds = found.select(F.when(F.col("is_inlined"), F.col("containing_type")).otherwise(F.col("key")).alias("key"))
    inlined = found.where("is_inlined").join(new_files.select("project", "file"), ["project", "file"], "left_anti")
    widenings = inlined.select(
        *_widening(
            F.col("project"),
            "ConstantInlining",
            F.concat(F.coalesce("display", "key"), F.lit(": its value is copied to where it is used")),
        )
    ).unionByName(
        by_using.select(
            *_widening(
                F.col("project"),
                "GlobalUsing",
                F.concat(
                    file_name(F.col("file")),
                    F.lit(" line "),
                    F.concat_ws("-", "start_line", "end_line"),
                    F.lit(": a directive for the whole file or project changed"),
                ),
            )
        )
    )
    lost = mapped.where(F.col("key").isNull()).select(
        F.concat(F.col("file"), F.lit(":"), F.concat_ws("-", "start_line", "end_line")).alias("detail")
    )
    notes = spark.createDataFrame([], "detail string")
    return ChangeSet(
        seeds.where(F.col("key").isNotNull()).distinct(),
        widenings.dropDuplicates(["project", "cause", "detail"]),
        lost,
        notes,
    )


def old_side(hunks: DataFrame, old_decls: DataFrame, types: DataFrame, members: DataFrame) -> DataFrame:
    """Seeds and deleted types of old-side ranges; columns project, file, type_path, key (null: deleted type).

    Old declarations are touched members first, else types. A type path finds current types (`types`: type_path, type, and
    project if only the project's own count); a member name finds all current members of that name (`members`: type,
    member_name, member), else the type stands for it. A declaration outside every type (null type_path) says nothing.
    """
    on = ["project", "file"]
    hunk = [*on, "start_line", "end_line"]
    decl = old_decls.select(
        *on, F.col("start_line").alias("s"), F.col("end_line").alias("e"), "is_type", "type_path", "member_name"
    )
    touched = written(interval_join(hunks, decl, on, ("start_line", "end_line"), ("s", "e")), "touched")
    tier = F.when(F.col("is_type"), TYPE).otherwise(MEMBER)
    best = touched.groupBy(*hunk).agg(F.min(tier).alias("tier"))
    kept = touched.withColumn("tier", tier).join(best, [*hunk, "tier"])
    asked = kept.select(*on, "type_path", F.when(F.col("tier") == MEMBER, F.col("member_name")).alias("member_name"))
    by = ["project", "type_path"] if "project" in types.columns else ["type_path"]
    with_type = asked.where(F.col("type_path").isNotNull()).distinct().join(types, by, "left")
    with_member = with_type.join(members, ["type", "member_name"], "left")
    return with_member.select(*on, "type_path", F.coalesce("member", "type").alias("key")).distinct()


def old_side_changes(found: DataFrame) -> ChangeSet:
    """What `old_side` means: seeds, and a widening for each type that isn't declared any more."""
    gone = found.where(F.col("key").isNull())
    detail = F.concat("type_path", F.lit(" was declared in "), "file", F.lit(" and is gone"))
    empty = found.select(F.col("file").alias("detail")).limit(0)
    return ChangeSet(
        found.where(F.col("key").isNotNull()).select("key").distinct(),
        gone.select(*_widening(F.col("project"), "DeletedType", detail)).distinct(),
        empty,
        empty,
    )


def declared_names(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Types (project, type_path, type) and members (type, member_name, member) that nodes declare, for `old_side`."""
    paths = nodes.where(F.col("kind") == "Type").select("project", type_path(F.col("key")).alias("type_path"), F.col("key").alias("type"))
    names = nodes.where(F.col("containing_type").isNotNull()).select(
        F.col("containing_type").alias("type"), simple_name(F.col("key")).alias("member_name"), F.col("key").alias("member")
    )
    return paths.where(F.col("type_path").isNotNull()).distinct(), names.where(F.col("member_name").isNotNull()).distinct()


def _rooted(path: Column) -> Column:
    """Relative paths behind a common root, so that the root's own folder is a prefix too."""
    plain = F.when(path.isin("", "."), F.lit("")).otherwise(F.concat(F.lit("/"), path))
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("."), plain))


def _owned(files: DataFrame, folders: DataFrame) -> DataFrame:
    """`longest_prefix` of rooted paths; the folders' columns stay as they are, `dir` aside."""
    rooted = files.withColumn("_path", _rooted(F.col("path")))
    found = longest_prefix(rooted, "_path", folders.withColumn("_dir", _rooted(F.col("dir"))), "_dir", "ord")
    return found.drop("_path", "_dir")


def owning_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Each file with the project whose folder is its longest prefix; of equal folders the first by `ord`."""
    return _owned(files, projects.select("dir", "name", "ord"))


def nearest_project_file(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Unowned non-source files below a project file that isn't loaded; (path, project_file)."""
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    folders = listing.where(F.lower("path").rlike(r"\.[^./]*proj$")).select(
        folder.alias("dir"), F.col("path").alias("project_file"), F.col("path").alias("ord")
    )
    found = _owned(files.where(~is_source(F.col("path"))).select("path").distinct(), folders)
    return found.where(F.col("project_file").isNotNull()).select("path", "project_file")


def generated_diff(generated: DataFrame, inexact: DataFrame | None = None) -> DataFrame:
    """Per project what its generated documents say; (project, emitted, changed, missing, verdict).

    Nothing emitted says nothing; output that isn't in the compilation widens the project; a document missing at head, or
    a project of `inexact`, makes the comparison inexact and seeds all; else the changed ones are seeded, or only a note
    is left.
    """
    differs = ~F.col("base_text").eqNullSafe(F.col("head_text"))
    missing = F.col("head_text").isNull()
    summed = generated.groupBy("project").agg(
        F.count("hint").alias("emitted"),
        F.count_if(differs & ~missing).alias("changed"),
        F.count_if(missing).alias("missing"),
        F.bool_and("in_compilation").alias("inside"),
    )
    if inexact is not None:
        marks = inexact.select("project").distinct().withColumn("doubt", F.lit(True))
        summed = summed.join(marks, "project", "left")
    else:
        summed = summed.withColumn("doubt", F.lit(None).cast("boolean"))
    verdict = (
        F.when(F.col("emitted") == 0, "none")
        .when(~F.coalesce("inside", F.lit(False)), "widen")
        .when((F.col("missing") > 0) | F.coalesce("doubt", F.lit(False)), "all")
        .when(F.col("changed") == 0, "note")
        .otherwise("changed")
    )
    return summed.withColumn("verdict", verdict).drop("inside", "doubt")


def generated_seeds(generated: DataFrame, docs: DataFrame, inexact: DataFrame | None = None) -> DataFrame:
    """Types (project, key) of the generated documents that `generated_diff` tells to seed; `docs`: project, hint, key."""
    verdicts = generated_diff(generated, inexact).select("project", "verdict")
    changed = generated.where(~F.col("base_text").eqNullSafe(F.col("head_text"))).select("project", "hint")
    everything = docs.join(verdicts.where("verdict = 'all'"), "project", "left_semi")
    some = docs.join(verdicts.where("verdict = 'changed'"), "project", "left_semi").join(
        changed, ["project", "hint"], "left_semi"
    )
    return union_all([everything, some]).select("project", "key").distinct()


def generated_changes(generated: DataFrame, docs: DataFrame, inexact: DataFrame | None = None) -> ChangeSet:
    """What the generated documents of changed projects mean: seeds, and what is told of each project that emits any."""
    verdicts = generated_diff(generated, inexact).where("verdict <> 'none'")
    said = (
        F.when(F.col("verdict") == "widen", "its generated documents aren't part of what was analysed")
        .when(F.col("verdict") == "all", "its generators can't be run again faithfully, so all they emit counts as changed")
        .when(F.col("verdict") == "note", "its generators emit what they did before")
        .otherwise(F.concat(F.col("changed").cast("string"), F.lit(" of its generated documents changed")))
    )
    told = verdicts.select(*_widening(F.col("project"), "SourceGenerator", said, F.col("verdict") == "widen"))
    empty = told.select("detail").limit(0)
    return ChangeSet(generated_seeds(generated, docs, inexact).select("key").distinct(), told, empty, empty)


def trivia_only(changes: DataFrame) -> DataFrame:
    """Whether old and new tokens are the same sequence; `changes`: kind, has_generated, old_tokens, new_tokens."""
    same = F.col("old_tokens").eqNullSafe(F.col("new_tokens")) & F.col("old_tokens").isNotNull()
    gate = (F.col("kind") == "Modified") & ~F.col("has_generated")
    return changes.withColumn("trivia_only", gate & same)


def seed_reflections(changes: ChangeSet, reflections: DataFrame) -> ChangeSet:
    """Members that reflect are seeds of every change set that isn't empty.

    Each file reports its first use and how many more, without widening; a use outside any member widens its project.
    """
    if changes.seeds.isEmpty() and changes.widenings.isEmpty():
        return changes
    name = file_name(F.col("file"))
    owners = reflections.where(F.col("owner").isNotNull()).select(F.col("owner").alias("key"))
    grouped = reflections.groupBy("project", "file").agg(
        F.min_by("description", "ord").alias("first"), (F.count("*") - 1).alias("more")
    )
    more = F.when(F.col("more") > 0, F.concat(F.lit(" and "), F.col("more"), F.lit(" more"))).otherwise("")
    told = grouped.select(
        *_widening(
            F.col("project"),
            "Reflection",
            F.concat(
                name,
                F.lit(" uses "),
                F.col("first"),
                more,
                F.lit("; such members count as changed every time"),
            ),
            False,
        )
    )
    ownerless = reflections.where(F.col("owner").isNull()).select(
        *_widening(
            F.col("project"),
            "Reflection",
            F.concat(name, F.lit(" uses "), F.col("description"), F.lit(", but in no member")),
        )
    )
    empty = changes.notes.limit(0)
    return changes.union(ChangeSet(owners, union_all([told, ownerless]), empty, empty))


def reflection_files(reflections: DataFrame) -> DataFrame:
    """(project, file, first, more)."""
    return reflections.groupBy("project", "file").agg(
        F.min_by("description", "ord").alias("first"), (F.count("*") - 1).alias("more")
    )
