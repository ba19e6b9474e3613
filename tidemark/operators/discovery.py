"""What extractors hand over: tests by their marks, reflecting members, closed type facts, tracked edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.fixpoint import closure
from ..schemas import FIXTURE


def closed_bases(bases: DataFrame) -> DataFrame:
    """(type, base) closed over bases, each type its own base as well; `bases`: type, base."""
    return closure(bases, "type", "base", reflexive=True).select(
        F.col("origin").alias("type"), F.col("reached").alias("base")
    )


def discover_tests(methods: DataFrame, attributes: DataFrame, bases: DataFrame, markers: DataFrame) -> DataFrame:
    """Methods with an attribute that is a marker or derives from one; one for each class and method name.

    `methods`: class, method, symbol_key, depth (0: declared in the class, more: inherited from that far up);
    `attributes`: symbol_key, attribute; `bases`: type, base of attributes; `markers`: attribute, framework. Of inherited
    methods of one name the nearest counts. Markers are a fixed, short list.
    """
    derived = closed_bases(bases).join(markers, F.col("base") == F.col("attribute")).select("type", "framework")
    plain = markers.select(F.col("attribute").alias("type"), "framework")
    marks = derived.unionByName(plain).groupBy("type").agg(F.min("framework").alias("framework"))
    marked = (
        attributes.join(marks, F.col("attribute") == F.col("type"))
        .groupBy("symbol_key")
        .agg(F.min("framework").alias("framework"))
    )
    nearest = Window.partitionBy("class", "method").orderBy("depth", "symbol_key")
    found = methods.join(marked, "symbol_key").withColumn("n", F.row_number().over(nearest))
    return found.where("n = 1").select("class", "method", "symbol_key", "framework")


def fixture_edges(fixtures: DataFrame, tests: DataFrame) -> DataFrame:
    """Edges from each fixture member or fixture type of a class to all its tests; `fixtures`: class, key."""
    met = fixtures.join(tests.select("class", F.col("symbol_key").alias("dst")), "class")
    return met.where(F.col("key") != F.col("dst")).select(
        F.col("key").alias("src"), "dst", F.lit(FIXTURE).alias("kind")
    ).distinct()


def tracked_edges(edges: DataFrame, assemblies: DataFrame) -> DataFrame:
    """Edges whose ends both lie in tracked assemblies (the part of a key before `|`)."""
    known = assemblies.select("assembly")
    for end in ("src", "dst"):
        edges = edges.withColumn("assembly", F.substring_index(end, "|", 1)).join(known, "assembly", "left_semi")
        edges = edges.drop("assembly")
    return edges


def reflecting_members(accesses: DataFrame, strong: DataFrame, weak: DataFrame, receivers: DataFrame) -> DataFrame:
    """(project, file, description, owner): uses of reflection, once for each description and file.

    `accesses`: project, file, owner, member, receiver, declaring_type, ord. A strong member (type, member) always counts;
    a weak one (member) only on a receiver type that reflects (`receivers`: type). The three lists are fixed and short.
    """
    name = F.concat_ws(".", "declaring_type", "member").alias("description")
    columns = ["project", "file", name, "owner", "ord"]
    always = accesses.join(
        strong.select(F.col("type").alias("declaring_type"), "member"), ["declaring_type", "member"], "left_semi"
    ).select(*columns)
    some = (
        accesses.join(weak.select("member"), "member", "left_semi")
        .join(receivers.select(F.col("type").alias("receiver")), "receiver", "left_semi")
        .select(*columns)
    )
    both = always.unionByName(some)
    first = F.min(F.struct("ord", "owner"))
    return both.groupBy("project", "file", "description").agg(first.alias("f")).select(
        "project", "file", "description", F.col("f.owner").alias("owner"), F.col("f.ord").alias("ord")
    )


def closed_facts(obtained: DataFrame, bases: DataFrame, untracked: DataFrame) -> DataFrame:
    """(member, obtained, is_unknown): types a member obtains with all their bases; `obtained`: member, type.

    `untracked`: members that call out of the tracked code for an open type, which makes them unknown.
    """
    wide = obtained.join(closed_bases(bases), "type", "left").select("member", F.coalesce("base", "type").alias("type"))
    sets = wide.groupBy("member").agg(F.array_sort(F.collect_set("type")).alias("obtained"))
    marks = untracked.select("member").distinct().withColumn("u", F.lit(True))
    return sets.join(marks, "member", "full").select(
        "member",
        F.coalesce("obtained", F.array().cast("array<string>")).alias("obtained"),
        F.coalesce("u", F.lit(False)).alias("is_unknown"),
    )
