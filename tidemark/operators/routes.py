"""Requests by route: references to endpoints, and templates that changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize_path
from ..functions.routes import combine_routes, normalise_route, route_segments
from ..plans.buckets import bucket_count
from ..plans.workdir import written
from ..schemas import DISPATCH_BY_ROUTE


def resolve_prefixes(maps: DataFrame, groups: DataFrame) -> DataFrame:
    """Templates of `maps` (file, variable, template) behind the group prefix of their variable (file, variable, prefix)."""
    return maps.join(groups, ["file", "variable"], "left").withColumn(
        "template", combine_routes(F.col("prefix"), F.col("template"))
    )


def normalised(routes: DataFrame) -> DataFrame:
    """Routes with their segments; those without a literal segment go."""
    return routes.withColumn("segments", route_segments(F.col("template"))).where(F.col("segments").isNotNull())


#: Owners of a template, and references that it matches, dealt so many to a side meet in one cell of pairs.
_SIDE = 1000


def match_routes(routes: DataFrame) -> DataFrame:
    """Edges (src, dst, kind) from an endpoint's owner to members that name a route it serves.

    Different templates and different references meet first, by equality: a reference is looked up under each mask of
    wildcards that templates of its segment count and first segment have. Then each template's owners meet the members that
    name a route it matches, in cells of at most a bounded number of pairs, so a template that all serve and name is
    shared by all tasks. Only an owner of several templates can meet a member twice; other pairs aren't compared again.
    """
    rows = written(normalised(routes).select("owner", "segments", "is_endpoint").distinct(), "routes")
    ends = rows.where("is_endpoint").select(
        F.col("owner").alias("src"),
        F.array_join("segments", "/").alias("template"),
        F.transform("segments", lambda s: s == "*").alias("mask"),
        F.element_at("segments", 1).alias("head"),
    )
    refs = rows.where(~F.col("is_endpoint")).select(F.col("owner").alias("dst"), F.col("segments").alias("named"))
    none = rows.select(F.col("owner").alias("src"), F.col("owner").alias("dst"), F.lit(DISPATCH_BY_ROUTE).alias("kind")).limit(0)
    masks = ends.select("mask", "head").distinct().select(F.size("mask").alias("n"), "head", "mask")
    first = F.element_at("named", 1)
    asked = refs.select("named").distinct().select(
        "named", F.size("named").alias("n"), F.explode(F.array_distinct(F.array(first, F.lit("*")))).alias("head")
    )
    masked = F.array_join(F.zip_with("named", "mask", lambda s, wild: F.when(wild, "*").otherwise(s)), "/")
    hits = asked.join(masks, ["n", "head"]).select("named", masked.alias("template")).distinct()
    hits = hits.join(ends.select("template").distinct(), "template", "left_semi")
    met = written(refs.join(hits, "named").select("template", "dst").distinct(), "met")
    sizes = ends.groupBy("template").agg(F.count("*").alias("owners")).join(met.groupBy("template").agg(F.count("*").alias("members")), "template")
    sizes = written(sizes, "sizes")
    pairs = sizes.agg(F.sum(F.col("owners") * F.col("members"))).first()[0]
    if not pairs:
        return none
    # A number that is asked for, as pairs are far more than the rows they come from, by which partitions would be joined up.
    parts = max(bucket_count(rows.sparkSession), -(-pairs // (4 * _SIDE * _SIDE)))
    across, down = (F.ceil(F.col(c) / _SIDE).cast("int") for c in ("owners", "members"))

    def dealt(df: DataFrame, key: str, own: Column, other: Column, names: tuple[str, str]) -> DataFrame:
        """Rows dealt to their own side's places by a hash, and copied to all of the other's."""
        placed = df.join(sizes, "template").select(
            "template", key, F.pmod(F.xxhash64(key), own).cast("int").alias(names[0]), F.explode(F.sequence(F.lit(0), other - 1)).alias(names[1])
        )
        return placed.repartition(parts, "template", "_across", "_down")

    several = ends.groupBy("src").count().where("count > 1").select("src")
    members = dealt(met, "dst", down, across, ("_down", "_across"))

    def joined(owners: DataFrame) -> DataFrame:
        both = dealt(owners.select("template", "src"), "src", across, down, ("_across", "_down")).join(members, ["template", "_across", "_down"])
        return both.where("src <> dst").select("src", "dst", F.lit(DISPATCH_BY_ROUTE).alias("kind"))

    if several.isEmpty():
        return joined(ends)
    return joined(ends.join(several, "src", "left_anti")).unionByName(joined(ends.join(several, "src", "left_semi")).distinct())


def changed_templates(routes: DataFrame, hunks: DataFrame) -> DataFrame:
    """Projects with an endpoint whose line changed; (project, template, file, line), one for each project.

    A route's file ends with the diff's path, letter case aside and at any place in a segment. Paths meet on the file name
    when the diff's path has a folder; a bare name is compared by its last letters alone, as `Foo.cs` also ends `BarFoo.cs`.
    """
    ends = routes.where("is_endpoint").withColumn("low", F.lower(normalize_path(F.col("file"))))
    tail = F.lower(normalize_path(F.col("path"))).alias("tail")
    changed = hunks.where("side = 'new'").select(tail, "start_line", "end_line").distinct()
    deep = changed.where(F.contains("tail", F.lit("/"))).withColumn("name", F.substring_index("tail", "/", -1))
    bare = changed.where(~F.contains("tail", F.lit("/"))).withColumn("name", F.col("tail"))
    inside = F.endswith("low", "tail") & F.col("line").between(F.col("start_line"), F.col("end_line"))
    named = ends.withColumn("name", F.substring_index("low", "/", -1))
    by_name = named.join(deep, "name").where(inside)
    # A bare name may end another name: every ending of the route's file name is a key.
    endings = named.withColumn(
        "name", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substr("name", i)))
    )
    by_ending = endings.join(bare, "name").where(inside)
    cols = ["project", "template", "file", "line"]
    found = by_name.select(*cols).unionByName(by_ending.select(*cols))
    first = F.min(F.struct("file", "line", "template")).alias("f")
    return found.groupBy("project").agg(first).select("project", "f.template", "f.file", "f.line")


def normal_forms(routes: DataFrame) -> DataFrame:
    """I6 over a table: template and its normal form."""
    return routes.select("template", normalise_route(F.col("template")).alias("normal")).distinct()
