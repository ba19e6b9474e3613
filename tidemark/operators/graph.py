"""The dependency graph: merging, two-state reachability, bounded generalisation, closures.

Edges run from what is referenced to what depends on it. A node is reached *free*, or *restricted* if the only way in was
an upward edge (implementation to declaration); a restricted node does not follow downward edges. Types fan out to their
members. See `walk` for the rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.buckets import Rounds, bucket_count, bucketed
from ..plans.fixpoint import closure, union_all
from ..plans.workdir import dropped, written
from ..schemas import DISPATCH, DISPATCH_BY_REQUEST, DISPATCH_BY_ROUTE, DOWNWARD, GENERALISE_ROUNDS, UPWARD


def merge_edges(*fragments: DataFrame) -> DataFrame:
    """One row for each (src, dst), kinds OR-ed; self loops and empty keys are dropped."""
    rows = union_all([f.select("src", "dst", "kind") for f in fragments])
    real = (F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))
    return rows.where(real).groupBy("src", "dst").agg(F.bit_or("kind").alias("kind"))


def merge_nodes(*fragments: DataFrame) -> DataFrame:
    """First node by `ord` wins, its missing file filled from a later one."""
    rows = union_all(list(fragments)).where(F.col("key") != "")
    first = [F.min_by(c, "ord").alias(c) for c in ("display", "kind", "project", "containing_type")]
    file = F.min_by("file", F.when(F.col("file").isNotNull(), F.col("ord"))).alias("file")
    return rows.groupBy("key").agg(*first, file, F.min("ord").alias("ord"))


def memberships(*fragments: DataFrame) -> DataFrame:
    """M5: (type, member) of every node row, also of rows that lost the merge."""
    rows = union_all(list(fragments)).where(F.col("containing_type").isNotNull())
    return rows.select(F.col("containing_type").alias("type"), F.col("key").alias("member")).distinct()


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of types, members and distinct edges, in one row."""
    counted = nodes.agg(
        F.count_if(F.col("kind") == "Type").alias("types"),
        F.count_if(F.col("kind") != "Type").alias("members"),
        F.lit(0).cast("long").alias("edges"),
    )
    none = F.lit(0).cast("long")
    linked = merge_edges(edges).agg(none.alias("types"), none.alias("members"), F.count("*").alias("edges"))
    return counted.unionByName(linked).agg(*[F.sum(c).alias(c) for c in ("types", "members", "edges")])


def is_only(kind: Column, mask: int) -> Column:
    """Some bit of the mask and no other."""
    return (kind.bitwiseAND(F.lit(mask)) != 0) & (kind.bitwiseAND(F.lit(~mask)) == 0)


def classify_edges(edges: DataFrame) -> DataFrame:
    """Merged edges with what they consist of only."""
    return edges.withColumns(
        {
            "upward": is_only(F.col("kind"), UPWARD),
            "downward": is_only(F.col("kind"), DOWNWARD),
            "dispatch": is_only(F.col("kind"), DISPATCH),
        }
    )


def container_resolved(nodes: DataFrame, edges: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """Types of `nodes` that nothing outside names, dispatch aside; keys in column `type`.

    A mention is an edge from the type of a kind other than exactly request or exactly route dispatch, to something that
    is neither the type nor a member of it. `owned`: the nodes that say what a member of which type is, if not `nodes`.
    """
    types = nodes.where(F.col("kind") == "Type").select(F.col("key").alias("type"))
    owners = (nodes if owned is None else owned).select(F.col("key").alias("dst"), "containing_type")
    mentions = (
        edges.where(~F.col("kind").isin(DISPATCH_BY_REQUEST, DISPATCH_BY_ROUTE))
        .join(owners, "dst", "left")
        .where(~F.col("containing_type").eqNullSafe(F.col("src")) & (F.col("dst") != F.col("src")))
        .select(F.col("src").alias("type"))
    )
    return types.join(mentions, "type", "left_anti")


class Graph:
    """Nodes and merged edges prepared once for many walks."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes = nodes
        self.edges = edges
        is_type = F.col("kind") == "Type"
        classified = classify_edges(edges)
        columns = [F.col("src").alias("key"), F.col("dst").alias("to"), "kind", "upward", "downward"]
        plain = classified.where(~F.col("dispatch")).select(*columns)
        # Only sources of dispatch edges need to be known as resolved by the container or not.
        dispatched = classified.where("dispatch")
        owner = F.when(is_type, F.col("key")).otherwise(F.col("containing_type"))
        owners = nodes.select(F.col("key").alias("src"), owner.alias("type")).join(dispatched.select("src").distinct(), "src", "left_semi")
        asked = nodes.join(owners.select(F.col("type").alias("key")).distinct(), "key", "left_semi")
        mentioned = edges.join(asked.select(F.col("key").alias("src")), "src", "left_semi")
        resolved = owners.join(container_resolved(asked, mentioned, nodes), "type", "left_semi").select("src")
        followed = dispatched.join(resolved, "src", "left_semi").select(*columns)
        types = nodes.where(is_type).select(F.col("key").alias("_t"))
        inside = nodes.where(F.col("containing_type").isNotNull()).join(
            types, F.col("containing_type") == F.col("_t"), "left_semi"
        )
        fan_out = inside.select(
            F.col("containing_type").alias("key"),
            F.col("key").alias("to"),
            F.lit(32).alias("kind"),
            F.lit(False).alias("upward"),
            F.lit(False).alias("downward"),
        )
        steps = written(union_all([plain, followed, fan_out]), "adjacency", ("key", "to"))
        # Sources of more than their share of the steps, few by that: a bucket would hold all of one, and no task could share
        # them. Their steps stay in a table of their own, which a join may split.
        share = steps.count() // (_PER_BUCKET * bucket_count(nodes.sparkSession)) + 1
        heavy = written(steps.groupBy("key").count().where(F.col("count") > share).select("key"), "heavy")
        self.heavy = None if heavy.isEmpty() else written(steps.join(heavy, "key", "left_semi"), "heavy-steps", ("key", "to"))
        light = steps if self.heavy is None else steps.join(heavy, "key", "left_anti")
        self.light = bucketed(light, "light-steps", "key")
        #: One adjacency for edges and containment.
        self.steps = self.light if self.heavy is None else self.light.unionByName(self.heavy)
        dropped(steps)

    def onward(self, frontier: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """The frontier's rows with each of the steps from their key; only buckets of `keys` are read, if they are named."""
        parts = [self.light] if self.heavy is None else [self.light, self.heavy]
        if keys is not None:
            parts = [p.where(F.col("key").isin(keys)) for p in parts]
        return union_all([frontier.join(p, "key") for p in parts])


#: A source with more than one in this many of a bucket's even share of all steps is heavy.
_PER_BUCKET = 4
#: A frontier of so many rows at most names its keys, so that a round reads their buckets only; the result is the same.
_NAMED = 200


def walk(
    graph: Graph, seeds: DataFrame, allow_upward: bool, seeds_restricted: bool = False, predecessors: bool = False
) -> DataFrame:
    """(origin, key, hops[, pred, pred_kind]) reached from seeds (origin, key), breadth first.

    Rules: upward-only edges are followed if allowed and make their target restricted for that one arrival; every other
    arrival is free. From a restricted node downward-only edges are not followed. Dispatch-only edges count only from
    types that nothing else names. A type enqueues its members, free. A free arrival at a node known only as restricted
    walks it again. Hops count nodes, so a seed has 1. Of several predecessors in a round the least is told.
    """
    start = seeds.select("origin", "key").distinct()
    start = start.withColumns({"climbs": F.lit(allow_upward), "free": F.lit(not seeds_restricted)})
    return _walk(graph, start, predecessors).drop("climbs")


def _walk(graph: Graph, start: DataFrame, predecessors: bool) -> DataFrame:
    """`walk` from rows (origin, climbs, key, free): whether upward edges are allowed, and whether the seed is free.

    Many origins walk in one fixpoint. Steps lie in buckets by their source and what is known in buckets by (origin, climbs,
    key), so a round shuffles its frontier to the steps and its arrivals to what is known, and nothing else; known rows
    that are as free as an arrival drop it by an anti-join.
    """
    spark, ends = start.sparkSession, ["origin", "climbs", "key"]
    known = Rounds(spark, "walk", "origin string, climbs boolean, key string, free boolean, pred string, pred_kind int", ends)
    none = {"pred": F.lit(None).cast("string"), "pred_kind": F.lit(None).cast("int")}
    hops = 1
    frontier = known.append(start.withColumns(none).repartition(bucket_count(spark), *ends), hops)
    while some := frontier.select("key").limit(_NAMED + 1).collect():
        hops += 1
        named = sorted({r["key"] for r in some}) if len(some) <= _NAMED else None
        arrivals = (
            graph.onward(frontier.select(*ends, "free"), named)
            .where((F.col("free") | ~F.col("downward")) & (F.col("climbs") | ~F.col("upward")))
            .select("origin", "climbs", F.col("to").alias("key"), (~F.col("upward")).alias("free"), F.col("key").alias("pred"), "kind")
            .groupBy(*ends)
            .agg(F.bool_or("free").alias("free"), F.min(F.struct("pred", "kind")).alias("by"))
        )
        a, k = arrivals.alias("a"), known.all().select(*ends, "free").alias("k")
        same = (F.col("a.origin") == F.col("k.origin")) & (F.col("a.climbs") == F.col("k.climbs")) & (F.col("a.key") == F.col("k.key"))
        fresh = a.join(k, same & (F.col("k.free") | ~F.col("a.free")), "left_anti")
        found = fresh.select(*ends, "free", F.col("by.pred").alias("pred"), F.col("by.kind").alias("pred_kind"))
        frontier = known.append(found, hops)
    first = known.closed().groupBy(*ends)
    if not predecessors:
        return first.agg(F.min("hops").alias("hops"))
    return first.agg(F.min("hops").alias("hops"), F.min_by(F.struct("pred", "pred_kind"), "hops").alias("p")).select(
        "origin", "climbs", "key", "hops", "p.pred", "p.pred_kind"
    )


def _one_origin(seeds: DataFrame) -> DataFrame:
    return seeds.select(F.lit("").alias("origin"), "key")


def reach(graph: Graph, seeds: DataFrame, allow_upward: bool, seeds_restricted: bool = False) -> DataFrame:
    """(key, hops) from the seeds taken together."""
    return walk(graph, _one_origin(seeds), allow_upward, seeds_restricted).drop("origin")


def reaches_beyond(graph: Graph, walked: DataFrame) -> DataFrame:
    """E5: origins (types) whose walk reached a node that is neither the type nor a member of it."""
    owners = graph.nodes.select("key", "containing_type")
    outside = walked.join(owners, "key", "left").where(
        (F.col("key") != F.col("origin")) & ~F.col("containing_type").eqNullSafe(F.col("origin"))
    )
    return outside.select("origin").distinct()


def traverse(
    graph: Graph,
    seeds: DataFrame,
    narrow: Callable[[DataFrame], DataFrame] | None = None,
    predecessors: bool = False,
) -> DataFrame:
    """Keys impacted by the seeds, with upward edges generalised within bounds; (key, hops[, pred, pred_kind]).

    After the plain walk, up to eight rounds take each upward-only edge (impl, decl) from an impacted node once: what the
    declaration reaches (upward allowed, starting restricted) is added as far as impl's type permits. The type permits
    what its own walk reaches, narrowed by `narrow`, a function on (type, key) pairs, if there is one; a
    type that reaches nothing but itself, and a member without a type, bound nothing. The declaration is always added.

    All declarations and types of a round walk in one fixpoint. A walk depends on its origin only, so none is
    repeated in later rounds. The predecessor of an added declaration is the implementation it was reached from, that of
    any other added key the one in its declaration's walk; of equally near ones the least is told.
    """
    columns = ["key", "hops", "pred", "pred_kind"] if predecessors else ["key", "hops"]
    impacted = written(walk(graph, _one_origin(seeds), False, predecessors=predecessors).select(*columns), "impacted")
    upward = (
        classify_edges(graph.edges)
        .where("upward")
        .select(F.col("src").alias("impl"), F.col("dst").alias("decl"), F.col("kind").alias("up_kind"))
        .join(graph.nodes.select(F.col("key").alias("impl"), F.col("containing_type").alias("type")), "impl", "left")
    )
    upward = written(upward, "upward")
    used = upward.limit(0)
    walked = None
    for _ in range(GENERALISE_ROUNDS):
        at = impacted.select(F.col("key").alias("impl"), F.col("hops").alias("impl_hops"))
        new = written(upward.join(used, ["impl", "decl"], "left_anti").join(at, "impl"), "pairs")
        if new.isEmpty():
            break
        used = used.unionByName(new.select(*upward.columns))
        # Declarations climb from a restricted start, types walk freely without climbing.
        decls = new.select(F.col("decl").alias("origin"), F.lit(True).alias("climbs"), F.lit(False).alias("free"))
        types = new.select(F.col("type").alias("origin"), F.lit(False).alias("climbs"), F.lit(True).alias("free"))
        start = decls.unionByName(types.where("origin IS NOT NULL")).distinct()
        if walked is not None:
            start = start.join(walked.select("origin", "climbs").distinct(), ["origin", "climbs"], "left_anti")
        more = written(_walk(graph, start.withColumn("key", F.col("origin")), predecessors), "bounds")
        walked = more if walked is None else walked.unionByName(more)
        decl_reach, type_reach = walked.where("climbs").drop("climbs"), walked.where("NOT climbs").drop("climbs")
        beyond = written(reaches_beyond(graph, type_reach), "beyond")
        allowed = type_reach.join(beyond, "origin", "left_semi").select(F.col("origin").alias("type"), "key")
        if narrow is not None:
            allowed = narrow(allowed)
        bound = beyond.select(F.col("origin").alias("type"), F.lit(True).alias("bounded"))
        pairs = _least_pairs(new).join(bound, "type", "left").withColumn("bounded", F.coalesce("bounded", F.lit(False)))
        candidates = pairs.join(decl_reach.withColumnsRenamed({"origin": "decl", "hops": "more"}), "decl").withColumn(
            "hops", F.col("by.impl_hops") + F.col("more")
        )
        if predecessors:
            first = F.col("key") == F.col("decl")
            candidates = candidates.withColumns(
                {"pred": F.when(first, F.col("by.impl")).otherwise(F.col("pred")), "pred_kind": F.when(first, F.col("by.up_kind")).otherwise(F.col("pred_kind"))}
            )
        free = candidates.where(~F.col("bounded") | (F.col("key") == F.col("decl")))
        within = candidates.where("bounded").join(allowed, ["type", "key"], "left_semi")
        added = free.select(*columns).unionByName(within.select(*columns))
        least = F.min(F.struct(*columns[1:])).alias("least")
        added = added.groupBy("key").agg(least).select("key", *[F.col("least")[c].alias(c) for c in columns[1:]])
        fresh = written(added.join(impacted, "key", "left_anti"), "added")
        if fresh.isEmpty():
            # Nothing was added, so no further upward edge can start.
            break
        impacted = written(impacted.unionByName(fresh), "impacted")
    return impacted


def _least_pairs(pairs: DataFrame) -> DataFrame:
    """(decl, type, by): of the implementations of a declaration in one type, the nearest, of equally near ones the least.

    What a declaration reaches is the same for all of them, so only this one is joined with it: a declaration with n
    implementations that reaches m keys gives m candidates for each type, not n x m.
    """
    return pairs.groupBy("decl", "type").agg(F.min(F.struct("impl_hops", "impl", "up_kind")).alias("by"))


def paths_to(walked: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target key, the chain of (key, kind) from its seed on, following predecessors; cycles end it."""
    preds = written(walked.select(F.col("key").alias("head"), "pred", "pred_kind"), "preds")
    chain = F.array(F.struct(F.col("key").alias("key"), F.lit(None).cast("int").alias("kind")))
    open_paths = targets.join(walked.select("key"), "key", "left_semi").select(
        F.col("key").alias("target"), F.col("key").alias("head"), chain.alias("path")
    )
    done = []
    while not open_paths.isEmpty():
        step = open_paths.join(preds, "head", "left")
        ends = F.col("pred").isNull() | F.exists("path", lambda p: p["key"] == F.col("pred"))
        done.append(step.where(ends).select("target", "path"))
        more = F.transform("path", lambda p, i: F.when(i == 0, F.struct(p["key"].alias("key"), F.col("pred_kind").alias("kind"))).otherwise(p))
        head = F.array(F.struct(F.col("pred").alias("key"), F.lit(None).cast("int").alias("kind")))
        open_paths = written(
            step.where(~ends).select("target", F.col("pred").alias("head"), F.concat(head, more).alias("path")), "paths"
        )
    return union_all(done) if done else targets.select(F.col("key").alias("target"), chain.alias("path")).limit(0)


def project_closure(refs: DataFrame, widened: DataFrame) -> DataFrame:
    """The widened projects and all that reference them, directly or not; column `project`."""
    reverse = refs.select(F.col("references").alias("src"), F.col("project").alias("dst"))
    dependents = closure(reverse, "src", "dst").select(F.col("origin").alias("project"), "reached")
    found = widened.select("project").join(dependents, "project").select(F.col("reached").alias("project"))
    return widened.select("project").unionByName(found).distinct()


def dependency_closure(refs: DataFrame) -> DataFrame:
    """(project, closure): all projects it references, directly or not, itself left out, sorted."""
    return (
        closure(refs, "project", "references")
        .groupBy(F.col("origin").alias("project"))
        .agg(F.array_sort(F.collect_set("reached")).alias("closure"))
    )
