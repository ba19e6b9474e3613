"""Reachability, generalisation, closures and type flow against plain queue walks on random graphs."""

import random
from collections import deque

import pytest

from tidemark.operators import graph, typeflow
from tidemark.plans import workdir
from tidemark.plans.fixpoint import closure
from tidemark.schemas import NODES

UP, DOWN, DISPATCH = 768, 6, 1152


def only(kind, mask):
    return kind & mask != 0 and kind & ~mask == 0


class Plain:
    def __init__(self, nodes, edges):
        self.kind = {k: t for k, t, _ in nodes}
        self.owner = {k: o for k, _, o in nodes}
        self.members = {}
        for k, _, o in nodes:
            self.members.setdefault(o, []).append(k)
        self.out = {}
        for s, d, k in edges:
            if s != d and s and d:
                self.out.setdefault(s, {})
                self.out[s][d] = self.out[s].get(d, 0) | k

    def resolved(self, type_key):
        for d, k in self.out.get(type_key, {}).items():
            if k not in (128, 1024) and d != type_key and self.owner.get(d) != type_key:
                return False
        return True

    def walk(self, seeds, upward, restricted=False):
        state = {s: not restricted for s in seeds}
        hops = {s: 1 for s in seeds}
        queue = deque(seeds)
        while queue:
            at = queue.popleft()
            arrivals = []
            for d, k in self.out.get(at, {}).items():
                if only(k, UP) and not upward or only(k, DOWN) and not state[at]:
                    continue
                if only(k, DISPATCH):
                    t = at if self.kind.get(at) == "Type" else self.owner.get(at)
                    if at not in self.kind or t is None or self.kind.get(t) != "Type" or not self.resolved(t):
                        continue
                arrivals.append((d, not only(k, UP)))
            if self.kind.get(at) == "Type":
                arrivals += [(m, True) for m in self.members.get(at, [])]
            for d, free in arrivals:
                if d not in state or free and not state[d]:
                    state[d] = free
                    hops.setdefault(d, hops[at] + 1)
                    queue.append(d)
        return hops

    def traverse(self, seeds):
        impacted = set(self.walk(seeds, False))
        used = set()
        for _ in range(8):
            added = False
            for i in list(impacted):
                for d, k in self.out.get(i, {}).items():
                    if not only(k, UP) or (i, d) in used:
                        continue
                    used.add((i, d))
                    found = set(self.walk([d], True, True))
                    t = self.owner.get(i)
                    if t is not None:
                        bound = set(self.walk([t], False))
                        if any(x != t and self.owner.get(x) != t for x in bound):
                            found = found & bound | {d}
                    added |= bool(found - impacted)
                    impacted |= found
            if not added:
                break
        return impacted


def random_graph(seed, n=40, m=110):
    rng = random.Random(seed)
    nodes = []
    for i in range(n):
        if i < n // 4:
            nodes.append((f"n{i}", "Type", None if i == 0 or rng.random() < 0.7 else f"n{rng.randrange(i)}"))
        else:
            nodes.append((f"n{i}", "Method", f"n{rng.randrange(n // 4)}" if rng.random() < 0.8 else None))
    kinds = [1, 1, 1, 2, 4, 8, 256, 256, 512, 128, 1024, 1152, 3]
    edges = [(f"n{rng.randrange(n + 3)}", f"n{rng.randrange(n + 3)}", rng.choice(kinds)) for _ in range(m)]
    return nodes, edges


def frames(spark, nodes, edges):
    n = spark.createDataFrame([(k, t, "p", o) for k, t, o in nodes], "key string, kind string, project string, containing_type string")
    return graph.Graph(n, graph.merge_edges(spark.createDataFrame(edges, "src string, dst string, kind int")))


@pytest.mark.parametrize("seed", [1, 2])
def test_walks(spark, seed):
    nodes, edges = random_graph(seed)
    plain, g = Plain(nodes, edges), frames(spark, nodes, edges)
    for upward, restricted in ((False, False), (True, False), (True, True)):
        seeds = [f"n{i}" for i in range(0, 40, 7)]
        many = spark.createDataFrame([(s, s) for s in seeds], "origin string, key string")
        got = {(r["origin"], r["key"]) for r in graph.walk(g, many, upward, restricted).collect()}
        assert got == {(s, k) for s in seeds for k in plain.walk([s], upward, restricted)}
    one = spark.createDataFrame([("n1",), ("ghost",)], "key string")
    assert {r["key"]: r["hops"] for r in graph.reach(g, one, False).collect()} == plain.walk(["n1", "ghost"], False)


@pytest.mark.parametrize("seed", [3, 4])
def test_traverse(spark, seed):
    nodes, edges = random_graph(seed, 30, 70)
    plain, g = Plain(nodes, edges), frames(spark, nodes, edges)
    seeds = spark.createDataFrame([("n9",), ("n12",)], "key string")
    assert {r["key"] for r in graph.traverse(g, seeds).collect()} == plain.traverse(["n9", "n12"])


def test_restriction_lasts_one_hop(spark):
    nodes = [("I", "Type", None), ("I.m", "Method", "I"), ("A", "Type", None), ("A.m", "Method", "A"), ("B", "Type", None), ("B.m", "Method", "B")]
    edges = [("A.m", "I.m", 256), ("I.m", "A.m", 2), ("B.m", "I.m", 256), ("I.m", "B.m", 2), ("I.m", "T", 1), ("T", "U", 1)]
    g = frames(spark, nodes, edges)
    seeds = spark.createDataFrame([("A.m",)], "key string")
    assert {r["key"] for r in graph.reach(g, seeds, True).collect()} == {"A.m", "I.m", "T", "U"}
    assert {r["key"] for r in graph.traverse(g, seeds).collect()} == {"A.m", "I.m", "T", "U"}


def test_mixed_kinds_are_no_upward_edges(spark):
    rows = [("a", "b", 256), ("a", "b", 1), ("a", "c", 256), ("x", "x", 1), ("", "y", 1)]
    got = graph.classify_edges(graph.merge_edges(spark.createDataFrame(rows, "src string, dst string, kind int"))).collect()
    assert {(r["src"], r["dst"]): r["upward"] for r in got} == {("a", "b"): False, ("a", "c"): True}


def test_first_node_wins_and_borrows_a_file(spark):
    rows = [("k", "one", "Type", "p", None, None, 1), ("k", "two", "Other", "q", "T", "f.cs", 2)]
    df = spark.createDataFrame(rows, NODES)
    r = graph.merge_nodes(df).first()
    assert (r["display"], r["kind"], r["file"], r["containing_type"]) == ("one", "Type", "f.cs", None)
    assert [tuple(x) for x in graph.memberships(df).collect()] == [("T", "k")]


def test_closures(spark):
    refs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "project string, references string")
    got = {r["project"]: r["closure"] for r in graph.dependency_closure(refs).collect()}
    assert got == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"], "d": ["a", "b", "c"]}
    wide = spark.createDataFrame([("b",)], "project string")
    assert {r["project"] for r in graph.project_closure(refs, wide).collect()} == {"a", "b", "c", "d"}
    assert closure(refs, "project", "references", reflexive=True).where("origin = reached").count() == 4


def test_paths(spark):
    nodes, edges = random_graph(7)
    plain, g = Plain(nodes, edges), frames(spark, nodes, edges)
    seeds = spark.createDataFrame([("", "n1")], "origin string, key string")
    walked = graph.walk(g, seeds, False, predecessors=True)
    hops = plain.walk(["n1"], False)
    targets = walked.select("key")
    for r in graph.paths_to(walked, targets).collect():
        keys = [p["key"] for p in r["path"]]
        assert keys[0] == "n1" and keys[-1] == r["target"] and len(keys) == hops[r["target"]]
        assert r["path"][0]["kind"] is None and all(p["kind"] for p in r["path"][1:])


def plain_flow(nodes, edges, facts, unknown, limit):
    succ = {}
    merged = {}
    for s, d, k in edges:
        if s != d:
            merged[s, d] = merged.get((s, d), 0) | k
    for (s, d), k in merged.items():
        if k & ~1158:
            succ.setdefault(s, set()).add(d)
    for k, kind, o in nodes:
        if o is not None:
            succ.setdefault(o, set()).add(k)
            if kind in ("Field", "Property") or kind == "Method" and "#ctor" in k:
                succ.setdefault(k, set()).add(o)
    unknown, facts = set(unknown), {k: set(v) for k, v in facts.items()}
    while True:
        before = len(unknown), sum(map(len, facts.values()))
        for n in list(unknown):
            unknown |= succ.get(n, set())
        for n, v in list(facts.items()):
            if n not in unknown:
                for d in succ.get(n, ()):
                    facts.setdefault(d, set()).update(v)
        unknown |= {n for n, v in facts.items() if len(v) > limit}
        if before == (len(unknown), sum(map(len, facts.values()))):
            return {(n, t) for n, v in facts.items() if n not in unknown for t in v}, unknown


@pytest.mark.parametrize("limit", [2, 96])
def test_type_flow(spark, limit):
    nodes, edges = random_graph(11, 40, 40)
    rng = random.Random(1)
    facts = {f"n{rng.randrange(40)}": {f"t{rng.randrange(6)}"} for _ in range(8)}
    g = frames(spark, nodes, edges)
    rows = [(k, sorted(v), False) for k, v in facts.items()] + [("n33", [], True)]
    known, unknown = typeflow.obtainable(g.nodes, g.edges, spark.createDataFrame(rows, "member string, obtained array<string>, is_unknown boolean"), limit)
    want = plain_flow(nodes, edges, facts, {"n33"}, limit)
    assert ({tuple(r) for r in known.collect()}, {r[0] for r in unknown.collect()}) == want


def test_narrowing_never_empties(spark):
    pairs = spark.createDataFrame([("T", "a"), ("T", "b"), ("V", "a"), ("W", "a")], "type string, key string")
    types = spark.createDataFrame([("T",), ("V",)], "type string")
    facts = spark.createDataFrame([("m", ["T", "V"], False)], "member string, obtained array<string>, is_unknown boolean")
    known = spark.createDataFrame([("b", "T")], "node string, type string")
    unknown = spark.createDataFrame([], "node string")
    got = {tuple(r) for r in typeflow.narrow(pairs, types, facts, known, unknown).collect()}
    assert got == {("T", "b"), ("V", "a"), ("W", "a")}


def test_walk_shuffles_neither_steps_nor_known_rows(spark, capsys):
    """Seeds over many rounds with one source that holds half of all edges, more named keys than a round lists."""
    from tidemark.operators import graph as g

    hub = [("hub", f"leaf{i}") for i in range(300)]
    chain = [(f"c{i}", f"c{i + 1}") for i in range(12)] + [("c3", "hub"), ("c5", "c2")]
    twigs = [(f"leaf{i}", f"twig{i % 7}") for i in range(0, 300, 2)]
    links = hub + chain + twigs
    nodes = spark.createDataFrame([(k, "Method", None) for k in sorted({x for e in links for x in e})], "key string, kind string, containing_type string")
    edges = spark.createDataFrame([(a, b, 1) for a, b in links], "src string, dst string, kind int")
    graph = g.Graph(nodes, edges)
    assert {r["key"] for r in graph.heavy.select("key").distinct().collect()} == {"hub"}
    assert graph.light.count() + graph.heavy.count() == len(links)

    want, ring, hops = {"c0": 1}, ["c0"], 1
    while ring:
        hops += 1
        ring = sorted({b for a, b in links if a in ring and b not in want})
        want |= dict.fromkeys(ring, hops)
    seeds = spark.createDataFrame([("", "c0")], "origin string, key string")
    got = g.walk(graph, seeds, False)
    assert {r["key"]: r["hops"] for r in got.collect()} == want
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tidemark_")]

    known = g.Rounds(spark, "t", "key string", ["key"])
    known.append(seeds.select("key"), 1)
    again = seeds.select("key").groupBy("key").count().join(known.all(), "key", "left_anti")
    plan = again._jdf.queryExecution().sparkPlan().toString() + again._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    known.closed()

    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark.conf.set(auto, "false")
    try:
        graph.light.where("key = 'c3'").explain("formatted")
    finally:
        spark.conf.unset(auto)
    assert "SelectedBucketsCount: 1 out of" in capsys.readouterr().out


def test_implementations_of_a_declaration_meet_its_reach_once(spark):
    rows = [("D", "T", 3, f"i{n:03}", 256) for n in range(200)] + [("D", "T", 2, "z", 256), ("D", None, 4, "y", 512), ("E", "T", 2, "a", 256)]
    pairs = spark.createDataFrame(rows, "decl string, type string, impl_hops int, impl string, up_kind int")
    found = graph._least_pairs(pairs).select("decl", "type", "by.*").collect()
    assert {tuple(r) for r in found} == {("D", "T", 2, "z", 256), ("D", None, 4, "y", 512), ("E", "T", 2, "a", 256)}


def test_a_graph_keeps_its_steps_once(spark):
    nodes = spark.createDataFrame([("A", "Type", "p", None), ("a", "Method", "p", "A")], "key string, kind string, project string, containing_type string")
    edges = spark.createDataFrame([("a", f"k{n}", 1) for n in range(50)] + [("k1", "k2", 256)], "src string, dst string, kind int")
    made = len(workdir._made)
    g = graph.Graph(nodes, edges)
    assert not [at for at in workdir._made[made:] if "tidemark-adjacency-" in at]
    kept = {(r["key"], r["to"], r["upward"]) for r in g.steps.collect()}
    assert kept == {("A", "a", False), ("k1", "k2", True)} | {("a", f"k{n}", False) for n in range(50)}


def test_paths_name_the_nearest_implementation(spark):
    nodes = [("T", "Type", "p", None), ("D", "Method", "p", None), ("far", "Method", "p", None), *((f"i{n}", "Method", "p", "T") for n in range(20))]
    rows = [(f"i{n}", "D", 256) for n in range(20)] + [("D", "far", 1), ("s", "i7", 1), ("s", "i5", 1), ("s", "q", 1), ("q", "i3", 1)]
    g = graph.Graph(
        spark.createDataFrame(nodes, "key string, kind string, project string, containing_type string"),
        spark.createDataFrame(rows, "src string, dst string, kind int"),
    )
    walked = graph.traverse(g, spark.createDataFrame([("s",)], "key string"), predecessors=True)
    found = {r["target"]: [p["key"] for p in r["path"]] for r in graph.paths_to(walked, walked.select("key")).collect()}
    assert found["far"] == ["s", "i5", "D", "far"] and found["D"] == ["s", "i5", "D"]
