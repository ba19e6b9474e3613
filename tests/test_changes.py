"""Diff text, changed lines, widenings, routes and safety predicates on small cases."""

import random

from pyspark.sql import functions as F

from tidemark.functions import filters as fx
from tidemark.functions import names, routes as rt
from tidemark.operators import changes, routes, safety
from tidemark.plans.intervals import interval_join, longest_prefix
from tidemark.schemas import REFLECTIONS
from tidemark.sources import gitdiff


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_interval_join(spark):
    rng = random.Random(1)
    a = [(i % 3, s, s + rng.randrange(40)) for i in range(80) for s in [rng.randrange(200)]]
    b = [(i % 3, s, s + rng.randrange(40)) for i in range(80) for s in [rng.randrange(200)]]
    left, right = spark.createDataFrame(a, "k int, x int, y int"), spark.createDataFrame(b, "k int, u int, v int")
    want = sorted((k, x, y, u, v) for k, x, y in a for j, u, v in b if k == j and x <= v and u <= y)
    for bucket in (None, 1, 16, 1000):
        got = interval_join(left, right, ["k"], ("x", "y"), ("u", "v"), bucket).select("k", "x", "y", "u", "v")
        assert sorted(map(tuple, got.collect())) == want


def test_longest_prefix(spark):
    files = spark.createDataFrame([("a/b/c.txt",), ("a/bc/d",), ("z",), ("a/b",)], "path string")
    dirs = spark.createDataFrame([("a", "A", 1), ("a/b", "B2", 3), ("a/b", "B", 2), ("a/bc/d", "D", 4)], "dir string, name string, ord int")
    got = {r["path"]: r["name"] for r in longest_prefix(files, "path", dirs, "dir", "ord").collect()}
    assert got == {"a/b/c.txt": "B", "a/bc/d": "A", "z": None, "a/b": "A"}


def test_name_status(spark):
    text = "M\0a\\b.cs\0R100\0old.cs\0new.cs\0D\0gone.cs\0A\0x\0T\0t\0R050\0cut"
    df = spark.createDataFrame([(text,), ("",), (None,)], "text string")
    got = [tuple(r) for r in gitdiff.parse_name_status(df).collect()]
    assert got == [("a/b.cs", None, "Modified"), ("new.cs", "old.cs", "Renamed"), ("gone.cs", None, "Deleted"), ("x", None, "Added"), ("t", None, "TypeChanged")]


def test_hunks(spark):
    text = "diff --git a/o.cs b/n.cs\n--- a/o.cs\n+++ b/n.cs\n@@ -3 +4,2 @@ void f()\n-x\n+--- y\ndiff --git a/d b/d\n--- a/d\n+++ /dev/null\n@@ -1,3 +0,0 @@\n"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = {tuple(r)[1:] for r in gitdiff.parse_hunks_by_file(df, "id").collect()}
    assert got == {
        ("o.cs", "old", 3, 3), ("o.cs", "new", 4, 5), ("n.cs", "old", 3, 3), ("n.cs", "new", 4, 5), ("d", "old", 1, 3), ("d", "new", 1, 1),
    }
    one = {tuple(r)[1:] for r in gitdiff.parse_hunks(df, "id").collect()}
    assert one == {("old", 3, 3), ("new", 4, 5), ("old", 1, 3), ("new", 1, 1)}


def test_resolve_diff(spark):
    changed = spark.createDataFrame(
        [("a.cs", None, "Modified"), ("n.cs", "o.cs", "Renamed"), ("x/bin/y.cs", None, "Modified"), ("r.md", None, "Modified"), ("w.cs", None, "Modified")],
        "path string, old_path string, kind string",
    )
    hunks = spark.createDataFrame([("a.cs", "new", 2, 3), ("o.cs", "old", 5, 5)], "path string, side string, start_line int, end_line int")
    loose = spark.createDataFrame([("a.cs",), ("fresh.cs",), ("bin",)], "path string")
    got = {(r["path"], r["side"]): [tuple(x) for x in r["ranges"]] for r in changes.resolve_diff(changed, hunks, loose).collect()}
    whole = [(1, 2147483647)]
    assert got == {
        ("a.cs", "new"): [(2, 3)], ("a.cs", "old"): [], ("n.cs", "old"): [(5, 5)], ("n.cs", "new"): [], ("r.md", "old"): [], ("r.md", "new"): [],
        ("w.cs", "old"): whole, ("w.cs", "new"): whole, ("fresh.cs", "old"): [], ("fresh.cs", "new"): whole, ("bin", "old"): [], ("bin", "new"): [],
    }


SITES = [("p", "f", 2, 40, "T", True, False), ("p", "f", 5, 6, "T.a", False, False), ("p", "f", 7, 7, "T.K", False, True), ("p", "f", 50, 60, "V", True, False)]


def test_line_rules(spark):
    sites = spark.createDataFrame(SITES, "project string, file string, start_line int, end_line int, key string, is_type boolean, is_inlined boolean")
    hunks = spark.createDataFrame(
        [("p", "f", 5, 5), ("p", "f", 3, 3), ("p", "f", 7, 7), ("p", "f", 1, 1), ("p", "f", 45, 45), ("q", "g", 1, 1)],
        "project string, file string, start_line int, end_line int",
    )
    declared = changes.changed_declarations(hunks, sites)
    got = {(r["start_line"], r["tier"], r["key"]) for r in declared.collect()}
    assert got == {(5, 1, "T.a"), (3, 2, "T"), (7, 1, "T.K"), (1, 3, "T"), (1, 3, "V"), (45, 3, "T"), (45, 3, "V"), (1, 3, None)}
    nodes = spark.createDataFrame([("T.K", "T", "T.K")], "key string, containing_type string, display string")
    none = spark.createDataFrame([], "project string, file string")
    using = spark.createDataFrame([("p", "f", 45, 46)], "project string, file string, start_line int, end_line int")
    found = changes.new_side(declared, nodes, none, using)
    assert {r["key"] for r in found.seeds.collect()} == {"T.a", "T", "V"}
    assert {(r["cause"], r["widens"]) for r in found.widenings.collect()} == {("ConstantInlining", True), ("GlobalUsing", True)}
    assert [r["detail"] for r in found.unmapped.collect()] == ["g:1-1"]
    fresh = changes.new_side(declared, nodes, spark.createDataFrame([("p", "f")], "project string, file string"), using)
    assert {r["cause"] for r in fresh.widenings.collect()} == {"GlobalUsing"}


def test_old_side(spark):
    decls = spark.createDataFrame(
        [("p", "f", 1, 20, True, "N.T", None), ("p", "f", 3, 4, False, "N.T", "Run"), ("p", "f", 5, 5, False, "N.T", "Gone"), ("p", "f", 30, 40, True, "N.Old", None)],
        "project string, file string, start_line int, end_line int, is_type boolean, type_path string, member_name string",
    )
    hunks = spark.createDataFrame([("p", "f", 3, 3), ("p", "f", 5, 5), ("p", "f", 31, 31)], "project string, file string, start_line int, end_line int")
    types = spark.createDataFrame([("N.T", "A|T:N.T")], "type_path string, type string")
    members = spark.createDataFrame([("A|T:N.T", "Run", "m1"), ("A|T:N.T", "Run", "m2")], "type string, member_name string, member string")
    got = {(r["type_path"], r["key"]) for r in changes.old_side(hunks, decls, types, members).collect()}
    assert got == {("N.T", "m1"), ("N.T", "m2"), ("N.T", "A|T:N.T"), ("N.Old", None)}


def test_reflections(spark):
    rows = [("p", "d/f.cs", "GetType", "A", 1), ("p", "d/f.cs", "Invoke", None, 2), ("q", "g.cs", "Load", "B", 1)]
    refl = spark.createDataFrame(rows, REFLECTIONS)
    seeds = spark.createDataFrame([("S",)], "key string")
    empty = spark.createDataFrame([], "detail string")
    wide = spark.createDataFrame([], "project string, cause string, detail string, widens boolean")
    found = changes.seed_reflections(changes.ChangeSet(seeds, wide, empty, empty), refl)
    assert {r["key"] for r in found.seeds.collect()} == {"S", "A", "B"}
    got = {(r["project"], r["detail"], r["widens"]) for r in found.widenings.collect()}
    assert got == {
        ("p", "f.cs uses GetType and 1 more; such members count as changed every time", False),
        ("p", "f.cs uses Invoke, but in no member", True),
        ("q", "g.cs uses Load; such members count as changed every time", False),
    }
    none = changes.seed_reflections(changes.ChangeSet(seeds.limit(0), wide, empty, empty), refl)
    assert none.seeds.count() == 0


def test_route_functions(spark):
    rows = [(" /Api/{id}/X/ ",), ("{a}/{b}",), ("/",), (None,), ("a//b",)]
    assert values(spark, "t string", rows, rt.normalise_route(F.col("t"))) == [("api/*/x",), (None,), (None,), (None,), ("a/b",)]
    rows = [("/api/", "/x"), (None, "x"), ("/api", None), ("", "")]
    assert values(spark, "a string, b string", rows, rt.combine_routes(F.col("a"), F.col("b"))) == [("/api/x",), ("x",), ("/api",), ("",)]
    rows = [("Http.GetAttribute",), ("Attribute",), ("Route",)]
    assert values(spark, "a string", rows, rt.attribute_name(F.col("a"))) == [("Get",), ("Attribute",), ("Route",)]


def test_route_edges(spark):
    rows = [
        ("contributors", "List", True, "w", "R.cs", 1), ("contributors/{id}", "ById", True, "w", "R.cs", 2), ("/contributors/count", "T1", False, "t", "T.cs", 1),
        ("/contributors", "T2", False, "t", "T.cs", 2), ("/contributors", "List", False, "w", "R.cs", 1), ("/", "T3", False, "t", "T.cs", 3),
    ]
    df = spark.createDataFrame(rows, "template string, owner string, is_endpoint boolean, project string, file string, line int")
    got = {tuple(r) for r in routes.match_routes(df).collect()}
    assert got == {("ById", "T1", 1024), ("List", "T2", 1024)}
    hunks = spark.createDataFrame([("r.CS", "new", 2, 9), ("x/R.cs", "new", 1, 1)], "path string, side string, start_line int, end_line int")
    assert [tuple(r) for r in routes.changed_templates(df, hunks).collect()] == [("w", "contributors/{id}", "R.cs", 2)]
    group = spark.createDataFrame([("f", "api", "/api")], "file string, variable string, prefix string")
    maps = spark.createDataFrame([("f", "api", "x"), ("f", "app", "/y")], "file string, variable string, template string")
    assert {r["template"] for r in routes.resolve_prefixes(maps, group).collect()} == {"/api/x", "/y"}


def test_names(spark):
    keys = [("A|T:N.Outer`1.Inner`2",), ("A|M:N.T.Do``1(System.Int32)",), ("A|M:N.T.N#I#Run",), ("A|M:N.T.#ctor",), ("plain",), ("A|x:y",)]
    got = values(spark, "k string", keys, names.type_path(F.col("k")), names.simple_name(F.col("k")))
    assert got == [("N.Outer.Inner", "Inner"), (None, "Do"), (None, "Run"), (None, "#ctor"), (None, None), (None, None)]
    tests = [("A.b(x: f(1), y)",), (" c ",), ("a)b(",), ("(a)(b)c",)]
    assert values(spark, "t string", tests, names.normalize_test_name(F.col("t"))) == [("A.b",), ("c",), ("a)b",), ("c",)]
    assert values(spark, "t string", [("a(b)|c",), ("*",)], fx.escape_vstest(F.col("t")), fx.escape_tree_node(F.col("t"))) == [("a\\(b\\)\\|c", "a\\(b\\)\\|c"), ("*", "*")]
    assert values(spark, "k int", [(257,), (3,), (1,)], fx.edge_text(F.col("k"))) == [
        ("implementation -> interface member",), ("interface member -> implementation",), ("referenced by",)
    ]
    assert values(spark, "t string", [("x" * 60,), ("x",)], F.length(names.truncate(F.col("t")))) == [(48,), (1,)]


def test_safety(spark):
    rows = [("src/A.csproj",), ("Directory.Build.props",), ("NuGet.Config",), ("a.cs",), ("x/",), ("a.targets.cs",)]
    got = [bool(r[0]) for r in values(spark, "p string", rows, safety.trigger_reason(F.col("p")))]
    assert got == [True, True, True, False, False, False]
    files = spark.createDataFrame([("a.md", "b.sln"), ("a.cs", None)], "path string, old_path string")
    assert [r["reason"].split(":")[0] for r in safety.full_run_reasons(files).collect()] == ["b.sln"]
    diags = spark.createDataFrame([("bad", "X.csproj"), ("odd", None), ("fine", "a/b.csproj")], "message string, path string")
    loaded = spark.createDataFrame([("A/B.csproj", "net8"), ("c.csproj", "net8")], "file string, framework string")
    declared = spark.createDataFrame([("a/b.csproj", 1), ("c.csproj", 2)], "file string, n int")
    assert {r["file"] for r in safety.load_failures(diags, loaded, declared).collect()} == {"X.csproj", "", "c.csproj"}


def test_generated_and_trivia(spark):
    rows = [("p", "a", "1", "1", True), ("p", "b", "1", "2", True), ("q", "a", "1", None, True), ("r", "a", "1", "1", False), ("s", "a", "1", "1", True)]
    gen = spark.createDataFrame(rows, "project string, hint string, base_text string, head_text string, in_compilation boolean")
    got = {r["project"]: r["verdict"] for r in changes.generated_diff(gen).collect()}
    assert got == {"p": "changed", "q": "all", "r": "widen", "s": "note"}
    docs = spark.createDataFrame([("p", "a", "A"), ("p", "b", "B"), ("q", "a", "C"), ("s", "a", "D")], "project string, hint string, key string")
    assert {r["key"] for r in changes.generated_seeds(gen, docs).collect()} == {"B", "C"}


def test_routes_meet_like_all_pairs(spark):
    heads, tails = ["a", "b", "{x}"], ["1", "2", "{y}", "{z}/c", "1/c"]
    templates = [f"/{h}/{t}" for h in heads for t in tails]
    rows = [(t, f"e{i % 7}", True) for i, t in enumerate(templates)] + [(t, f"m{i % 9}", False) for i, t in enumerate(templates + templates[:4])]
    rows += [("/a/1", "e0", False), ("/{x}/{y}", "e1", True), ("/{x}", "e2", True), ("/", "m1", False)]
    df = spark.createDataFrame(rows, "template string, owner string, is_endpoint boolean")
    got = [tuple(r) for r in routes.match_routes(df).collect()]
    named = routes.normalised(df)
    e, r = named.where("is_endpoint").alias("e"), named.where("NOT is_endpoint").alias("r")
    met = e.crossJoin(r).where((F.col("e.owner") != F.col("r.owner")) & rt.segments_match(F.col("e.segments"), F.col("r.segments")))
    assert sorted(got) == sorted((x["src"], x["dst"], 1024) for x in met.select(F.col("e.owner").alias("src"), F.col("r.owner").alias("dst")).distinct().collect())


def test_a_route_that_all_serve_is_shared_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(routes, "_SIDE", 10)
    rows = [("/x/{id}", f"e{i}", True) for i in range(60)] + [(f"/x/{i}", f"m{i}", False) for i in range(90)]
    met = routes.match_routes(spark.createDataFrame(rows, "template string, owner string, is_endpoint boolean"))
    by_task = met.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in by_task) == met.distinct().count() == 5400
    assert len(by_task) >= 4 and max(r["count"] for r in by_task) < 2700
