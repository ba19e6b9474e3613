"""The whole analysis on a small solution, and what extractors hand over."""

import dataclasses
import time

import pytest

from tidemark.operators import changes, discovery, filters, report
from tidemark.plans import analyze as an
from tidemark.schemas import CHANGED_FILES, GENERATED, HUNKS, NODES, OLD_DECLS, PROJECT_REFS, REFLECTIONS, ROUTES, SITES, TESTS


def key(name):
    return f"a|M:{name}" if "." in name else f"a|T:{name}"


@pytest.fixture
def world(spark):
    """A core project with a calculator and greeters, and a test project that references it."""
    types = ["Calc", "IGreet", "En", "De", "Service", "CalcTests", "GreetTests", "Reflector", "ReflectTests"]
    members = {
        "Calc.Add": "Calc", "Calc.Sub": "Calc", "IGreet.Greet": "IGreet", "En.Greet": "En", "De.Greet": "De", "Service.Welcome": "Service",
        "CalcTests.Adds": "CalcTests", "CalcTests.Subs": "CalcTests", "GreetTests.Welcomes": "GreetTests", "GreetTests.German": "GreetTests",
        "Reflector.Run": "Reflector", "ReflectTests.R": "ReflectTests", "Calc.Max": "Calc",
    }
    home = lambda k: "Tests" if "Tests" in k else "Core"
    rows = [(key(t), t, "Type", home(t), None, f"{home(t)}/{t}.cs", i) for i, t in enumerate(types)]
    rows += [(key(m), m, "Method", home(m), key(t), f"{home(m)}/{t}.cs", 100 + i) for i, (m, t) in enumerate(members.items())]
    edges = [
        ("Calc.Add", "CalcTests.Adds", 1), ("Calc.Sub", "CalcTests.Subs", 1), ("En.Greet", "IGreet.Greet", 256), ("IGreet.Greet", "En.Greet", 2),
        ("De.Greet", "IGreet.Greet", 256), ("IGreet.Greet", "De.Greet", 2), ("IGreet.Greet", "Service.Welcome", 1), ("Service.Welcome", "GreetTests.Welcomes", 1),
        ("De.Greet", "GreetTests.German", 1), ("En", "GreetTests.Welcomes", 1), ("De", "GreetTests.German", 1), ("Reflector.Run", "ReflectTests.R", 1),
    ]
    edges = [(key(a), key(b), k) for a, b, k in edges]
    sites = [("Core", f"Core/{t}.cs", s, e, key(k), "." not in k, k == "Calc.Max") for k, t, s, e in (
        ("Calc", "Calc", 3, 30), ("Calc.Add", "Calc", 5, 6), ("Calc.Sub", "Calc", 8, 9), ("Calc.Max", "Calc", 11, 11), ("De", "De", 3, 20), ("De.Greet", "De", 5, 6))]
    tests = [(key(m), key(t), "N", t, m.split(".")[1], "Tests", "NUnit", False) for m, t in members.items() if "Tests" in m]
    frame = spark.createDataFrame
    none = lambda schema: frame([], schema)
    projects = frame([("Core", "Core"), ("Tests", "Tests")], "name string, dir string")

    def make(new=(), old=(), files=(), **more):
        """`new`, `old`: (path, first, last) on either side of modified files; `files`: (path, old path, kind)."""
        named = {f[0] for f in files}
        touched = sorted({h[0] for h in (*new, *old)} - named - {f[1] for f in files})
        changed = frame([*files, *((p, None, "Modified") for p in touched)], CHANGED_FILES)
        hunks = frame([(p, side, a, b) for side, some in (("new", new), ("old", old)) for p, a, b in some], HUNKS)
        schemas = {
            "old_decls": OLD_DECLS, "generated": GENERATED, "generated_docs": "project string, hint string, key string",
            "trivia_files": "project string, file string", "foreign": "name string, language string, dir string", "project_files": "path string",
            "fragments": "project string", "file_errors": "project string, file string, error string", "failures": "reason string",
        }
        base = an.Inputs(
            nodes=frame(rows, NODES), edges=frame(edges, "src string, dst string, kind int"), sites=frame(sites, SITES), projects=projects,
            documents=frame(sorted({(r[3], r[5]) for r in rows}), "project string, file string"),
            project_refs=frame([("Tests", "Core"), ("Tests", "FLib")], PROJECT_REFS), tests=frame(tests, TESTS), diff=changes.resolve_diff(changed, hunks, none("path string")),
            routes=none(ROUTES), reflections=frame([("Core", "Core/Reflector.cs", "Type.GetType", key("Reflector.Run"), 1)], REFLECTIONS),
        )
        return dataclasses.replace(base, **{k: frame(list(v), schemas[k]) if isinstance(v, list) else v for k, v in more.items()})

    return make


STRICT = an.Options(fallback=False)


def selected(outcome):
    return {r["method_name"] for r in outcome.tests.where("selected").collect()}


def causes(outcome):
    return {r["cause"] for r in outcome.widenings.collect()}


def resolved(inputs):
    """(seeds, {cause: widened projects}, notes, errors)"""
    found, errors = an.resolve_changes(inputs)
    found = found.kept()
    wide = {}
    for r in found.widenings.collect():
        wide.setdefault(r["cause"], set()).update({r["project"]} if r["widens"] else ())
    return (
        {r["key"] for r in found.seeds.collect()},
        wide,
        [r["detail"] for r in found.notes.collect()],
        sorted(r["reason"] for r in errors.collect()),
    )


def test_member(world):
    out = an.analyze(world([("Core/Calc.cs", 5, 5)]), STRICT)
    assert selected(out) == {"Adds", "R"} and out.changed_symbols == 1 and out.reasons == []
    assert causes(out) == {"Reflection"}
    plan = out.plans.first()
    assert plan["filtered"] and plan["arguments"][1] == "FullyQualifiedName~N.CalcTests.Adds|FullyQualifiedName~N.ReflectTests.R"
    assert plan["extra_matches"] == 0 and out.extras.count() == 0
    told = report.explain(out.tests, out.walked, out.plans, "Adds").collect()
    assert [(r["verdict"], r["line"]) for r in told] == [("Reached", "a|M:Calc.Add --referenced by--> a|M:CalcTests.Adds")]
    told = report.explain(out.tests, out.walked, out.plans, "GreetTests").collect()
    assert {(r["fqn"], r["exact"], r["verdict"]) for r in told} == {
        ("N.GreetTests.German", False, "NotReached"), ("N.GreetTests.Welcomes", False, "NotReached"),
    }


def test_nothing(world):
    out = an.analyze(world(), STRICT)
    assert selected(out) == set() and out.plans.first()["reason"] == "nothing selected"


def test_comment(world):
    quiet = [("Core", "Core/Calc.cs")]
    decls = [(None, "Core/Calc.cs", 5, 6, False, "Calc", "Add")]
    seeds, wide, notes, _ = resolved(world([("Core/Calc.cs", 5, 5)], [("Core/Calc.cs", 5, 5)], trivia_files=quiet, old_decls=decls))
    assert (seeds, wide, notes) == (set(), {}, ["Core/Calc.cs: only comments or formatting"])
    # A generator could read the comment; an added file is no change of layout.
    assert resolved(world([("Core/Calc.cs", 5, 5)], trivia_files=quiet, generated=[("Core", "g", "x", "x", True)]))[0] == {key("Calc.Add")}
    added = world([("Core/Calc.cs", 5, 5)], files=[("Core/Calc.cs", None, "Added")], trivia_files=quiet)
    assert resolved(added)[0] == {key("Calc.Add")}


def test_widened_projects_run_whole(world):
    out = an.analyze(world([("Core/Calc.cs", 11, 11)]), STRICT)
    assert len(selected(out)) == 5
    assert causes(out) >= {"ConstantInlining", "Dependent", "Unfiltered"}


def test_siblings_stay_out_and_deleted_overrides_come_in(world):
    """A member that is gone seeds its type: what depends on the type or its members is selected."""
    decls = [("x", "Core/De.cs", 3, 20, True, "De", None), ("x", "Core/De.cs", 8, 9, False, "De", "ToString"), ("x", "Core/De.cs", 5, 6, False, "De", "Greet")]
    out = an.analyze(world(new=[("Core/De.cs", 21, 22)], old=[("Core/De.cs", 8, 9)], old_decls=decls), STRICT)
    assert {r["key"] for r in out.changes.seeds.collect()} == {key("De"), key("Reflector.Run")}
    assert selected(out) == {"German", "R"}
    # A member of which lines were removed and that is still there stands for itself.
    assert resolved(world(old=[("Core/De.cs", 5, 5)], old_decls=decls))[0] == {key("De.Greet")}


def test_deleted_file(world):
    decls = [("x", "Core/Fr.cs", 1, 9, True, "Fr", None), ("x", "Core/Fr.cs", 2, 3, False, "Fr", "Greet")]
    for old in ([("Core/Fr.cs", 1, 9)], []):
        assert resolved(world(old=old, files=[("Core/Fr.cs", None, "Deleted")], old_decls=decls))[:2] == (set(), {"DeletedType": {"Core"}})


def test_moved_file(world):
    """The old side of a renamed file is looked up under its old name, in the project of that name."""
    decls = [("x", "Core/Old.cs", 5, 6, False, "Calc", "Add")]
    moved = world(old=[("Core/Old.cs", 5, 5)], files=[("Core/Calc.cs", "Core/Old.cs", "Renamed")], old_decls=decls)
    assert resolved(moved)[:2] == ({key("Calc.Add")}, {})


def test_other_files(world):
    assert resolved(world(files=[("Tests/data.json", None, "Added")]))[1] == {"ContentFile": {"Tests"}}
    changed = [("F/Lib.fs", None, "Modified")]
    assert resolved(world(files=changed, foreign=[("FLib", "F#", "F")]))[1] == {"ForeignLanguage": {"FLib"}}
    unloaded = world(files=changed, project_files=[("F/Lib.fsproj",), ("Core/Core.csproj",)])
    out = an.analyze(unloaded, STRICT)
    assert out.reasons == ["F/Lib.fs belongs to Lib.fsproj, which isn't loaded"] and len(selected(out)) == 5
    document = [("docs/a.md", None, "Modified")]
    assert resolved(world(files=document, project_files=[("F/Lib.fsproj",)])) == (set(), {}, [], [])
    assert len(resolved(world(files=document, project_files=[("All.csproj",)]))[3]) == 1


def test_errors(world):
    touched = [("Core/Calc.cs", 5, 5)]
    broken = world(touched, file_errors=[("Core", "Core/Calc.cs", "CS1002"), ("Core", "Core/De.cs", "CS0000")])
    assert resolved(broken)[3] == ["Core/Calc.cs doesn't compile: CS1002"]
    assert resolved(world(touched, fragments=[("Tests",)]))[3] == ["Core/Calc.cs: what Core declares isn't known"]
    assert resolved(world(touched, fragments=[("Core",)]))[3] == []


def test_generated_code(world):
    docs = [("Core", "g1", key("En")), ("Core", "g2", key("Calc"))]
    same, other = ("Core", "g2", "y", "y", True), ("Core", "g1", "x", "z", True)
    change = [("Core/Other.cs", 1, 1)]
    assert resolved(world(change, generated=[same, other], generated_docs=docs))[:2] == ({key("En")}, {"SourceGenerator": set()})
    assert resolved(world(change, generated=[same], generated_docs=docs))[:2] == (set(), {"SourceGenerator": set()})
    # Another file than source may be what a generator reads: all that it emits counts.
    mixed = world(change, files=[("Core/x.bin", None, "Modified")], generated=[same], generated_docs=docs)
    assert resolved(mixed)[:2] == ({key("Calc"), key("En")}, {"SourceGenerator": set(), "ContentFile": {"Core"}})
    outside = world(change, generated=[("Core", "g", "x", "x", False)], generated_docs=docs)
    assert resolved(outside)[1] == {"SourceGenerator": {"Core"}}
    assert resolved(world([("Tests/X.cs", 1, 1)], generated=[other], generated_docs=docs))[1] == {}


def test_many_whole_files(spark):
    hunks = spark.range(1000).selectExpr("'p' AS project", "'f' || id AS file", "1 AS start_line", "2147483647 AS end_line")
    sites = spark.range(3000).selectExpr(
        "'p' AS project", "'f' || (id % 1000) AS file", "CAST(id * 3 AS INT) AS start_line", "CAST(id * 3 + 2 AS INT) AS end_line", "'k' || id AS key",
        "FALSE AS is_type", "FALSE AS is_inlined",
    )
    began = time.time()
    assert changes.changed_declarations(hunks, sites, bucket=256).count() == 3000
    assert time.time() - began < 60


def test_dialects_by_project(spark):
    rows = [("A", "treenode"), ("B", "xunit-platform"), ("C", None), ("D", "vstest")]
    tests = spark.createDataFrame(
        [(p, d, "N", "K", f"t{i}", f"N.K.t{i}", "N.K", i == 1, f"{p}{i}") for p, d in rows for i in range(4)],
        "project string, dialect string, namespace string, class_name string, method_name string, fqn string, full_class string, selected boolean, symbol_key string",
    )
    plans = {r["project"]: r["arguments"][0] for r in filters.filter_plans(tests, filters.ByProject()).collect()}
    assert plans == {"A": "--treenode-filter", "B": "--filter-method", "C": "--filter", "D": "--filter"}
    names = spark.createDataFrame([("TUnit", "VSTest"), ("XUnitV3", "MicrosoftTestingPlatform"), ("XUnitV3", "VSTest"), ("NUnit", "VSTest")], "f string, r string")
    got = names.select("f", "r", filters.dialect_name(names.f, names.r).alias("d")).collect()
    assert all(r["d"] == filters.dialect_for(r["f"], r["r"]).name for r in got)


def test_predecessors_through_an_interface(world):
    """A type that nothing names bounds nothing, so its interface's callers are reached: up to the declaration, then on."""
    inputs = world([("Core/De.cs", 5, 5)])
    unnamed = inputs.edges.where((inputs.edges.src != key("De")) & (inputs.edges.dst != key("GreetTests.German")))
    out = an.analyze(dataclasses.replace(inputs, edges=unnamed), STRICT)
    assert selected(out) == {"Welcomes", "R"}
    line = report.explain(out.tests, out.walked, out.plans, "Welcomes").first()["line"]
    steps = [x for x in line.split() if "|" in x]
    assert steps == [key("De.Greet"), key("IGreet.Greet"), key("Service.Welcome"), key("GreetTests.Welcomes")]


def test_full_run(world):
    out = an.analyze(world(files=[("Core/Core.csproj", None, "Modified")]))
    assert len(out.reasons) == 1 and len(selected(out)) == 5
    assert an.full_run_reasons(world(), an.Options(full=True)) == ["a full run was asked for"]
    assert an.full_run_reasons(world(failures=[("X.csproj failed",)]), STRICT) == ["X.csproj failed"]
    inputs = world(files=[(f"P{i:02d}/P.csproj", None, "Modified") for i in range(25)])
    reasons = an.full_run_reasons(inputs, an.Options())
    assert [r.split(":")[0] for r in reasons] == [f"P{i:02d}/P.csproj" for i in range(25)]


def test_reasons_that_no_change_shows(world, spark):
    """A project that doesn't compile, the default branch, a diff that failed, and what a loader says."""
    touched = [("Core/Calc.cs", 5, 5)]
    broken = world(touched, file_errors=[("Tests", "Tests/A.cs", "CS1002"), ("Tests", "Tests/B.cs", "CS0103")])
    out = an.analyze(broken, STRICT)
    assert out.reasons == ["Tests doesn't compile: Tests/A.cs: CS1002 and 1 more"] and len(selected(out)) == 5
    main = an.Options(fallback=False, default_branch="main")
    assert an.full_run_reasons(world(touched, branch="main"), main) == ["the head is on main, where nothing is left out"]
    assert an.full_run_reasons(world(touched, branch="topic"), main) == []
    assert an.analyze(world(touched, diff_problem="the base isn't known"), STRICT).reasons == ["the base isn't known"]
    said = spark.createDataFrame(
        [
            ("Core", "NETSDK1045", "The current .NET SDK does not support targeting .NET 99.0.", ["net99.0"], "8.0.100"),
            ("Core", "MSB4019", "import not found", None, "8.0.100"), (None, None, "no code", None, None),
        ],
        "project string, code string, message string, declared_frameworks array<string>, registered string",
    )
    assert an.full_run_reasons(world(touched, diagnostics=said), STRICT) == ["import not found", "no code", "the SDK 8.0.100 is too old for net99.0"]


def test_many_reasons_are_counted(world):
    inputs = world(files=[(f"P{i:03}/P.csproj", None, "Modified") for i in range(150)])
    out = an.analyze(inputs)
    assert len(out.reasons) == 101 and out.reasons[-1] == "and 50 more" and out.reason_rows.count() == 150


def test_inputs_that_cannot_be_used(world):
    lacking = dataclasses.replace(world(), edges=world().edges.drop("kind"))
    assert an.analyze(lacking).reasons == ["the analysis can't be done: edges has no kind"]
    with pytest.raises(an.UnusableInput):
        an.analyze(lacking, STRICT)


def test_failures_of_the_engine_are_raised(world, monkeypatch):
    def fail(*_):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(an, "resolve_changes", fail)
    with pytest.raises(RuntimeError):
        an.analyze(world([("Core/Calc.cs", 5, 5)]))


def test_discovery(spark):
    frame = spark.createDataFrame
    methods = frame([("C", "a", "B.a", 1), ("C", "a", "C.a", 0), ("C", "h", "C.h", 0)], "class string, method string, symbol_key string, depth int")
    attributes = frame([("B.a", "Fact"), ("C.a", "MyFact"), ("C.h", "Obsolete")], "symbol_key string, attribute string")
    bases = frame([("MyFact", "OurFact"), ("OurFact", "Fact")], "type string, base string")
    markers = frame([("Fact", "XUnitV3")], "attribute string, framework string")
    tests = discovery.discover_tests(methods, attributes, bases, markers)
    assert [tuple(r) for r in tests.collect()] == [("C", "a", "C.a", "XUnitV3")]
    fixtures = frame([("C", "C.SetUp"), ("D", "x")], "class string, key string")
    assert [tuple(r) for r in discovery.fixture_edges(fixtures, tests).collect()] == [("C.SetUp", "C.a", 16)]
    edges = frame([("A|x", "A|y", 1), ("A|x", "Z|y", 1)], "src string, dst string, kind int")
    assert discovery.tracked_edges(edges, frame([("A",)], "assembly string")).count() == 1


def test_reflection_rules(spark):
    frame = spark.createDataFrame
    rows = [("p", "f", "o1", "GetType", "object", "Type", 2), ("p", "f", "o2", "GetType", "object", "Type", 1), ("p", "f", "o", "Invoke", "MethodInfo", "MethodBase", 3), ("p", "f", "o", "Invoke", "Action", "Action", 4)]
    accesses = frame(rows, "project string, file string, owner string, member string, receiver string, declaring_type string, ord int")
    found = discovery.reflecting_members(accesses, frame([("Type", "GetType")], "type string, member string"), frame([("Invoke",)], "member string"), frame([("MethodInfo",)], "type string"))
    assert {(r["description"], r["owner"]) for r in found.collect()} == {("Type.GetType", "o2"), ("MethodBase.Invoke", "o")}
    facts = discovery.closed_facts(frame([("m", "De"), ("m", "X")], "member string, type string"), frame([("De", "IGreet")], "type string, base string"), frame([("u",)], "member string"))
    assert {(r["member"], tuple(r["obtained"]), r["is_unknown"]) for r in facts.collect()} == {("m", ("De", "IGreet", "X"), False), ("u", (), True)}
