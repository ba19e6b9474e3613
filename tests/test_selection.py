"""Order, waves, dialects, plans, ledgers, harness, sources and the watch stream."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.functions import filters as fx
from tidemark.operators import filters, harness, ledger, report, selection
from tidemark.schemas import RUNS
from tidemark.sources import results
from tidemark.streaming import watch


def make_tests(spark, rows):
    """Rows (namespace, class, method, selected) of project p."""
    df = spark.createDataFrame(rows, "namespace string, class_name string, method_name string, selected boolean")
    full = df.withColumn("project", F.lit("p")).withColumn("symbol_key", F.concat_ws(".", "class_name", "method_name"))
    return selection.named_tests(full.withColumn("class_key", F.col("class_name")))


def test_run_order(spark):
    rows = [("N", "Near", "a", True), ("N", "Far", "b", True), ("N", "Far", "a", True), ("N", "Wide", "z", True), ("N", "No", "x", True)]
    tests = make_tests(spark, rows).withColumn("project", F.when(F.col("class_name") == "Wide", "w").otherwise("p"))
    reached = spark.createDataFrame([("Near.a", 2), ("Near", 9), ("Far", 4)], "key string, hops int")
    wide = spark.createDataFrame([("w",)], "project string")
    got = {r["fqn"]: (r["rank"], r["hops"]) for r in selection.run_order(selection.select_tests(tests, reached, wide)).collect()}
    assert got == {"N.Near.a": (1, 2), "N.Far.a": (2, 4), "N.Far.b": (3, 4), "N.Wide.z": (1, selection.UNREACHED)}


def ranked(spark, sizes):
    rows = [("N", f"C{i}", f"t{j}", True) for i, n in enumerate(sizes) for j in range(n)]
    return selection.run_order(make_tests(spark, rows).withColumn("hops", F.substr("class_name", F.lit(2)).cast("int")))


def test_first_wave(spark):
    waved = selection.first_wave(ranked(spark, [1, 2, 3, 6]))
    got = {r["class_name"] for r in waved.where("in_wave").collect()}
    assert got == {"C0", "C1"}  # a quarter of twelve is three


@pytest.mark.parametrize("sizes,reason", [([3, 2], "few"), ([9], "one_class"), ([9, 1], "most"), ([1, 2, 3, 6], None)])
def test_wave_plan(spark, sizes, reason):
    plan = filters.wave_plans(selection.first_wave(ranked(spark, sizes)), filters.VsTest()).first()
    assert (plan["reason"], plan["split"]) == (reason, reason is None)


def test_dialects(spark):
    rows = [("N", "A", "x", True), ("N", "A", "y", True), ("N", "B", "m", True), ("N", "B", "mm", False), ("", "G", "g(1)", True), ("N", "B", "x", False)]
    t = make_tests(spark, rows)
    line = lambda d: d.arguments(t).first()["arguments"]
    assert line(filters.VsTest()) == ["--filter", "FullyQualifiedName~N.A.|FullyQualifiedName~G.g\\(1\\)|FullyQualifiedName~N.B.m"]
    assert line(filters.ClassOrMethod())[:2] == ["--filter-method", "G.g(1)"]
    assert line(filters.TreeNode()) == ["--treenode-filter", "/*/*|N/A|B|G/g\\(1\\)|m|x|y"]
    assert {r["fqn"] for r in filters.VsTest().extra(t).collect()} == {"N.B.mm"}
    assert {r["fqn"] for r in filters.TreeNode().extra(t).collect()} == {"N.B.x"}
    whole = t.where("class_name = 'A'")
    assert filters.ClassOrMethod().arguments(whole).first()["arguments"] == ["--filter-class", "N.A"]
    assert filters.TreeNode().arguments(whole).first()["arguments"] == ["--treenode-filter", "/*/N/A/*"]
    assert filters.dialect_for("TUnit", "VSTest").name == "treenode" and filters.dialect_for("NUnit", "VSTest").name == "vstest"


def test_filter_plan(spark):
    some = [("N", f"C{i}", "t", i < 5) for i in range(10)]
    assert filters.filter_plans(make_tests(spark, some), filters.VsTest()).first()["filtered"]
    assert filters.filter_plans(make_tests(spark, some), filters.VsTest(), coverage=0.5).first()["reason"].startswith("most")
    assert filters.filter_plans(make_tests(spark, some), filters.VsTest(), length_limit=20).first()["reason"].endswith("too long")
    none = filters.filter_plans(make_tests(spark, [("N", "C", "t", False)]), filters.VsTest())
    assert none.first()["reason"] == "nothing selected"
    totals = report.project_totals(make_tests(spark, some), filters.filter_plans(make_tests(spark, some), filters.VsTest(), coverage=0.5))
    assert tuple(totals.first()) == ("p", 10, 5, 10) and tuple(report.totals(totals).first()) == (10, 5, 10)


def runs(spark, rows):
    return spark.createDataFrame([(str(i), "c", *r) for i, r in enumerate(rows)], RUNS)


def test_ledger(spark):
    v = ledger.verdict(runs(spark, [(True, 6.9, 2.0, 10, 10), (False, 6.8, 1.9, 5, 10), (False, 6.9, 1.2, 5, 10)])).first()
    assert v["suite_seconds"] == 2.0 and v["suite_observed"] and v["net_seconds"] < 0
    v = ledger.verdict(runs(spark, [(True, 7.0, 300.0, 2000, 2000)] + [(False, 7.0, 30.0, 200, 2000)] * 2)).first()
    assert v["net_seconds"] == pytest.approx(300 - (7 + 30)) and v["runs"] == 2
    assert ledger.verdict(runs(spark, [(True, 1.0, 2.0, 1, 1)] * 5)).first()["net_seconds"] is None
    assert ledger.verdict(runs(spark, [(False, 1.0, 2.0, 1, 1)] * 2)).first()["net_seconds"] is None
    row = spark.range(1).select(
        ledger.split_pays(F.lit(100.0), F.lit(10), F.lit(100), F.lit(100)),
        ledger.split_pays(F.lit(None).cast("double"), F.lit(1), F.lit(2), F.lit(2)),
        ledger.split_pays(F.lit(100.0), F.lit(0), F.lit(0), F.lit(0)),
        ledger.break_even(F.lit(3.0), F.lit(0.25)),
        ledger.break_even(F.lit(3.0), F.lit(1.0)),
    ).first()
    assert tuple(row) == (True, False, False, 4.0, None)


def test_ledger_file(spark, tmp_path):
    lines = [json.dumps({"at": f"t{i:03}", "headCommit": "c", "fullRun": False, "analysisSeconds": 1.0, "suiteSeconds": 2.0, "selectedTests": 1, "totalTests": 2}) for i in range(130)]
    (tmp_path / "l.jsonl").write_text("\n".join([*lines[:50], "", "{broken", *lines[50:]]) + "\n")
    read = results.read_ledger(spark, str(tmp_path / "l.jsonl"))
    assert read.count() == 130
    results.write_ledger(read, str(tmp_path / "out"))
    kept = results.read_ledger(spark, str(tmp_path / "out")).orderBy("seq").collect()
    assert [r["at"] for r in kept] == [f"t{i:03}" for i in range(30, 130)]
    more = ledger.append_run(read, runs(spark, [(False, 1.0, 1.0, 1, 1)]))
    assert more.count() == 100


def test_harness(spark):
    failures = spark.createDataFrame([("p", "A.b(1)"), ("p", "A.c"), ("q", "Z.z"), ("u", "U.u")], "project string, test string")
    selected = spark.createDataFrame([("p", "A.b")], "project string, fqn string")
    unfiltered = spark.createDataFrame([("u",)], "project string")
    assert {tuple(r) for r in harness.missed_failures(failures, selected, unfiltered).collect()} == {("p", "A.c"), ("q", "Z.z")}
    sel = spark.createDataFrame([("p", 0, True), ("q", 0, False)], "project string, selected int, filtered boolean")
    assert {r[0] for r in harness.silent_projects(failures, sel).collect()} == {"p", "u"}
    counts = spark.createDataFrame([(1, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 0), (0, 2, 0, 0)], "misses int, failures int, unobserved int, timed_out int")
    assert [(r["verdict"], r["exit_code"]) for r in harness.shadow_verdict(counts).collect()] == [("Miss", 1), ("Inconclusive", 2), ("NoFailures", 0), ("Clean", 0)]
    samples = spark.createDataFrame(
        [("Clean", [], 2, 10, None), ("Skipped", None, None, 0, "build"), ("Clean", [], None, 5, None)],
        "outcome string, misses array<string>, first_failure int, ordered int, skip_reason string",
    )
    assert tuple(harness.mutation_summary(samples).first()) == (2, 1, 0, 0, True)
    assert not harness.mutation_summary(samples, True).first()["passed"]
    assert tuple(harness.time_to_failure(samples).first()) == (1, 0.2, 0.55)
    assert [tuple(r) for r in harness.skip_reasons(samples).collect()] == [("build", 1)]
    replay = spark.createDataFrame([(1, "0123456789", "a|b", 1, 4, False, 0, 1.25), (2, "x", "s", 0, 0, True, 2, 3.0)], "ord int, commit string, subject string, selected int, total int, full_run boolean, widenings int, seconds double")
    assert tuple(harness.replay_summary(replay).first()) == (2, 0.625, 0.5, 0.5, 2.125)
    assert harness.replay_table(replay).first()["line"] == "| 012345678 | a\\|b | 1/4 | 25.0 % | selective | 1.2 s |"
    named = spark.createDataFrame([("a", True), ("b", False)], "name string, is_test boolean")
    assert [tuple(r) for r in harness.default_selections(named, sel).collect()] == [("a", 0, True)]


def test_trx(spark):
    text = """<TestRun xmlns="http://x"><TestDefinitions><UnitTest id="1"><TestMethod className="N.C" name="m"/></UnitTest>
    <UnitTest id="2"><TestMethod className="N.C" name="N.C.q"/></UnitTest></TestDefinitions><Results>
    <UnitTestResult testId="1" testName="m(1)" outcome="Failed"/><UnitTestResult testId="2" testName="q" outcome="Passed"/>
    <UnitTestResult testId="9" testName="loose" outcome="Passed"/></Results></TestRun>"""
    df = spark.createDataFrame([("p", text), ("q", "<broken")], "project string, text string")
    got = {tuple(r) for r in results.parse_trx(df).collect()}
    assert got == {("p", "N.C.m", "Failed"), ("p", "N.C.q", "Passed"), ("p", "loose", "Passed")}


def test_fragments(spark, tmp_path):
    schema = "key string, project string"
    store = results.FragmentStore(spark, str(tmp_path / "cache"), "9.0", "a.sln")
    assert store.read("nodes", schema).count() == 0 and not store.valid()
    nodes = spark.createDataFrame([("k1", "p"), ("k2", "q")], schema)
    assert store.write({"nodes": nodes}, rebuilt=2, projects=2, known_projects=0)
    assert not store.write({"nodes": nodes}, rebuilt=0, projects=2, known_projects=2)
    assert store.write({"nodes": spark.createDataFrame([("k3", "q")], schema)}, rebuilt=1, projects=2, known_projects=2)
    assert {tuple(r) for r in store.read("nodes", schema).collect()} == {("k1", "p"), ("k3", "q")}
    assert not results.FragmentStore(spark, str(tmp_path / "cache"), "10.0", "a.sln").valid()
    now = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3")], "project string, fingerprint string")
    old = spark.createDataFrame([("p", "1"), ("q", "9")], "project string, fingerprint string")
    assert {r["project"]: r["reused"] for r in results.fragment_reuse(now, old).collect()} == {"p": True, "q": False, "r": False}


def test_hashes_ignore_order(spark):
    docs = [("p", "h1"), ("p", "h2")]
    refs = spark.createDataFrame([("p", "b"), ("p", "a")], "project string, references string")
    h = lambda d: results.content_hash(spark.createDataFrame(d, "project string, hash string"), refs).first()["content_hash"]
    assert h(docs) == h(docs[::-1]) != h(docs[:1]) and len(h(docs)) == 32


def test_reports(spark):
    tests = make_tests(spark, [("N", "Abc", "run", True), ("N", "Abc", "runs", False)])
    assert [r["method_name"] for r in report.explain_matches(tests, "abc.RUN").collect()] == ["run"]
    assert report.explain_matches(tests, "bc.ru").count() == 2
    line = report.report_json(spark.createDataFrame([(1, None)], "full_run int, x_y int")).first()["json"]
    assert line == '{"fullRun":1}'
    none = F.lit(None).cast("array<string>")
    args = F.array(F.lit("--f"), F.lit("x"))
    row = spark.range(1).select(
        report.test_command(F.lit("p.csproj"), F.lit(True), F.lit(True), args, none),
        report.test_command(F.lit("p.csproj"), F.lit(True), F.lit(False), args, none),
        report.test_command(F.lit("p.csproj"), F.lit(True), F.lit(True), none, none),
    ).first()
    assert [len(x) for x in row] == [6, 5, 3] and row[0][3] == "--"


def test_batches(spark):
    rows = [("a", "2024-01-01 00:00:00.000", False), ("b", "2024-01-01 00:00:00.299", None), ("a", "2024-01-01 00:00:00.500", False), ("c", "2024-01-01 00:00:01.000", True)]
    events = spark.createDataFrame(rows, "path string, ts string, lost boolean").withColumn("ts", F.to_timestamp("ts"))
    got = [(r["paths"], r["lost"], r["events"]) for r in watch.batches(events).orderBy("opened").collect()]
    assert got == [(["a", "b"], False, 3), (["c"], True, 1)]


def test_watch_stream(spark, tmp_path):
    source = tmp_path / "events"
    seen = []
    schema = "path string, ts timestamp, lost boolean"

    def put(name, rows):
        df = spark.createDataFrame(rows, "path string, ts string, lost boolean").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.parquet(str(tmp_path / "new" / name))
        source.mkdir(exist_ok=True)
        for f in (tmp_path / "new" / name).glob("*.parquet"):
            shutil.copy(f, source / f"{name}.parquet")

    put("one", [("a", "2024-01-01 00:00:00", False), ("b", "2024-01-01 00:00:00.1", False)])
    put("two", [("z", "2024-01-01 00:01:00", False)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    run = watch.watch(stream, lambda df, n: seen.extend(r["paths"] for r in df.collect()), str(tmp_path / "cp"), availableNow=True)
    run.awaitTermination(120)
    assert seen == [["a", "b"]]


def test_state(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert {tuple(r) for r in watch.moved_documents(old, new).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    batch = spark.createDataFrame([(1, "a.cs", False, True), (2, "n.cs", False, True), (3, "n.cs", False, False), (4, "x.props", False, True)], "id int, path string, lost boolean, exists boolean")
    known = spark.createDataFrame([("a.cs",)], "path string")
    assert {r["id"]: r["reopen"] for r in watch.reopen_decisions(batch, known).collect()} == {1: False, 2: True, 3: False, 4: True}


def test_terms_with_a_common_ending(spark):
    """Every term and every name ends alike; names are read once, whatever the number of terms."""
    tests = spark.range(30_000).selectExpr(
        "'p' AS project", "'K' || id AS full_class", "'K' || id || '.Method_ReturnsTrue' AS fqn", "'N' AS namespace", "'K' || id AS class_name",
        "'Method_ReturnsTrue' AS method_name", "id % 2 = 0 AS selected",
    )
    more = spark.createDataFrame(
        [("p", "X", "AK4.Method_ReturnsTrue", "N", "X", "m", False), ("q", "X", "AK4.Method_ReturnsTrue", "N", "X", "m", False), ("p", "X", None, "N", "X", "m", False)],
        "project string, full_class string, fqn string, namespace string, class_name string, method_name string, selected boolean",
    )
    for pass_bytes in (8 << 20, 200_000):
        extra = filters.VsTest(pass_bytes=pass_bytes).extra(tests.unionByName(more))
        assert [tuple(r) for r in extra.collect()] == [("p", "AK4.Method_ReturnsTrue")]


def test_lengths_are_those_of_the_arguments(spark):
    rows = [("N", "A(b)", "m|x", True), ("", "B", "y", True), ("N", "B", "y", False), ("N", "C", "m|x", True), ("N.M", "A(b)", "z", False)]
    for some in (rows, [r for r in rows if r[3]], rows[:1]):
        tests = make_tests(spark, some)
        for dialect in (filters.VsTest(), filters.ClassOrMethod(), filters.TreeNode()):
            built = dialect.arguments(tests).select("project", fx.arguments_length(F.col("arguments")).cast("long").alias("length"))
            assert sorted(map(tuple, built.collect())) == sorted((r["project"], r["length"]) for r in dialect.lengths(tests).collect())


def test_passes_hold_whole_projects_or_parts_of_one(spark):
    sizes = {f"p{i}": 10 for i in range(7)} | {"large": 95, "full": 30}
    passes = filters._passes(sizes, 30)
    assert sorted(p for projects, _, parts in passes if parts == 1 for p in projects) == sorted(set(sizes) - {"large"})
    assert [x for x in passes if x[2] > 1] == [(["large"], i, 4) for i in range(4)]
    assert all(sum(sizes[p] for p in projects) <= 30 for projects, _, parts in passes if parts == 1)
    assert filters._passes({}, 30) == []


def test_terms_in_parts_find_names_of_their_own_project(spark):
    names = [(p, f"N.{p}.C{i}.M") for p in ("a", "b", "c") for i in range(40)] + [("a", None), (None, "N.a.C1.M")]
    asked = [(p, f"C{i}.") for p in ("a", "b") for i in range(0, 40, 3)] + [("b", "C1"), ("a", ""), ("c", None), (None, "M"), ("d", "N")]
    frames = spark.createDataFrame(names, "project string, fqn string"), spark.createDataFrame(asked, "project string, term string")
    want = {(p, f) for p, f in names if p and f and any(q == p and t and t in f for q, t in asked)}
    for pass_bytes in (8 << 20, 90, 12):
        found = [tuple(r) for r in filters.holding(*frames, pass_bytes=pass_bytes).collect()]
        assert len(found) == len(want) and set(found) == want


def test_trx_files_grow_in_number_not_in_length(spark, sf_dir, monkeypatch):
    from tidemark import queries

    seen = []
    monkeypatch.setattr(queries, "_TRX_ORDERS", 100)
    monkeypatch.setattr(queries.results, "parse_trx", lambda texts: seen.append(texts) or texts)
    queries.QUERIES["trx_results"](spark, sf_dir)
    held = [r["n"] for r in seen[0].select((F.size(F.split("text", "<UnitTestResult ")) - 1).alias("n")).collect()]
    assert sum(held) == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert max(held) <= 100 and len(held) > 20
