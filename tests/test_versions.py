"""Ledgers and fragment tables in published versions: appends, crashes, writers that race."""

import os

import pytest

from tidemark.plans import workdir
from tidemark.sources import results
from tidemark.sources.versions import Versions

RUN = "at string, headCommit string, fullRun boolean, analysisSeconds double, seq long"


def runs(spark, names):
    return spark.createDataFrame([(n, "c", False, 1.0, i) for i, n in enumerate(names)], RUN)


def ledger(spark, path):
    return [r["at"] for r in results.read_ledger(spark, path).orderBy("seq").collect()]


def test_append_to_what_is_there(spark, tmp_path):
    path = str(tmp_path / "a b" / "ledger")
    results.append_ledger(runs(spark, ["a", "b"]), path)
    results.append_ledger(runs(spark, ["c"]), path)
    assert ledger(spark, path) == ["a", "b", "c"]
    # Also by reading, adding and writing over what is read.
    results.write_ledger(results.read_ledger(spark, path).unionByName(runs(spark, ["d"]).selectExpr("at", "headCommit", "fullRun", "analysisSeconds", "seq + 9000000000 AS seq"), allowMissingColumns=True), path)
    assert ledger(spark, path) == ["a", "b", "c", "d"]
    results.append_ledger(runs(spark, [f"e{i:03}" for i in range(120)]), path)
    assert ledger(spark, path) == [f"e{i:03}" for i in range(20, 120)]


def test_a_crash_before_publishing_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    results.append_ledger(runs(spark, ["a"]), path)
    with monkeypatch.context() as m:
        m.setattr(Versions, "claim", lambda *_: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            results.append_ledger(runs(spark, ["lost"]), path)
    assert ledger(spark, path) == ["a"]
    results.append_ledger(runs(spark, ["b"]), path)
    assert ledger(spark, path) == ["a", "b"]


def test_the_slower_writer_appends_to_the_faster(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    results.append_ledger(runs(spark, ["a"]), path)
    real, overtaken = Versions.claim, []

    def claim(self, number, said):
        if not overtaken:
            overtaken.append(number)
            results.append_ledger(runs(spark, ["fast"]), path)
        return real(self, number, said)

    monkeypatch.setattr(Versions, "claim", claim)
    results.append_ledger(runs(spark, ["slow"]), path)
    assert overtaken == [2]
    assert ledger(spark, path) == ["a", "fast", "slow"]


def test_a_version_is_claimed_once(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.claim(1, {"who": 1, "folders": []})
    assert not v.claim(1, {"who": 2, "folders": []})
    assert v.latest() == (1, {"who": 1, "folders": []})
    assert os.listdir(tmp_path / "v/drafts") == [] or all(n.startswith(".") for n in os.listdir(tmp_path / "v/drafts"))


def test_old_versions_go(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for i in range(5):
        results.append_ledger(runs(spark, [f"r{i}"]), path)
    v = Versions(spark, path)
    assert v.numbers() == [4, 5]
    assert len(os.listdir(tmp_path / "ledger/data")) == 2


def test_tables_that_are_not_given_stay(spark, tmp_path):
    nodes, edges = "key string, project string", "src string, project string"
    store = results.FragmentStore(spark, str(tmp_path / "cache"), "9.0", "a.sln")
    store.write(
        {"nodes": spark.createDataFrame([("n1", "p"), ("n2", "q")], nodes), "edges": spark.createDataFrame([("e1", "p"), ("e2", "q")], edges)},
        rebuilt=2, projects=2, known_projects=0,
    )
    store.write({"edges": spark.createDataFrame([("e3", "q")], edges)}, rebuilt=1, projects=2, known_projects=2)
    got = lambda t, s: {tuple(r) for r in store.read(t, s).collect()}
    assert got("nodes", nodes) == {("n1", "p"), ("n2", "q")}
    assert got("edges", edges) == {("e1", "p"), ("e3", "q")}
    current = spark.createDataFrame([("q",)], "project string")
    store.write({}, rebuilt=0, projects=1, known_projects=2, current=current)
    assert got("nodes", nodes) == {("n2", "q")} and got("edges", edges) == {("e3", "q")}


def test_two_writers_of_fragments(spark, tmp_path, monkeypatch):
    schema = "key string, project string"
    path = str(tmp_path / "cache")
    one, two = (results.FragmentStore(spark, path, "9.0", "a.sln") for _ in range(2))
    one.write({"nodes": spark.createDataFrame([("n1", "p")], schema)}, 1, 1, 0)
    real, overtaken = Versions.claim, []

    def claim(self, number, said):
        if not overtaken:
            overtaken.append(number)
            two.write({"nodes": spark.createDataFrame([("n2", "q")], schema)}, 1, 2, 1)
        return real(self, number, said)

    monkeypatch.setattr(Versions, "claim", claim)
    one.write({"nodes": spark.createDataFrame([("n3", "r")], schema)}, 1, 2, 1)
    assert {tuple(r) for r in one.read("nodes", schema).collect()} == {("n1", "p"), ("n2", "q"), ("n3", "r")}


def test_a_fragment_store_leaves_no_copy_behind(spark, tmp_path):
    store = results.FragmentStore(spark, f"file://{tmp_path}/fragments", "9.0", "a.sln")
    rows = spark.createDataFrame([("p", "a"), ("q", "b")], "project string, key string")
    made = len(workdir._made)
    store.write({"nodes": rows}, 2, 2, 0)
    assert not [at for at in workdir._made[made:] if "tidemark-fragments-" in at]
    assert {tuple(r) for r in store.read("nodes", "project string, key string").select("project", "key").collect()} == {("p", "a"), ("q", "b")}
