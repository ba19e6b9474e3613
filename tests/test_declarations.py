"""Edges from declarations: inheritance, implementations, overrides, requests; redirects and visibility."""

import random

from tidemark.operators import declarations as d
from tidemark.plans.doubling import after_steps
from tidemark.schemas import BASES, DECLARED_TYPES, MEMBERS


def member(key, name, params=(), override=False, overridable=False, public=True, explicit=None, accessor=False):
    return (key, key.split(".")[0], name, list(params), override, overridable, public, explicit, accessor)


def edges(spark, types, bases, members, tracked=None):
    t = spark.createDataFrame([(n, n[0] == "I", n[0] == "A") for n in types], DECLARED_TYPES)
    b = spark.createDataFrame([(x, y, list(a)) for x, y, *a in bases], BASES)
    m = spark.createDataFrame(members, MEMBERS)
    known = spark.createDataFrame([(n,) for n in (tracked or types)], "type string")
    return {tuple(r) for r in d.declaration_edges(t, b, m, known).collect()}


def test_derived_edges_reach_all_levels(spark):
    got = edges(spark, ["I", "J", "B", "C"], [("J", "I"), ("B", "J"), ("C", "B"), ("C", "X")], [])
    assert got == {("I", "J", 8), ("J", "B", 8), ("I", "B", 8), ("B", "C", 8), ("J", "C", 8), ("I", "C", 8)}


def test_implementations_come_from_the_nearest_class(spark):
    members = [
        member("I.m", "m"), member("I.get_p", "get_p", accessor=True), member("I.p", "p"),
        member("B.m", "m"), member("C.m", "m"), member("C.explicit", "m", explicit="I.m", public=False), member("B.p", "p"), member("D.q", "m", public=False),
    ]
    got = edges(spark, ["I", "B", "C", "D"], [("B", "I"), ("C", "B"), ("D", "B")], members)
    links = {e for e in got if e[2] in (2, 256)}
    # Of C's own the explicit one; D's private member implements nothing, so B's does.
    assert links == {("I.m", "B.m", 2), ("B.m", "I.m", 256), ("I.m", "C.explicit", 2), ("C.explicit", "I.m", 256), ("I.p", "B.p", 2), ("B.p", "I.p", 256)}


def test_an_own_public_member_comes_before_an_explicit_one_above(spark):
    members = [member("I.m", "m"), member("B.x", "m", explicit="I.m", public=False), member("C.m", "m")]
    got = edges(spark, ["I", "B", "C"], [("B", "I"), ("C", "B"), ("C", "I")], members)
    assert {e for e in got if e[2] == 2} == {("I.m", "B.x", 2), ("I.m", "C.m", 2)}


def test_arguments_are_composed_along_the_way(spark):
    members = [
        member("I.h", "h", ["!0!", "int"]), member("B.h", "h", ["List<!1!>", "int"]), member("C.other", "h", ["Order", "int"]),
    ]
    bases = [("IJ", "I", "List<!1!>"), ("B", "IJ", "int", "!1!"), ("C", "B", "Other", "Order")]
    got = edges(spark, ["I", "IJ", "B", "C", "Order", "List"], bases, members)
    assert {e for e in got if e[2] == 2} == {("I.h", "B.h", 2)}
    # C is a handler of lists: what I takes is List<Order> there.
    assert {e for e in got if e[2] == 128} == {("C", "List", 128), ("C.other", "List", 128), ("B", "List", 128), ("B.h", "List", 128)}


def test_overrides(spark):
    members = [
        member("A.m", "m", overridable=True), member("B.m", "m", override=True, overridable=True), member("C.m", "m", override=True),
        member("C.n", "m", ["int"], override=True), member("A.n", "m", ["int"]),
    ]
    got = edges(spark, ["A", "B", "C"], [("B", "A"), ("C", "B")], members)
    assert {e for e in got if e[2] in (4, 512)} == {("A.m", "B.m", 4), ("B.m", "A.m", 512), ("B.m", "C.m", 4), ("C.m", "B.m", 512)}


def test_requests(spark):
    members = [
        member("IH.handle", "handle", ["!0!"]), member("IH.result", "result"), member("IE.each", "each"),
        member("H.handle", "handle", ["Order"]), member("A.handle", "handle", ["Order"]), member("S.handle", "handle", ["S"]),
    ]
    bases = [("H", "IH", "Order", "Answer"), ("H", "IE", "Line"), ("A", "IH", "Order", "Answer"), ("S", "IH", "S", "Answer"), ("U", "IH", "Elsewhere", "Answer")]
    got = edges(spark, ["IH", "IE", "H", "A", "S", "U", "Order", "Answer", "Line"], bases, members)
    # What comes back, what an abstract class takes, itself and what isn't tracked are no requests.
    assert {e for e in got if e[2] == 128} == {("H", "Order", 128), ("H.handle", "Order", 128)}


def test_redirects_end_after_sixteen_steps(spark):
    rows = [(f"s{i}", f"s{i + 1}", False) for i in range(20)] + [("s20", None, False)]
    rows += [("a", "b", False), ("b", "ns", False), ("ns", "out", True), ("x", "away", False), ("c1", "c2", False), ("c2", "c1", False)]
    got = dict(map(tuple, d.normalised(spark.createDataFrame(rows, "symbol string, to string, is_dropped boolean")).collect()))
    assert [got[f"s{i}"] for i in range(6)] == ["s16", "s17", "s18", "s19", "s20", "s20"]
    assert (got["a"], got["b"], got["ns"], got["x"], got["c1"]) == (None, None, None, "away", "c1")


def test_steps_by_doubling(spark):
    rng = random.Random(3)
    to = {i: rng.choice([None, rng.randrange(60)]) for i in range(50)}
    got = dict(map(tuple, after_steps(spark.createDataFrame(list(to.items()), "key int, to int"), 3).collect()))
    for i in to:
        at = i
        for _ in range(8):
            at = to.get(at) if to.get(at) is not None else at
        assert got[i] == at


def test_visibility(spark):
    rows = [("a", None, False, False), ("a.b", "a", True, False), ("a.b.c", "a.b", False, False), ("a.b.e", "a.b", False, True), ("a.d", "a", False, False)]
    rows += [(f"n{i}", f"n{i - 1}" if i else None, i == 0, False) for i in range(40)] + [("o", "gone", False, False), ("p", "q", False, False), ("q", "p", False, False)]
    got = dict(map(tuple, d.visible(spark.createDataFrame(rows, "symbol string, container string, is_private boolean, is_explicit boolean")).collect()))
    assert [k for k, v in got.items() if v and k[0] != "n"] and not any(v for k, v in got.items() if k[0] == "n")
    assert {k: v for k, v in got.items() if k[0] != "n"} == {"a": True, "a.b": False, "a.b.c": False, "a.b.e": True, "a.d": True, "o": True, "p": True, "q": True}
