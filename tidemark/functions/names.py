"""Symbol keys, test names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_key(assembly: Column, doc_id: Column, kind: Column, display: Column) -> Column:
    """assembly|docid, `<none>` without an assembly; kind:display without a documentation id."""
    return F.when(doc_id.isNull() | (doc_id == ""), F.concat_ws(":", kind, display)).otherwise(
        F.concat_ws("|", F.coalesce(assembly, F.lit("<none>")), doc_id)
    )


def documentation_id(key: Column) -> Column:
    """I4: the part after the first `|`, if it is an upper-case letter, a colon and more; else null."""
    at = F.instr(key, "|")
    body = F.substr(key, at + 1)
    return F.when((at > 0) & body.rlike(r"^\p{Lu}:."), body)


def strip_arity(name: Column) -> Column:
    return F.split_part(name, F.lit("`"), F.lit(1))


def type_path(key: Column) -> Column:
    """Dotted path of a type key, generic arity cut from every segment; null for other keys."""
    doc = documentation_id(key)
    parts = F.transform(F.split(F.substr(doc, F.lit(3)), r"\."), strip_arity)
    return F.when(F.startswith(doc, F.lit("T:")), F.array_join(parts, "."))


def simple_name(key: Column) -> Column:
    """Declared name of a member: no parameters, no type, no explicit interface, no arity; `#ctor` survives."""
    doc = documentation_id(key)
    body = F.split_part(F.substr(doc, F.lit(3)), F.lit("("), F.lit(1))
    last = F.substring_index(body, ".", -1)
    # A `#` that isn't the first character separates an interface from its member.
    plain = F.when(F.instr(F.substr(last, F.lit(2)), "#") > 0, F.substring_index(last, "#", -1)).otherwise(last)
    name = strip_arity(plain)
    return F.when(F.length(name) > 0, name)


def full_class_name(namespace: Column, class_name: Column) -> Column:
    """Namespace.class, or the class alone without a namespace."""
    return F.when(F.coalesce(namespace, F.lit("")) == "", class_name).otherwise(F.concat_ws(".", namespace, class_name))


def fqn(namespace: Column, class_name: Column, method: Column) -> Column:
    return F.concat_ws(".", full_class_name(namespace, class_name), method)


def test_identity(project: Column, name: Column) -> Column:
    return F.concat_ws("|", project, name)


def nested_class(path: Column) -> Column:
    """Classes from the outermost in, joined by `+`."""
    return F.array_join(path, "+")


def normalize_test_name(name: Column) -> Column:
    """Text outside parentheses, nested ones included, trimmed; a name without `(` is only trimmed.

    Depth after each character is the running count of `(` less `)`, never below zero; a character is kept at depth zero.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(state: Column, c: Column) -> Column:
        depth = (
            F.when(c == "(", state["depth"] + 1)
            .when((c == ")") & (state["depth"] > 0), state["depth"] - 1)
            .otherwise(state["depth"])
        )
        keep = (state["depth"] == 0) & (c != "(")
        return F.struct(depth.alias("depth"), F.concat(state["out"], F.when(keep, c).otherwise("")).alias("out"))

    outside = F.aggregate(F.split(name, ""), start, step, lambda s: s["out"])
    return F.trim(F.when(F.contains(name, F.lit("(")), outside).otherwise(name))


def qualify_test_name(class_name: Column, name: Column) -> Column:
    """The class in front, unless the name begins with it already."""
    return F.when(
        class_name.isNull() | (class_name == "") | F.startswith(name, F.concat(class_name, F.lit("."))), name
    ).otherwise(F.concat_ws(".", class_name, name))


def normalize_path(path: Column) -> Column:
    """Forward slashes, trimmed."""
    return F.trim(F.translate(path, "\\", "/"))


def file_name(path: Column) -> Column:
    return F.substring_index(normalize_path(path), "/", -1)


def short_commit(commit: Column) -> Column:
    """Nine characters."""
    return F.left(commit, F.lit(9))


def truncate(text: Column, limit: int = 48) -> Column:
    """A text of over `limit` characters is cut three short of it and ends in dots."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def short_hash(*parts: Column, length: int = 16) -> Column:
    """SHA-256 of the parts joined by `|`, its first hex digits."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(length))


def cache_name(solution: Column, sdk: Column, type_flow: Column) -> Column:
    """Graph-<hash>.bin, the hash of solution and SDK, and of a mark if type flow is on."""
    mark = F.when(type_flow, F.lit("type-flow"))
    return F.concat(F.lit("graph-"), short_hash(solution, sdk, mark), F.lit(".bin"))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def suite_budget(baseline_seconds: Column) -> Column:
    """Four times the baseline, from two minutes to thirty."""
    return clamp(4 * baseline_seconds, 120.0, 1800.0)


def ratio(part: Column, whole: Column, when_zero: float) -> Column:
    return F.when(whole == 0, F.lit(when_zero)).otherwise(part / F.when(whole != 0, whole))
