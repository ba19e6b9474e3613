"""Edges that follow from declarations alone: inheritance, implementations, overrides, requests; names and visibility.

Inputs are tables of declarations, as an extractor gives them. A type is written by its key, its arguments in `<>`; in what
belongs to a generic type, `!0!`, `!1!` ... stand for that type's own parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.doubling import after_steps, any_above
from ..plans.fixpoint import fixpoint, union_all
from ..plans.workdir import written
from ..schemas import (
    DERIVED,
    DISPATCH_BY_REQUEST,
    IMPLEMENTATION_TO_INTERFACE,
    INTERFACE_TO_IMPLEMENTATION,
    OVERRIDE_TO_VIRTUAL,
    REDIRECTS,
    VIRTUAL_TO_OVERRIDE,
)


def substitute(text: Column, args: Column) -> Column:
    """A type's text with the parameters' places taken by arguments, all at once."""
    # Places of the text are marked first, so that places in the arguments aren't taken for them.
    marked = F.regexp_replace(text, r"!(\d+)!", "?$1?")
    numbered = F.transform(args, lambda a, i: F.struct(i.cast("string").alias("i"), a.alias("a")))
    return F.aggregate(numbered, marked, lambda t, x: F.replace(t, F.concat(F.lit("?"), x["i"], F.lit("?")), x["a"]))


def _all(texts: Column, args: Column) -> Column:
    return F.transform(texts, lambda t: substitute(t, args))


def ancestors(types: DataFrame, bases: DataFrame) -> DataFrame:
    """(type, base, args, depth, is_interface): every base type and interface of each type, directly or not.

    `types`: type, is_interface; `bases`: type, base, args, in terms of the type's parameters. The arguments are composed
    along the way; a base that is inherited with several lists of arguments comes once for each, at its least depth.
    """
    kinds = types.select(F.col("type").alias("base"), "is_interface")
    direct = bases.select("type", "base", "args").join(kinds, "base", "left")
    direct = direct.select("type", "base", "args", F.lit(1).alias("depth"), F.coalesce("is_interface", F.lit(False)).alias("is_interface"))
    direct = written(direct, "bases")
    up = direct.select(
        F.col("type").alias("base"), F.col("base").alias("_base"), F.col("args").alias("_args"), F.col("is_interface").alias("_is_interface")
    )

    def step(frontier: DataFrame, n: int) -> DataFrame:
        composed = _all(F.col("_args"), F.col("args"))
        return frontier.join(up, "base").select(
            "type", F.col("_base").alias("base"), composed.alias("args"), F.lit(n + 1).alias("depth"), F.col("_is_interface").alias("is_interface")
        )

    return written(fixpoint(direct, step, ["type", "base", "args"]), "ancestors")


def derived_edges(above: DataFrame, tracked: DataFrame) -> DataFrame:
    """From each tracked base type and interface to what derives from it, directly or not."""
    return (
        above.join(tracked.select(F.col("type").alias("base")), "base", "left_semi")
        .select(F.col("base").alias("src"), F.col("type").alias("dst"))
        .distinct()
        .withColumn("kind", F.lit(DERIVED))
    )


def _both_ways(pairs: DataFrame, down: int, up: int) -> DataFrame:
    """Edges of (general, specific) pairs."""
    pairs = pairs.where("general <> specific").distinct()
    return pairs.select(F.col("general").alias("src"), F.col("specific").alias("dst"), F.lit(down).alias("kind")).unionByName(
        pairs.select(F.col("specific").alias("src"), F.col("general").alias("dst"), F.lit(up).alias("kind"))
    )


def _levels(types: DataFrame, above: DataFrame) -> DataFrame:
    """(type, owner, args, depth): where a type's members may be declared: itself, then its base classes."""
    none = F.array().cast("array<string>")
    return types.select("type", F.col("type").alias("owner"), none.alias("args"), F.lit(0).alias("depth")).unionByName(
        above.where("NOT is_interface").select("type", F.col("base").alias("owner"), "args", "depth")
    )


def _nearest(wanted: DataFrame, levels: DataFrame, members: DataFrame, fits: Column) -> DataFrame:
    """(general, specific): what is wanted in a type, and the member nearest above that fits; an explicit one before others.

    `wanted`: type, general, name, params. A member's own parameters are turned into the type's before they are compared.
    """
    m = members.select("member", F.col("type").alias("owner"), F.col("name"), F.col("params").alias("_params"), "is_public", "is_overridable", "explicit_of")
    # On owner and name, so that a class with many subclasses isn't joined as a whole with each.
    found = wanted.join(levels, "type").join(m, ["owner", "name"])
    own = F.when(F.col("depth") == 0, F.col("_params")).otherwise(_all(F.col("_params"), F.col("args")))
    found = found.where(fits & (own == F.col("params")))
    order = F.struct("depth", F.col("explicit_of").isNull().alias("implicit"), "member")
    return found.groupBy("type", "general", "params").agg(F.min(order).alias("best")).select("general", F.col("best.member").alias("specific"))


def member_links(types: DataFrame, above: DataFrame, members: DataFrame, tracked: DataFrame) -> DataFrame:
    """Edges both ways between interface members and implementations, virtual members and overrides.

    An interface's member is implemented by the nearest of a type's own and its base classes' members: in one class an
    explicit implementation (`explicit_of`) comes before a public member of that name and parameters. A type that is an
    interface itself has explicit ones only. Accessors go with their properties. An override belongs to the nearest member
    of a base class of that name and parameters that may be overridden.
    """
    plain = members.where(~F.col("is_accessor"))
    asked = plain.select(F.col("type").alias("base"), F.col("member").alias("general"), F.col("name"), F.col("params").alias("_asked"))
    wanted = (
        above.where("is_interface")
        .join(tracked.select(F.col("type").alias("base")), "base", "left_semi")
        .join(asked, "base")
        .select("type", "general", "name", _all(F.col("_asked"), F.col("args")).alias("params"))
        .distinct()
        .join(types.select("type", F.col("is_interface").alias("by_interface")), "type")
    )
    explicit = F.col("explicit_of").eqNullSafe(F.col("general"))
    implicit = F.col("is_public") & F.col("explicit_of").isNull() & ~F.col("by_interface")
    implementations = _nearest(wanted, _levels(types, above), plain, explicit | implicit)
    overriding = plain.where("is_override").select("type", F.col("member").alias("general"), "name", "params")
    # The names are turned round: here the nearest member is the general one.
    overridden = _nearest(overriding, _levels(types, above).where("depth > 0"), plain, F.col("is_overridable"))
    overridden = overridden.select(F.col("specific").alias("general"), F.col("general").alias("specific"))
    return _both_ways(implementations, INTERFACE_TO_IMPLEMENTATION, IMPLEMENTATION_TO_INTERFACE).unionByName(
        _both_ways(overridden, VIRTUAL_TO_OVERRIDE, OVERRIDE_TO_VIRTUAL)
    )


def request_edges(types: DataFrame, above: DataFrame, members: DataFrame, tracked: DataFrame) -> DataFrame:
    """From a handler and each of its members to the tracked types that it handles.

    A class that isn't abstract handles an argument of one of its interfaces if some member of that interface takes it as a
    parameter: what a caller hands in, not what it gets back. The type itself is no request of its own.
    """
    interfaces = above.where(F.col("is_interface") & (F.size("args") > 0)).join(
        types.where("NOT is_interface AND NOT is_abstract").select("type"), "type", "left_semi"
    )
    taken = members.select(F.col("type").alias("base"), F.explode("params").alias("param"))
    requests = (
        interfaces.join(taken, "base")
        .withColumn("param", substitute(F.col("param"), F.col("args")))
        .where(F.array_contains("args", F.col("param")))
        # A generic argument goes by its definition.
        .select("type", F.regexp_replace("param", "<.*", "").alias("dst"))
        .where("type <> dst")
        .distinct()
        .join(tracked.select(F.col("type").alias("dst")), "dst", "left_semi")
    )
    by_member = requests.join(members.select("type", F.col("member").alias("src")), "type").select("src", "dst")
    both = requests.select(F.col("type").alias("src"), "dst").unionByName(by_member)
    return both.distinct().withColumn("kind", F.lit(DISPATCH_BY_REQUEST))


def declaration_edges(types: DataFrame, bases: DataFrame, members: DataFrame, tracked: DataFrame) -> DataFrame:
    """All edges that follow from declarations, for `graph.merge_edges`."""
    above = ancestors(types, bases)
    return union_all(
        [derived_edges(above, tracked), member_links(types, above, members, tracked), request_edges(types, above, members, tracked)]
    )


def normalised(symbols: DataFrame) -> DataFrame:
    """(symbol, key): what a reference to a symbol counts for.

    `symbols`: symbol, to, is_dropped. An accessor leads to its property, an array to its element, a local function to the
    member around it, and so on, for sixteen steps at most; what is dropped (namespaces, errors) counts for nothing (null).
    """
    dropped = symbols.where("is_dropped").select(F.col("symbol").alias("key"), F.lit(True).alias("_gone"))
    # What is dropped leads nowhere.
    links = symbols.select(F.col("symbol").alias("key"), F.when(~F.col("is_dropped"), F.col("to")).alias("to"))
    ends = after_steps(links, (REDIRECTS - 1).bit_length()).select(F.col("key").alias("symbol"), F.col("to").alias("key"))
    return ends.join(dropped, "key", "left").select("symbol", F.when(F.col("_gone").isNull(), F.col("key")).alias("key"))


def visible(symbols: DataFrame) -> DataFrame:
    """(symbol, visible): nothing private around it, nor itself, or an explicit implementation of an interface.

    `symbols`: symbol, container, is_private, is_explicit.
    """
    hidden = any_above(symbols, "symbol", "container", "is_private").select(F.col("key").alias("symbol"), F.col("flag").alias("hidden"))
    explicit = F.coalesce("is_explicit", F.lit(False))
    return symbols.select("symbol", "is_explicit").join(hidden, "symbol").select("symbol", (explicit | ~F.col("hidden")).alias("visible"))
