"""Route templates: normal form, combination, wildcard match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def route_segments(template: Column) -> Column:
    """Lower-case segments, parameters as `*`; null without any literal segment."""
    parts = F.filter(F.split(F.trim(template), "/"), lambda s: s != "")
    named = F.transform(parts, lambda s: F.when(F.contains(s, F.lit("{")), F.lit("*")).otherwise(F.lower(s)))
    return F.when(F.exists(named, lambda s: s != "*"), named)


def normalise_route(template: Column) -> Column:
    return F.array_join(route_segments(template), "/")


def combine_routes(prefix: Column, route: Column) -> Column:
    """Prefix and route with one slash between; the other as it is if one is null or empty."""

    def lacking(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) == ""

    both = F.concat_ws("/", F.rtrim(prefix, F.lit("/")), F.ltrim(route, F.lit("/")))
    return F.when(lacking(prefix), route).when(lacking(route), prefix).otherwise(both)


def segments_match(template: Column, reference: Column) -> Column:
    """I8: equal counts, and each segment of the template is a wildcard or equals the reference's."""
    same = F.zip_with(template, reference, lambda x, y: F.coalesce((x == "*") | (x == y), F.lit(False)))
    return (F.size(template) == F.size(reference)) & F.forall(same, lambda ok: ok)


def attribute_name(name: Column) -> Column:
    """Last dotted part without the ending `Attribute`."""
    return F.regexp_replace(F.substring_index(name, ".", -1), "(?<=.)Attribute$", "")
