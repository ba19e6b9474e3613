"""Escapes and texts of test filters and explanations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What edges are called, in the order in which the kinds of a mixed edge are asked for.
EDGE_TEXTS = (
    (256, "implementation -> interface member"),
    (2, "interface member -> implementation"),
    (512, "override -> virtual member"),
    (4, "virtual member -> override"),
    (16, "fixture -> test"),
    (8, "base type -> derived type"),
    (32, "type -> declared member"),
    (64, "attribute -> annotated symbol"),
    (1024, "endpoint -> a member naming its route"),
    (128, "handler -> the request type that selects it"),
)
_OTHER_EDGE = "referenced by"


def escape_vstest(value: Column) -> Column:
    r"""A backslash before each of \ ( ) & | = ! ~."""
    return F.regexp_replace(value, r"([\\()&|=!~])", r"\\$1")


def escape_tree_node(value: Column) -> Column:
    r"""A backslash before each of / * ( ) [ ] | & , \; a lone star is a wildcard and stays."""
    return F.when(value == "*", value).otherwise(F.regexp_replace(value, r"([/*()\[\]|&,\\])", r"\\$1"))


def shell_quote(argument: Column) -> Column:
    """Quotes around an argument with a space or a bar."""
    needs = F.contains(argument, F.lit(" ")) | F.contains(argument, F.lit("|"))
    return F.when(needs, F.concat(F.lit('"'), argument, F.lit('"'))).otherwise(argument)


def arguments_length(arguments: Column) -> Column:
    """Characters of a command line, three more for each argument."""
    return F.aggregate(arguments, F.lit(0), lambda n, a: n + F.length(a) + 3)


def edge_text(kind: Column) -> Column:
    """What an edge of this kind says."""
    out = F.lit(_OTHER_EDGE)
    for bit, text in reversed(EDGE_TEXTS):
        out = F.when(kind.bitwiseAND(F.lit(bit)) != 0, F.lit(text)).otherwise(out)
    return out
