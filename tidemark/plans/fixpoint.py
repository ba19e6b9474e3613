"""Semi-naive fixpoints: each round derives rows from the last round's new rows only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from .workdir import written

Step = Callable[[DataFrame, int], DataFrame]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def fixpoint(start: DataFrame, step: Step, keys: list[str], most_rounds: int | None = None) -> DataFrame:
    """Rows that follow from `start` under `step`, each key once (from the round that found it first).

    `step(frontier, round)` gives candidates with the columns of `start`; the ones of known keys are dropped by an
    anti-join. Rounds are written tables, so a plan never grows with the depth.
    """
    frontier = written(start.dropDuplicates(keys), "round")
    rounds = [frontier]
    n = 0
    while (most_rounds is None or n < most_rounds) and not frontier.isEmpty():
        n += 1
        if len(rounds) > 8:
            rounds = [written(union_all(rounds), "rounds")]
        found = step(frontier, n).dropDuplicates(keys)
        frontier = written(found.join(union_all(rounds).select(*keys), keys, "left_anti").select(*start.columns), "round")
        rounds.append(frontier)
    return union_all(rounds)


def closure(links: DataFrame, src: str, dst: str, reflexive: bool = False) -> DataFrame:
    """Transitive closure of (src, dst); cycles end, and self pairs are kept only if `reflexive`."""
    pairs = links.select(links[src].alias("origin"), links[dst].alias("reached")).distinct()
    step_links = links.select(links[src].alias("reached"), links[dst].alias("next"))

    def step(frontier: DataFrame, _: int) -> DataFrame:
        return frontier.join(step_links, "reached").select("origin", step_links["next"].alias("reached"))

    out = fixpoint(pairs, step, ["origin", "reached"])
    if reflexive:
        ends = pairs.select("origin").unionByName(pairs.select(pairs.reached.alias("origin"))).distinct()
        return out.unionByName(ends.select("origin", ends.origin.alias("reached"))).distinct()
    return out.where("origin <> reached")
