"""URL filtering by a trie over reversed host labels and path segments.

A rule is (verdict, host, path): it fits its host and every subdomain of it if the URL's path begins with the rule's. The
trie goes down the host's labels from the right; at each node hang the rules' paths, as a second trie over whole path
segments whose last, unfinished part is kept as a prefix of the next segment. Of all rules that fit, the one with the
longest host wins, then the longest path; of equal rules `block` wins. Rules are broadcast, and each Python worker builds
the trie of them once. Their size is checked: more than `pass_bytes` of them are taken in passes of at most so much, and
each pass keeps the longer of its own rule and the one found before, so any number of rules gives the same rows.

Defined cases: a null URL or one without `://` has empty host and path; an empty host fits only rules of an empty host;
no rule: verdict `default`; rows are kept one to one, ids are carried; other columns are ignored.
"""

from __future__ import annotations

import uuid
from bisect import insort
from collections.abc import Iterable, Iterator

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

Rule = tuple[str, str, str]
#: Length of the rule's host, length of its path, rule, verdict.
Found = tuple[int, int, str, str]


class Paths:
    """Path prefixes: segments that must be equal, then a prefix of the next segment."""

    __slots__ = ("below", "ends", "lengths")

    def __init__(self):
        self.below: dict[str, Paths] = {}
        self.ends: dict[str, Found] = {}
        #: Different lengths of `ends`, longest first: as many as a segment has characters at most.
        self.lengths: list[int] = []

    def add(self, path: str, found: Found) -> None:
        *whole, last = path.split("/")
        at = self
        for s in whole:
            at = at.below.setdefault(s, Paths())
        if last not in at.ends or found[3] == "block":
            at.ends[last] = found
        if len(last) not in at.lengths:
            insort(at.lengths, len(last), key=int.__neg__)

    def longest(self, path: str) -> Found | None:
        best, at = None, self
        for s in path.split("/"):
            for n in at.lengths:
                if n <= len(s) and s[:n] in at.ends:
                    best = at.ends[s[:n]]
                    break
            at = at.below.get(s)
            if at is None:
                break
        return best


class Hosts:
    """Host labels from the right, with the paths of the rules that end at each."""

    __slots__ = ("below", "paths")

    def __init__(self, rules: Iterable[Rule] = ()):
        self.below: dict[str, Hosts] = {}
        self.paths: Paths | None = None
        for rule in rules:
            self.add(rule)

    def add(self, rule: Rule) -> None:
        verdict, host, path = rule
        host, at = host.lower(), self
        for label in reversed(host.split(".")) if host else ():
            at = at.below.setdefault(label, Hosts())
        at.paths = at.paths or Paths()
        at.paths.add(path, (len(host), len(path), host + path, verdict))

    def longest(self, host: str, path: str) -> Found | None:
        """The longest rule that fits."""
        best, at = None, self
        for label in reversed(host.split(".")) if host else ():
            at = at.below.get(label)
            if at is None:
                return best
            if at.paths and (found := at.paths.longest(path)):
                best = found
        if not host and self.paths:
            best = self.paths.longest(path)
        return best


def passes(rules: Iterable[Rule], pass_bytes: int) -> Iterator[list[Rule]]:
    """The rules in lists of bounded size; one empty list if there are none."""
    some: list[Rule] = []
    held = 0
    for rule in rules:
        n = sum(len(x.encode()) for x in rule)
        if some and held + n > pass_bytes:
            yield some
            some, held = [], 0
        some.append(rule)
        held += n
    yield some


_TRIES: dict[str, Hosts] = {}


def _trie(key: str, rules: Broadcast) -> Hosts:
    """This worker's trie of a pass's rules; it holds one at a time."""
    if key not in _TRIES:
        _TRIES.clear()
        _TRIES[key] = Hosts(rules.value)
    return _TRIES[key]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, as DataFrame functions."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(""), F.when(has, path).otherwise("")


def judge(
    pages: DataFrame,
    rules: Iterable[Rule],
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    pass_bytes: int = 32 << 20,
) -> DataFrame:
    """Every row with page_id, host, path, rule and verdict."""
    context = pages.sparkSession.sparkContext
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        host.alias("host"),
        path.alias("path"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(default).alias("verdict"),
        F.lit(-1).alias("host_length"),
        F.lit(-1).alias("path_length"),
    )
    for some in passes(rules, pass_bytes):
        if wrong := {v for v, _, _ in some} - {"allow", "block"}:
            raise ValueError(f"no such verdicts: {sorted(wrong)}")
        sent, key = context.broadcast(some), uuid.uuid4().hex

        def make(sent=sent, key=key):
            top = _trie(key, sent)

            def row(page_id, host, path, rule, verdict, host_length, path_length):
                found = top.longest(host, path)
                if found and (found[:2] > (host_length, path_length) or found[:2] == (host_length, path_length) and found[3] == "block"):
                    host_length, path_length, rule, verdict = found
                yield page_id, host, path, rule, verdict, host_length, path_length

            return row

        columns = "page_id long, host string, path string, rule string, verdict string, host_length int, path_length int"
        rows = map_rows(rows, make, columns)
    return rows.drop("host_length", "path_length")
