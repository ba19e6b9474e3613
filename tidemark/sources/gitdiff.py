"""Diff text to tables."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Status letters.
STATUSES = {"A": "Added", "M": "Modified", "D": "Deleted", "R": "Renamed", "C": "Copied", "T": "TypeChanged"}
_HUNK = r"^@@+ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))?"


def _records(text: str) -> Iterator[tuple[str, str | None, str]]:
    fields = iter([f.strip("\r\n") for f in text.split("\0")])
    for status in fields:
        if not status:
            continue
        paths = [next(fields, None) for _ in range(2 if status[0] in "RC" else 1)]
        if None in paths or "" in paths:
            return
        old = paths[0].replace("\\", "/") if len(paths) == 2 else None
        yield paths[-1].replace("\\", "/"), old, STATUSES.get(status[0], "Modified")


def parse_name_status(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """A1: NUL-separated status records to (path, old_path, kind); a cut-off last record ends its text.

    Renames and copies take two fields, others one, so records depend on those before: one text is parsed in one go.
    """

    def run(batches):
        for pdf in batches:
            rows = [r for t in pdf[text_col] if t is not None for r in _records(t)]
            yield pd.DataFrame(rows, columns=["path", "old_path", "kind"])

    return texts.select(text_col).mapInPandas(run, "path string, old_path string, kind string")


def hunk_range(start: Column, count: Column) -> tuple[Column, Column]:
    """A4: lines that a hunk covers; a count of nothing stands for both lines around the place."""
    s, n = start.cast("int"), F.coalesce(count.cast("int"), F.lit(1))
    low = F.when(n == 0, F.greatest(F.lit(1), s)).otherwise(s)
    high = F.when(n == 0, F.greatest(F.lit(1), s + 1)).otherwise(s + n - 1)
    return low, high


def _lines(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    return texts.select(key, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))


def _sides(rows: DataFrame, *keep: str) -> DataFrame:
    def group(i: int) -> Column:
        return F.nullif(F.regexp_extract("line", _HUNK, i), F.lit(""))

    old, new = hunk_range(group(1), group(2)), hunk_range(group(3), group(4))
    sides = F.array(
        *[
            F.struct(F.lit(name).alias("side"), lo.alias("start_line"), hi.alias("end_line"))
            for name, (lo, hi) in (("old", old), ("new", new))
        ]
    )
    hunks = rows.where(F.col("line").rlike(_HUNK)).select(*keep, F.explode(sides).alias("h"))
    return hunks.select(*keep, "h.side", "h.start_line", "h.end_line")


def parse_hunks(texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """A2: hunks of single-file diffs: (key, side, start_line, end_line)."""
    return _sides(_lines(texts, key, text_col), key)


def parse_hunks_by_file(texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Hunks of diffs over many files: (key, path, side, start_line, end_line).

    A `diff --git` line begins a file, `---` and `+++` name it until its first hunk, after which they are lines of the
    file that were removed or added; a hunk counts for both names, so a rename is found by either. Names carry forward
    within the file only; /dev/null is no name. A window runs over one text's lines.
    """
    lines = _lines(texts, key, text_col)
    begins = F.startswith("line", F.lit("diff --git"))
    by_text = Window.partitionBy(key).orderBy("pos")
    files = lines.withColumn("file", F.sum(begins.cast("int")).over(by_text))
    upto = Window.partitionBy(key, "file").orderBy("pos")
    files = files.withColumn("in_head", ~F.max(F.col("line").rlike(_HUNK)).over(upto))

    def name(prefix: str) -> Column:
        raw = F.regexp_extract("line", rf"^{prefix} (?:[ab]/)?(.*?)[\t\r]*$", 1)
        is_name = F.col("in_head") & F.startswith("line", F.lit(prefix.replace("\\", "") + " "))
        return F.when(is_name & ~raw.isin("/dev/null", ""), F.translate(raw, "\\", "/"))

    carried = files.withColumns(
        {
            "old_name": F.last(name("---"), ignorenulls=True).over(upto),
            "new_name": F.last(name(r"\+\+\+"), ignorenulls=True).over(upto),
        }
    )
    names = F.array_distinct(F.array_compact(F.array("old_name", "new_name")))
    hunks = _sides(carried.withColumn("names", names), key, "names")
    return hunks.select(key, F.explode("names").alias("path"), "side", "start_line", "end_line").distinct()


class GitClient:
    """A5: the few commands an analysis needs, on the driver."""

    def __init__(self, root: str, timeout: float = 120):
        self.root, self.timeout = root, timeout

    def _git(self, *args: str) -> str | None:
        done = subprocess.run(
            ["git", "-C", self.root, *args],
            capture_output=True,
            timeout=self.timeout,
            env={"GIT_TERMINAL_PROMPT": "0", "PATH": "/usr/bin:/bin:/usr/local/bin"},
        )
        return done.stdout.decode(errors="replace") if done.returncode == 0 else None

    def resolve_commit(self, ref: str) -> str | None:
        out = self._git("rev-parse", "--verify", f"{ref}^{{commit}}")
        return out.strip() if out else None

    def merge_base(self, a: str, b: str = "HEAD") -> str | None:
        out = self._git("merge-base", a, b)
        return out.strip() if out else None

    def is_ancestor(self, a: str, b: str = "HEAD") -> bool:
        return self._git("merge-base", "--is-ancestor", a, b) is not None

    def base(self, ref: str) -> tuple[str | None, str | None]:
        """(commit to compare with, reason for a full run): the merge base where the ref isn't an ancestor."""
        commit = self.resolve_commit(ref)
        if commit is None:
            shallow = (self._git("rev-parse", "--is-shallow-repository") or "").strip() == "true"
            return None, f"{ref} can't be reached" + " in this shallow clone" * shallow
        if self.is_ancestor(commit):
            return commit, None
        found = self.merge_base(commit)
        return found, None if found else f"{ref} has no merge base with HEAD"

    def tables(self, spark: SparkSession, base: str, page: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Changed files, hunks and untracked files against `base`; diffs are fetched a hundred paths at a time."""
        status = self._git("diff", "--name-status", "-M", "-z", base) or ""
        changed = parse_name_status(spark.createDataFrame([(status,)], "text string"))
        paths = sorted({p for new, old, _ in _records(status) for p in (new, old) if p})
        diffs = [
            (i, self._git("diff", "-U0", "-M", base, "--", *paths[i : i + page]) or "")
            for i in range(0, len(paths), page)
        ]
        hunks = parse_hunks_by_file(spark.createDataFrame(diffs, "part int, text string"), "part").drop("part")
        loose = self._git("ls-files", "--others", "--exclude-standard", "-z") or ""
        untracked = spark.createDataFrame([(p,) for p in loose.split("\0") if p], "path string")
        return changed, hunks, untracked
