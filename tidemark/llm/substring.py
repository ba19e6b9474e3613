"""Substring deduplication: word windows that also start in a document with a smaller id are removed.

Every window of `width` words has a Rabin-Karp hash (two of them, 128 bits in all). Which windows repeat is counted in
Spark. To count few rows, a window first gets an anchor: the least hash among its runs of `run` words. Equal windows have
equal anchors, so a window whose anchor is in one text only is alone, and only the others' hashes are counted. Anchors
are one in `width - run` words or so, and exact copies of a text are settled before by a hash of the whole text.

A repeated window's least id is an aggregate; the marks that follow from it are joined back and gathered per document,
where they merge into maximal intervals of removed words. No group of equal windows is gathered anywhere.

Defined cases: null text has no words; a null id has no smaller id and is none's; of equal ids none is smaller, so windows
that repeat only among them stay; each row is judged by its own id and text, so repeated rows get the same result; a text
shorter than a window stays whole; the hash of no kept words is that of the empty string; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, WordHashes, among, covered, kept, map_rows, mix64, sliding_min, text_bytes

_SEED = 11
# Bases of the two window hashes; the second is over mixed word hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Windows:
    """Anchors and hashes of a text's windows."""

    def __init__(self, width: int, run: int):
        self.width, self.run = width, run
        self.words = WordHashes(_SEED)
        self.roll = [Rolling(b) for b in _BASES]

    def anchors(self, words: list[bytes]) -> np.ndarray:
        """The anchor of each window, in order."""
        if len(words) < self.width:
            return np.zeros(0, np.int64)
        return self._anchors(self.words.of(words))

    def _anchors(self, values: np.ndarray) -> np.ndarray:
        runs = mix64(self.roll[0](values, self.run))
        return sliding_min(runs, self.width - self.run + 1).view(np.int64)

    def all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor and both hashes of each window; there must be one."""
        values = self.words.of(words)
        one, two = self.roll[0](values, self.width), self.roll[1](mix64(values), self.width)
        return self._anchors(values), one.view(np.int64), two.view(np.int64)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_SPOTS = "one long, two long, doc_id long, h long, at int"


def _spotter(width: int, run: int):
    """Rows (doc_id, h, text, anchors) to the hashes and places of the windows that have one of the anchors."""

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(width, run)
        names = ["one", "two", "doc_id", "h", "at"]
        held: list[tuple] = []
        count = 0

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, h, text, anchors = (c[i] for c in batch.columns)
                words = text.as_py().split()
                wanted = np.sort(anchors.values.to_numpy(zero_copy_only=False))
                found, one, two = windows.all(words)
                at = np.flatnonzero(among(found, wanted)).astype(np.int32)
                ids = np.full(len(at), doc_id.as_py(), np.int64), np.full(len(at), h.as_py(), np.int64)
                held.append((one[at], two[at], *ids, at))
                count += len(at)
                if count >= 100_000:
                    yield pack()
                    held, count = [], 0
        if count:
            yield pack()

    return spots


def remove_repeats(
    docs: DataFrame, width: int = 50, run: int = 16, id_col: str = "doc_id", text_col: str = "text", texts: bool = False
) -> DataFrame:
    """Every row with doc_id, n_words, n_removed, kept_sha256; with `texts`, also kept_text and removed intervals.

    `removed` is an array of [first word, word after the last) pairs in order.
    """
    if not 1 <= run < width:
        raise ValueError("run must be less than width")
    empty = hashlib.sha256(b"").hexdigest()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(F.col(text_col)).alias("text"))
    # A text's name: two 64-bit hashes. Beside an id, the first alone will do.
    source = source.withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit("second"), F.col("text"))})

    def first_pass():
        windows = Windows(width, run)

        def row(doc_id, text, h, g):
            words = text.split()
            found = windows.anchors(words) if doc_id is not None else np.zeros(0, np.int64)
            found = found[np.flatnonzero(np.diff(found, prepend=found[:1] - 1))]
            yield doc_id, h, g, len(words), _sha(words), list(set(found.tolist()))

        return row

    seen = kept(
        map_rows(source, first_pass, "doc_id long, h long, g long, n_words long, sha string, anchors array<long>"),
        "anchors",
    )
    # Aggregates are written before they are joined back: a join of two shuffles is one whose hot keys can be split.
    first = kept(seen.groupBy("h", "g").agg(F.min("doc_id").alias("first")), "first")
    known = seen.join(first, ["h", "g"]).withColumn(
        "later", F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= width), F.lit(False))
    )
    fresh = F.when(~F.col("later"), F.col("anchors")).alias("anchors")
    known = kept(known.select("doc_id", "h", "n_words", "sha", "later", fresh), "known")
    named = known.where(~F.col("later")).select("doc_id", "h", F.explode("anchors").alias("anchor"))
    repeated = (
        named.groupBy("anchor")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .where("least < most")
        .select("anchor")
    )
    repeated = kept(repeated, "repeated")
    wanted = named.join(repeated, "anchor").groupBy("doc_id", "h").agg(F.collect_set("anchor").alias("anchors"))
    # One row for each text that has a repeated anchor, with its text and those anchors: both are as long as the text.
    suspects = kept(
        source.select("doc_id", "h", "text").join(wanted, ["doc_id", "h"]),
        "suspects",
    )

    spots = kept(suspects.select("doc_id", "h", "text", "anchors").mapInArrow(_spotter(width, run), _SPOTS), "spots")
    least = spots.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least = kept(least.where("least < most").select("one", "two", "least"), "least")
    marks = (
        spots.join(least, ["one", "two"])
        .where("doc_id > least")
        .groupBy("doc_id", "h")
        .agg(F.collect_set("at").alias("at"))
    )

    def last_pass():
        def row(doc_id, h, text, at):
            words = text.split()
            gone = covered(np.array(at, np.int64), width, len(words))
            keep = [words[i] for i in np.flatnonzero(~gone).tolist()]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).tolist()
            removed = [list(x) for x in zip(edges[::2], edges[1::2], strict=True)]
            more = (b" ".join(keep).decode(), removed) if texts else (None, None)
            yield doc_id, h, int(gone.sum()), _sha(keep), *more

        return row

    cut = map_rows(
        suspects.select("doc_id", "h", "text").dropDuplicates(["doc_id", "h"]).join(marks, ["doc_id", "h"]),
        last_pass,
        "doc_id long, h long, gone long, kept_sha string, kept_text string, removed array<array<int>>",
    )
    out = known.drop("anchors").join(cut, ["doc_id", "h"], "left")
    result = {
        "doc_id": F.col("doc_id"),
        "n_words": F.col("n_words"),
        "n_removed": F.when(F.col("later"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long"),
        "kept_sha256": F.when(F.col("later"), F.lit(empty)).otherwise(F.coalesce("kept_sha", "sha")),
    }
    if not texts:
        return out.select(*[c.alias(k) for k, c in result.items()])
    plain = source.select(
        F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("text").cast("string").alias("_text")
    ).dropDuplicates(["_id", "_h"])
    joined = out.join(plain, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    all_words = F.array_join(F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    result["kept_text"] = F.when(F.col("later"), F.lit("")).otherwise(F.coalesce("kept_text", all_words))
    whole = F.array(F.array(F.lit(0), F.col("n_words").cast("int")))
    result["removed"] = F.when(F.col("later"), whole).otherwise(
        F.coalesce("removed", F.array().cast("array<array<int>>"))
    )
    return joined.select(*[c.alias(k) for k, c in result.items()])
