"""Periodic runs: stretches of words that repeat with a period, found by internal pattern matching.

A run is a stretch of words with least period q and at least max(`least`, 2 q) words that can't be made longer. A run of
period q holds every block of words twice, q apart. So dyadic blocks, at a few places each, ask where else they occur in
the window of places that a period of their size could lead to:

* Prefix doubling gives names for all stretches of 2^k words, and with them the suffix array. The places of a block are
  an interval of it, known from the block's name.
* A wavelet tree over the suffix array gives the occurrences in a window: the successor of a place within the interval is
  the one after those that lie below it.
* Half a block wide, a window holds one arithmetic progression at most. If one periodic stretch covers block and
  progression, its own period is found by smaller blocks and the progression gives nothing new; else each distance is a
  candidate. Every candidate is extended both ways over the names of stretches, which settles it exactly.

Texts are handled many at a time, one after the other with a mark of its own behind each, in tasks of their own; a text in
which no block of the smallest size occurs twice has no run and is left out before. Memory is about 100 bytes for each
word of the longest text, or of 65,536 words.

Defined cases: a null or empty text has no words, no run, nulls for the longest and the hash of the empty string; a null id
leaves its text as it is (in the digest) and is returned; each row gives a row, repeated ones too; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, mix64, text_bytes

_BATCH_WORDS = 1 << 16
_HELD_WORDS = 400_000


def _firsts(keys: np.ndarray) -> np.ndarray:
    """For each of some ascending keys the place of the first that equals it."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


class Factors:
    """Names of all stretches of 2^k values, and the suffix array. The last value must occur nowhere else.

    The name of a stretch is the place in the suffix array of the first suffix that begins with it.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        order = np.argsort(values, kind="stable")
        first = _firsts(values[order])
        names = np.empty(n, np.int64)
        names[order] = first
        self.names = [names]
        again = np.bincount(first, minlength=n)[first] > 1
        active, width = order[again], 1
        while len(active):
            key = names[active] * (n + 1) + names[active + width]
            o = np.argsort(key)
            active, key = active[o], key[o]
            old = names[active]
            names = names.copy()
            at = _firsts(key)
            names[active] = old + at - _firsts(old)
            self.names.append(names)
            active = active[np.bincount(at, minlength=len(at))[at] > 1]
            width *= 2
        self.array = np.empty(n, np.int64)
        self.array[names] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many values from i on equal those from j on; i is not j."""
        out = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.names))):
            out += (self.names[k][i + out] == self.names[k][j + out]).astype(np.int64) << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many values before i equal those before j, from the last; i < j."""
        out = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.names))):
            a, b = i - out - (1 << k), j - out - (1 << k)
            out += ((a >= 0) & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])).astype(np.int64) << k
        return out


class Wavelet:
    """Wavelet tree, level by level, over a permutation of range(n)."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        values = values.astype(np.int32)
        for bit in reversed(range(len(values).bit_length())):
            zero = (values >> bit) & 1 == 0
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(zero, out=before[1:])
            self.levels.append((bit, before, before[-1]))
            values = np.concatenate((values[zero], values[~zero]))

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of the interval [lo, hi) are less than x, itself len(values) at most."""
        lo, hi, x = lo.astype(np.int32), hi.astype(np.int32), x.astype(np.int32)
        out = np.zeros(len(lo), np.int32)
        for bit, before, zeros in self.levels:
            one = (x >> bit) & 1 == 1
            a, b = before[lo], before[hi]
            out += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
        return out.astype(np.int64)

    def nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of the interval that k others are less than."""
        lo, hi, k = lo.astype(np.int32), hi.astype(np.int32), k.astype(np.int32)
        out = np.zeros(len(lo), np.int64)
        for bit, before, zeros in self.levels:
            a, b = before[lo], before[hi]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            out += one.astype(np.int64) << bit
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
        return out


class Finder:
    """Runs of at least max(least, 2 q) values."""

    def __init__(self, least: int = 12):
        if least < 2:
            raise ValueError("a run has two values at least")
        self.least = least
        # A run holds every stretch of `room` words twice. Smallest blocks are `block` long and begin every `step` places,
        # so that one lies in each such stretch; they find periods under four blocks.
        room = (least + 1) // 2
        self.first = max(1, 2 * room // 3).bit_length() - 1
        self.block = 1 << self.first
        self.step = room - self.block + 1

    def _occurrences(self, f: Factors, tree: Wavelet, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of blocks of 2^k values and the distances to their copies that may be periods."""
        n, block = len(f.array), 1 << k
        step, low, high = (self.step, 1, 4 * block - 2) if k == self.first else (block, 2 * block - 1, 4 * block - 2)
        names = f.names[k]
        at = np.arange(0, n, step)
        lo = names[at]
        hi = lo + np.bincount(names, minlength=n)[lo]
        some = np.flatnonzero(hi - lo > 1)
        at, lo, hi = at[some], lo[some], hi[some]
        some = np.flatnonzero(tree.below(lo, hi, np.minimum(at + high + 1, n)) > tree.below(lo, hi, np.minimum(at + low, n)))
        at, lo, hi = at[some], lo[some], hi[some]
        places, distances = [], []
        half = max(1, block // 2)
        for d in range(low, high + 1, half) if len(at) else ():
            begin = tree.below(lo, hi, np.minimum(at + d, n))
            end = tree.below(lo, hi, np.minimum(at + min(d + half, high + 1), n))
            count = end - begin
            many = np.flatnonzero(count > 2)
            if len(many):
                one = tree.nth(lo[many], hi[many], begin[many])
                period = tree.nth(lo[many], hi[many], begin[many] + 1) - one
                last = one + period * (count[many] - 1)
                covers = at[many] + period + f.ahead(at[many], at[many] + period) >= last + block
                count[many[covers]] = 0
            each = np.repeat(np.arange(len(at)), count)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            places.append(at[each])
            distances.append(tree.nth(lo[each], hi[each], begin[each] + nth) - at[each])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *places]), np.concatenate([none, *distances])

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """Rows (start, end, period) of all runs, by start, then period. The last value must occur nowhere else."""
        f = Factors(values)
        if len(f.names) <= self.first:
            return np.zeros((0, 3), np.int64)
        tree = Wavelet(f.array)
        found = []
        for k in range(self.first, len(f.names)):
            at, distance = self._occurrences(f, tree, k)
            start = at - f.behind(at, at + distance)
            end = at + distance + f.ahead(at, at + distance)
            ok = end - start >= np.maximum(self.least, 2 * distance)
            found.append(np.stack((start[ok], end[ok], distance[ok]), 1))
        runs = np.concatenate(found)
        # The same stretch also comes with multiples of its period.
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        new = np.ones(len(runs), bool)
        new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
        runs = runs[new]
        return runs[np.lexsort((runs[:, 2], runs[:, 0]))]

    def of_many(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The runs of each of some arrays of small integers from 0."""
        out = [np.zeros((0, 3), np.int64)] * len(texts)
        which = [i for i in self._with_repeats(texts) if len(texts[i]) >= self.least]
        if not which:
            return out
        top = 1 + max(int(texts[i].max()) for i in which)
        # Equal values in different texts differ, and each text ends with a mark of its own.
        joined = np.concatenate([np.append(texts[i], top) + j * (top + 1) for j, i in enumerate(which)])
        begins = np.cumsum([0, *(len(texts[i]) + 1 for i in which)])
        runs = self(joined)
        cuts = np.searchsorted(runs[:, 0], begins)
        for j, i in enumerate(which):
            some = runs[cuts[j] : cuts[j + 1]].copy()
            some[:, :2] -= begins[j]
            out[i] = some
        return out

    def _with_repeats(self, texts: list[np.ndarray]) -> list[int]:
        """The texts in which some block of the smallest size may occur twice: a run can be in no other."""
        if not texts:
            return []
        sizes = [len(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), sizes)
        hashes = Rolling(0x9E3779B97F4A7C15)(mix64(np.concatenate(texts).astype(np.uint64) + np.uint64(1)), self.block)
        inside = np.flatnonzero(owner[: len(hashes)] == owner[self.block - 1 :]) if len(hashes) else np.zeros(0, np.int64)
        hashes, owner = mix64(hashes[inside] + mix64(owner[inside].astype(np.uint64))), owner[inside]
        order = np.argsort(hashes)
        hashes = hashes[order]
        return np.unique(owner[order[1:][hashes[1:] == hashes[:-1]]]).tolist()


class _Ids(dict):
    """Word -> small integer, another for each word."""

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The digest's words: in one document of ten, by its id, the words from some place on repeat with a period."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


_SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


def _describe(doc_id: int | None, words: list[bytes], runs: np.ndarray, texts: bool) -> tuple:
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    keep = words if not len(runs) else [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    lines = [(a, b - a, q) for a, b, q in runs.tolist()]
    said = "".join(f"{a},{n},{q}\n" for a, n, q in lines).encode()
    longest = min(lines, key=lambda x: (-x[1], x[0], x[2]), default=None)
    best = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    text = b" ".join(keep)
    more = ([{"start": a, "length": n, "period": q} for a, n, q in lines], text.decode()) if texts else (None, None)
    return doc_id, len(lines), *best, hashlib.sha256(said).hexdigest(), hashlib.sha256(text).hexdigest(), *more


def find_runs(
    docs: DataFrame,
    least: int = 12,
    id_col: str = "doc_id",
    text_col: str = "text",
    texts: bool = False,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Every row with the number of its runs, the longest of them, and hashes of all runs and of the collapsed words.

    A word is dropped from `collapsed` if a run holds it after that run's first period. With `texts` the runs and the
    collapsed text are given too, else they are null. `rewrite` may change the words of a text before.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(least)
        held: list[tuple[int | None, list[bytes]]] = []
        arrays: list[np.ndarray] = []
        ids, count = _Ids(), 0

        def done() -> pa.RecordBatch:
            rows = [_describe(*x, runs, texts) for x, runs in zip(held, finder.of_many(arrays), strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
            )

        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, words = batch.column(0)[i].as_py(), batch.column(1)[i].as_py().split()
                if rewrite:
                    words = rewrite(doc_id, words)
                held.append((doc_id, words))
                arrays.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
                count += 1 + len(words)
                if count >= _BATCH_WORDS:
                    yield done()
                    held, arrays, count = [], [], 0
                    if len(ids) > _HELD_WORDS:
                        ids = _Ids()
        if held:
            yield done()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(F.col(text_col)).alias("text"))
    return source.mapInArrow(run, _SCHEMA)


def digest(docs: DataFrame) -> DataFrame:
    """The runs of the documents, of which one in ten gets a periodic tail."""
    return find_runs(docs, rewrite=repeat_tail).drop("runs", "collapsed")
