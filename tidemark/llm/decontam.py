"""Benchmark decontamination by SimHash over item-sized windows.

Words are runs of letters and digits, lower-cased, and in scripts written without spaces single characters; an item and a
window of as many words are compared by their five-word shingles with multiplicity, sum of least over sum of most counts,
and match at `similarity`. A document shorter than an item is one window. An item of under five words is one shingle, so
it matches where its words stand one after another.

A window can only match if enough of its shingles occur in the benchmark at all; the count needed follows from the
threshold and is checked first with running sums. What is left gets a SimHash, is looked up among items of the same
length in a multi-index of radius + 1 blocks, which holds every fingerprint within the radius, and candidates within the
radius are verified exactly.

At similarity 0.8 fingerprints of 64 bits differ in 10 bits on average; of simulated pairs at exactly that similarity up to
3 in 10,000 differ in more than 20 (24 at most), which the radius leaves out. No choice of blocks that holds every pair
within 20 bits rules out many others. The blocks are kept as columns of a small matrix that is compared at once; what keeps the
work small is the count of shingles that comes before.

Items are broadcast in passes of at most `pass_bytes` of text, so what is collected and sent is bounded whatever the
benchmark's size, and the index of a pass is about fifteen times that; each pass reads the documents once.

Defined cases: null items, items without a word and those under `least_words` words are not searched; null texts match
nothing; repeated items are each reported; a repeated row is reported again; a null id is carried; empty tables give none; other columns are
ignored by `search` and kept by `clean`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, WordHashes, among, kept, map_rows, mix64, place_of

_TOKEN = re.compile(r"[^\W_]+")
#: Letters, marks and digits of scripts without spaces: Thai, Lao, Myanmar, Khmer, Tai, Balinese, Javanese, kana, Han.
_UNSPACED = (
    "\u0e01-\u0e3a\u0e40-\u0e4e\u0e50-\u0e59\u0e81-\u0ece\u0ed0-\u0edf\u1000-\u1049\u1050-\u109d\u1780-\u17d3\u17d7\u17dc-\u17dd\u17e0-\u17e9"
    "\u1950-\u1974\u1980-\u19da\u1a20-\u1a99\u1b00-\u1b59\ua980-\ua9c0\ua9cf-\ua9d9\ua9e0-\ua9fe\uaa60-\uaa76\uaa7a-\uaadd\u3005-\u3007"
    "\u3041-\u309a\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3105-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
    "\uff66-\uff9f\U00020000-\U0003ffff"
)
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_MIXED_TOKEN = re.compile(f"[{_UNSPACED}]|[^\\W_{_UNSPACED}]+")
_SHINGLE = 5
_STARTS = 1 << 12
#: Slots of the table that says quickly whether a shingle may be in the benchmark.
_TABLE_BITS = 22


def tokens(text: str) -> list[str]:
    low = text.lower()
    return (_TOKEN if low.isascii() or not _ANY_UNSPACED.search(low) else _MIXED_TOKEN).findall(low)


class _Shingles:
    def __init__(self):
        self.words, self.roll = WordHashes(17), Rolling(0xA24BAED4963EE407)

    def __call__(self, words: list[str], k: int = _SHINGLE) -> np.ndarray:
        return mix64(self.roll(self.words.of(words), k))


def _simhashes(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the `width` shingles from each start on; starts ascend."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(starts, starts[i] + _STARTS))
        some, base = starts[i:j], int(starts[i])
        part = np.ascontiguousarray(hashes[base : int(some[-1]) + width])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        ones = sums[some - base + width] - sums[some - base]
        out[i:j] = np.packbits(2 * ones > width, axis=1, bitorder="little").view("<u8").ravel()
        i = j
    return out


def similarity_of(a: Counter, b: Counter) -> float:
    least = sum((a & b).values())
    return least / (sum(a.values()) + sum(b.values()) - least) if a or b else 0.0


Bag = tuple[np.ndarray, np.ndarray]


def bag(hashes: np.ndarray) -> Bag:
    """Different values, ascending, and how often each occurs."""
    return np.unique(hashes, return_counts=True)


def bag_similarity(a: Bag, b: Bag) -> float:
    """As `similarity_of`."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    least = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return least / (int(a[1].sum()) + int(b[1].sum()) - least)


class Length:
    """Items of one length: their places, fingerprints, and the blocks of these, a column for each."""

    def __init__(self, places: np.ndarray, prints: np.ndarray, blocks: list[tuple[np.uint64, np.uint64]]):
        self.places, self.prints = places, prints
        self.blocks = np.stack([((prints >> shift) & mask).astype(np.uint8) for shift, mask in blocks], axis=1)


class Index:
    """Items by length, and in each length by blocks of their fingerprints."""

    def __init__(self, items: list[tuple[object, str]], similarity: float, radius: int, least_words: int):
        self.similarity, self.radius, self.shingles = similarity, radius, _Shingles()
        self.ids, self.bags = [], []
        prints: list[np.uint64] = []
        by_length: dict[int, list[int]] = {}
        short: dict[int, dict[int, list[int]]] = {}
        members = []
        for item_id, text in items:
            words = tokens(text)
            if len(words) < max(1, least_words):
                continue
            h = self.shingles(words, min(_SHINGLE, len(words)))
            if len(words) < _SHINGLE:
                short.setdefault(len(words), {}).setdefault(int(h[0]), []).append(len(self.ids))
            else:
                by_length.setdefault(len(words), []).append(len(self.ids))
            self.ids.append(item_id)
            self.bags.append(bag(h))
            if len(words) >= _SHINGLE:
                members.append(self.bags[-1][0])
            prints.append(_simhashes(h, np.zeros(1, np.int64), len(h))[0])
        self.short = {n: (np.array(sorted(table), np.uint64), table) for n, table in short.items()}
        all_prints = np.array(prints, np.uint64)
        self.members = np.unique(np.concatenate(members)) if members else np.zeros(0, np.uint64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.members >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
        if max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) > 8:
            raise ValueError("blocks of over 8 bits: the radius is under 7")
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.lengths = {
            length: Length(np.array(some), all_prints[some], self.blocks) for length, some in by_length.items()
        }

    def candidates(self, length: int, fp: np.uint64) -> list[int]:
        """Items of that length within the radius of fp: those that share a block, then by distance."""
        items = self.lengths[length]
        keys = np.array([(fp >> shift) & mask for shift, mask in self.blocks], np.uint8)
        some = np.flatnonzero((items.blocks == keys).any(axis=1))
        return items.places[some[np.bitwise_count(items.prints[some] ^ fp) <= self.radius]].tolist()

    def matches(self, text: str | None, first_only: bool = False) -> list[tuple[int, int, int, float]]:
        """(item's place, first word, words, similarity): the best window of each item that matches."""
        words = tokens(text) if text else []
        best: dict[int, tuple[int, int, int, float]] = {}
        for length, (keys, table) in self.short.items():
            runs = self.shingles(words, length)
            at = np.flatnonzero(among(runs, keys))
            found, first = np.unique(runs[at], return_index=True)
            for key, place in zip(found.tolist(), at[first].tolist(), strict=True):
                best |= {i: (i, place, length, 1.0) for i in table[key]}
            if first_only and best:
                break
        if not (first_only and best) and len(words) >= _SHINGLE and len(self.members):
            self._match_windows(words, best, first_only)
        return [best[i] for i in sorted(best)]

    def _match_windows(self, words: list[str], best: dict[int, tuple[int, int, int, float]], first_only: bool) -> None:
        """Put the best window of each item of five words or more that matches into `best`."""
        h = self.shingles(words)
        maybe = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        known = maybe[among(h[maybe], self.members)]
        if not len(known):
            return
        sums = np.zeros(len(h) + 1, np.int32)
        sums[known + 1] = 1
        sums = np.cumsum(sums)
        for length in self.lengths:
            width = min(length, len(words)) - _SHINGLE + 1
            share = self.similarity / (1 + self.similarity)
            need = math.ceil(share * (width + length - _SHINGLE + 1) - 1e-9)
            starts = np.flatnonzero(sums[width:] - sums[:-width] >= need)
            for at, fp in zip(starts.tolist(), _simhashes(h, starts, width), strict=True):
                if some := self.candidates(length, fp):
                    here = bag(h[at : at + width])
                    for i in some:
                        s = bag_similarity(here, self.bags[i])
                        if s >= self.similarity and (i not in best or s > best[i][3]):
                            best[i] = (i, at, min(length, len(words)), s)
                            if first_only:
                                return


def _passes(benchmark: DataFrame, item_col: str, text_col: str, pass_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's distinct items (id, text, how often) in lists of bounded size, none empty but of an empty benchmark.

    Equal rows are one, so a hash deals the items evenly.
    """
    text = F.col(text_col).cast("string")
    rows = benchmark.where(text.isNotNull()).select(F.col(item_col).cast("long").alias("item"), text.alias("text"))
    items = kept(rows.groupBy("item", "text").agg(F.count("*").alias("times")), "items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // pass_bytes))
    found = 0
    for i in range(n):
        some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) if n > 1 else items
        got = [(r["item"], r["text"], r["times"]) for r in some.orderBy("item", "text").collect()]
        found += len(got)
        if got or (i == n - 1 and not found):
            yield got


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = 0.8,
    radius: int = 20,
    least_words: int = 1,
    pass_bytes: int = 8 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): the best window of each item in each document."""
    context = docs.sparkSession.sparkContext
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for items in _passes(benchmark, item_col, item_text_col, pass_bytes):
        sent = context.broadcast(items)

        def make(sent=sent):
            index = Index([((item, times), text) for item, text, times in sent.value], similarity, radius, least_words)

            def row(doc_id, text):
                for i, at, n, s in index.matches(text):
                    item, times = index.ids[i]
                    for _ in range(times):
                        yield doc_id, item, at, n, round(s, 6)

            return row

        found = map_rows(columns, make, "doc_id long, item_id long, first_word int, n_words int, similarity double")
        out = found if out is None else out.unionAll(found)
    return out


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = 0.8,
    radius: int = 20,
    least_words: int = 1,
    pass_bytes: int = 8 << 20,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The documents without any match, all columns."""
    context = docs.sparkSession.sparkContext
    for items in _passes(benchmark, item_col, item_text_col, pass_bytes):
        sent = context.broadcast(items)
        place = place_of(docs, text_col)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, place=place) -> Iterator[pa.RecordBatch]:
            index = Index([x[:2] for x in sent.value], similarity, radius, least_words)
            for batch in batches:
                keep = [not index.matches(x.as_py(), first_only=True) for x in batch.column(place)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
