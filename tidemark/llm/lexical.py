"""Ranked lexical search: the best documents for each item, by dense blocked matrix products.

Items come in passes of bounded bytes. In a pass, the items' distinct terms are its vocabulary, which is broadcast; one
scan of the documents counts those terms in every whole text and writes, for each document, its number of terms and the
counts. Corpus statistics (documents with a term, terms, documents by term) are aggregates of that table. A second scan
scores: a tile of documents becomes a dense matrix of impacts, vocabulary by documents, and is multiplied by the weights of
a tile of items, items by vocabulary, each tile of items having a compact vocabulary of its own. All factors are integers
in float64, and the vocabulary is cut so that no partial sum reaches 2^53: products are exact, and partial sums are added
as 64-bit integers.

A task keeps, for each item, its best k over its tiles: of a tile whatever reaches the k-th score so far, ties with it
included, so the order by score and id is exact. k rows an item and task are ranked in two steps, by a hash of the document
and then by item.

Score: the sum, over an item's distinct terms, of weight * ((10^9 tf) div (1000 tf + 8 m)), where the weight is
floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 10 + (90 n N) div L.

Defined cases: a null text, or one without a term, is no document (it doesn't count in N) and is never found; null and
empty items find nothing; rows of the benchmark with one id are one item with the terms of all (a null id is an item, too);
repeated documents are found as often as they are there; a null document id comes after all others of its score; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept, text_bytes

#: Bytes that end a term become spaces; A-Z become a-z; the bytes of all other characters stay.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_EXACT = 1 << 53
_MOST_IMPACT = 1_000_000
_ITEM_TILE, _DOC_TILE, _TERM_TILE = 256, 256, 4096
_BUCKETS = 64


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _passes(items: DataFrame, item_col: str, text_col: str, pass_bytes: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their distinct terms, in lists of at most `pass_bytes` bytes of terms or of one item."""
    rows = items.select(F.col(item_col).cast("long").alias("item"), text_bytes(F.col(text_col)).alias("text"))
    found: list[tuple[int | None, set[bytes]]] = []
    held = 0
    # One row at a time reaches the driver, in the order of the ids.
    for r in rows.distinct().orderBy("item", "text").toLocalIterator():
        some = set(terms(bytes(r["text"])))
        if found and found[-1][0] == r["item"]:
            some -= found[-1][1]
            found[-1][1].update(some)
        elif some:
            if found and held + sum(map(len, some)) > pass_bytes:
                yield [(i, sorted(x)) for i, x in found]
                found, held = [], 0
            found.append((r["item"], some))
        held += sum(map(len, some))
    if found:
        yield [(i, sorted(x)) for i, x in found]


_COUNTS = "doc_id long, n long, terms array<int>, counts array<int>"


def _count(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts) of each text with a term: its number of terms, and the counts of the vocabulary's."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(sent.value)}
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

        def pack() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "counts"])

        rows: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                counted = Counter(terms(batch.column(1)[i].as_py()))
                if not counted:
                    continue
                known = [(place[t], counted[t]) for t in counted.keys() & place.keys()]
                rows.append((batch.column(0)[i].as_py(), counted.total(), [x[0] for x in known], [x[1] for x in known]))
                if len(rows) == 5_000:
                    yield pack()
                    rows = []
        if rows:
            yield pack()

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(F.col(text_col)).alias("text"))
    return columns.mapInArrow(run, _COUNTS)


def weight(docs: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * having + 1)))


class Scorer:
    """Scores tiles of documents against items; items as lists of term places, weights by place."""

    def __init__(self, items: list[list[int]], weights: dict[int, int], docs: int, total: int, k: int):
        self.docs, self.total, self.k = docs, total, k
        most = max([1, *weights.values()])
        width = min(_TERM_TILE, max(1, (_EXACT - 1) // (most * _MOST_IMPACT)))
        #: For each tile of items: its first item, how many, and (vocabulary's places, weights) by tile of terms.
        self.tiles = []
        for first in range(0, len(items), _ITEM_TILE):
            some = items[first : first + _ITEM_TILE]
            own = sorted({t for item in some for t in item if weights.get(t)})
            parts = []
            for a in range(0, len(own), width):
                part = np.array(own[a : a + width])
                at = {t: i for i, t in enumerate(part.tolist())}
                matrix = np.zeros((len(some), len(part)))
                for i, item in enumerate(some):
                    for t in item:
                        if t in at:
                            matrix[i, at[t]] = weights[t]
                parts.append((part, matrix))
            self.tiles.append((first, len(some), parts))
        self.best = np.zeros((0, 4), np.int64)  # item, score, whether the document's id is null, that id
        self.least = np.ones(len(items), np.int64)

    def add(self, ids: np.ndarray, no_id: np.ndarray, n: np.ndarray, sizes: np.ndarray, places: np.ndarray, counts: np.ndarray) -> None:
        """A tile of documents: `sizes` terms of the vocabulary each, with their places and counts one after another."""
        # Python's integers, so that a long text in a large corpus can't overflow.
        m = np.array([10 + 90 * x * self.docs // self.total for x in n.tolist()], np.int64)
        doc = np.repeat(np.arange(len(ids)), sizes)
        counts = counts.astype(np.int64)
        impact = (1_000_000_000 * counts) // (1000 * counts + 8 * m[doc])
        order = np.argsort(places, kind="stable")
        sorted_places = places[order]
        for first, many, parts in self.tiles:
            scores = np.zeros((many, len(ids)), np.int64)
            for part, matrix in parts:
                where = np.minimum(np.searchsorted(part, sorted_places), len(part) - 1)
                some = np.flatnonzero(part[where] == sorted_places)
                dense = np.zeros((len(part), len(ids)))
                dense[where[some], doc[order[some]]] = impact[order[some]]
                scores += (matrix @ dense).astype(np.int64)
            self._keep(first, scores, ids, no_id)

    def _keep(self, first: int, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        least = self.least[first : first + len(scores)]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        item, doc = np.nonzero(scores >= least[:, None])
        if not len(item):
            return
        new = np.stack((item + first, scores[item, doc], no_id[doc].astype(np.int64), ids[doc]), 1)
        rows = np.concatenate((self.best, new))
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        begins = np.searchsorted(rows[:, 0], rows[:, 0])
        rank = np.arange(len(rows)) - begins
        self.best = rows[rank < self.k]
        last = rows[rank == self.k - 1]
        self.least[last[:, 0]] = last[:, 1]


_FOUND = "item int, doc_id long, score long"


def _score(counted: DataFrame, items: list[list[int]], weights: dict[int, int], docs: int, total: int, k: int) -> DataFrame:
    """Each task's best k documents of each item."""
    sent = counted.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value, docs, total, k)
        for batch in batches:
            for at in range(0, batch.num_rows, _DOC_TILE):
                ids, n, places, counts = batch.slice(at, _DOC_TILE).columns
                sizes = np.diff(places.offsets.to_numpy())
                scorer.add(
                    ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), n.to_numpy(), sizes,
                    places.flatten().to_numpy(), counts.flatten().to_numpy(),
                )
        item, score, no_id, ids = scorer.best.T
        ids = pa.array(ids, mask=no_id.astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), ids, pa.array(score)], names=["item", "doc_id", "score"])

    return counted.mapInArrow(run, _FOUND)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    pass_bytes: int = 8 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for some in _passes(items, item_col, item_text_col, pass_bytes):
        vocabulary = sorted({t for _, own in some for t in own})
        place = {t: i for i, t in enumerate(vocabulary)}
        counted = kept(_count(docs, vocabulary, id_col, text_col), "counted")
        n, total = counted.agg(F.count("*"), F.sum("n")).first()
        if not n:
            break
        having = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weights = {r["term"]: weight(n, r["count"]) for r in having}
        found = _score(counted, [[place[t] for t in own] for _, own in some], weights, n, total, k)
        found = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(_BUCKETS)))
        found = _first(_first(found, ["item", "bucket"], k), ["item"], k)
        names = spark.createDataFrame([(j, i) for j, (i, _) in enumerate(some)], "item int, item_id long")
        result = result.unionAll(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return result
