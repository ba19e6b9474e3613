"""Language-model scores: a causal self-attention model over subword ids, trained here, and a word-count baseline.

1. *Blocks.* One scan turns the documents into blocks of a few megabytes of text: the distinct lower-cased words of the
   block with their subword ids and how often its training documents have them, and the documents as places in that list.
2. *Counts.* Each block's words meet in buckets by their hash, are summed over all training documents, and come back as arrays.
   What is shuffled is each word of a block once, not each word of a text, and a row for each block and bucket.
3. *Model.* Token embedding plus place, one causal attention, a softmax over groups of classes of ids and one over the classes
   of a group, which are alike in the classes beside them; an id's share of its class comes from counts of all training
   documents, by the class before it. The commonest ids are classes of their own, others are clustered by their
   neighbours, counted over all training documents too.
4. *Training.* Training documents are cut into windows of `context` ids from end to end, and all are learnt from: every id is a
   target once a round. A start is fitted on the driver from a bounded sample (`seed_windows` windows); then, for `rounds`
   rounds, each task goes on from the shared weights over all windows it has, and the changes are averaged.
5. *Scoring.* Windows of `context` ids overlap. A window scores only the ids that no window before scored, so each is
   scored once, with at least `context - step` ids before it where the text has them; many windows are one batch of masked
   matrix products.

`score` is the log10 probability of the text's subword ids and one end; words are lower-cased and white space is not scored.

Defined cases: a null or empty text is its end alone; a null id is held out; without training documents all counts are 0 and
the model is uniform; each row gives a row, repeated ones too; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import copy
import functools
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, text_bytes

_BLOCK_BYTES = 8 << 20
_BLOCK_ROWS = 20_000
_HASHES = 1 << 30
_BUCKET_WORDS = 500_000
# Words that a worker remembers, 20 MB or so.
_REMEMBERED = 400_000
# Logits of base 2 are cut above this.
_LOG2_E, _MOST = float(np.log2(np.e)), np.float32(86)


@dataclass(frozen=True)
class Shape:
    """Sizes of the model and its training."""

    width: int = 16
    context: int = 48
    step: int = 40
    single: int = 96
    clusters: int = 32
    #: Classes of a group, at most.
    group: int = 32
    #: Turns in which a text's windows are learnt, neighbours in different ones; none is left out.
    train_every: int = 32
    seed_windows: int = 4096
    seed_steps: int = 800
    rounds: int = 1
    batch: int = 64

    @property
    def classes(self) -> int:
        return self.single + self.clusters


class Pieces:
    """Subword ids of words by a SentencePiece model; the id after its last one marks where texts begin and end."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = self.model.get_piece_size()

        #: Words that were encoded before, their pieces one after another, and how many each has.
        self.known, self.pieces, self.sizes = pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def of(self, words: list[bytes]) -> list[list[int]]:
        return [x or [0] for x in self.model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)]

    def of_distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of distinct words, one after another, and how many each has; the first `_REMEMBERED` are kept."""
        at = pc.index_in(words, value_set=self.known)
        unknown = at.is_null()
        new = words.filter(unknown)
        by_word = self.of(new.to_pylist())
        sizes = np.append(self.sizes, np.fromiter(map(len, by_word), np.int64, len(by_word)))
        pieces = np.append(self.pieces, np.fromiter(chain.from_iterable(by_word), np.int32))
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[unknown.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
        out = _spread(place, pieces, sizes)
        if len(self.known) < _REMEMBERED:
            self.known = pa.concat_arrays([self.known, new])[:_REMEMBERED]
            self.sizes = sizes[:_REMEMBERED]
            self.pieces = pieces[: self.sizes.sum()]
        return out


@functools.cache
def _pieces(path: str) -> Pieces:
    """One for each worker, which goes on with the words that it knows."""
    return Pieces(path)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


# Blocks


_BLOCKS = {
    "block": pa.int64(),
    "doc_ids": pa.list_(pa.int64()),
    "sizes": pa.list_(pa.int64()),
    "places": pa.binary(),
    "words": pa.binary(),
    "counts": pa.binary(),
    "learnt": pa.int64(),
    "pieces": pa.binary(),
    "piece_sizes": pa.list_(pa.int32()),
    "ids": pa.list_(pa.int32()),
    "id_counts": pa.list_(pa.int64()),
    "windows": pa.int64(),
}
_BLOCKS_SQL = (
    "block long, doc_ids array<long>, sizes array<long>, places binary, words binary, counts binary, learnt long, "
    "pieces binary, piece_sizes array<int>, ids array<int>, id_counts array<long>, windows long"
)


#: The columns that hold the texts.
_TEXTS = ("doc_ids", "sizes", "places", "pieces", "piece_sizes")


def _squeeze(values: np.ndarray) -> bytes:
    """32-bit integers, compressed with all first bytes first: small numbers take little room, also in a shuffle."""
    planes = np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def _spring(held: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(held, 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)


def _spread(places: np.ndarray, pieces: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of a sequence of words, and how many each word has."""
    begins = np.cumsum(sizes) - sizes
    own = sizes[places]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(begins[places] - ends + own, own)
    at += np.arange(total)
    return pieces.take(at), own


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many words each text has, with a mark before it; their places; the distinct words, in order of first use.

    Place 0 is the mark, which is empty.
    """
    data = np.frombuffer(b"".join([b"\n", *(x for text in texts for x in (text, b"\n"))]).lower(), np.uint8)
    space = ((data - 9) < 5) | (data == 32)
    edges = np.flatnonzero(space[1:] != space[:-1])
    begins, lengths = edges[::2], edges[1::2] - edges[::2]
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])])
    coded = packed.dictionary_encode()
    ends = np.cumsum([len(text) + 1 for text in texts])
    sizes = np.diff(np.searchsorted(begins, ends), prepend=0) + 1
    places = np.zeros(int(sizes.sum()), np.int64)
    word = np.ones(len(places), bool)
    word[np.cumsum(sizes) - sizes] = False
    places[word] = coded.indices.to_numpy() + 1
    return sizes, places, pa.concat_arrays([pa.array([b""]), coded.dictionary])


def _lines(words: pa.Array, bounds: np.ndarray) -> pa.Array:
    """Words that have no line breaks, as lines: a binary between each two bounds."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), words), b"\n")


def _block(key: int, rows: list[tuple[int | None, bytes]], encode: Pieces, shape: Shape) -> tuple:
    """One block: place 0 of its words is the mark before each text (and so after the one before)."""
    sizes, places, words = _words([text for _, text in rows])
    learnt = np.array([not is_held_out(doc_id) for doc_id, _ in rows])
    pieces, piece_sizes = encode.of_distinct(words[1:])
    pieces, piece_sizes = np.append(encode.end, pieces), np.append(1, piece_sizes)
    counts = np.bincount(places[np.repeat(learnt, sizes)], minlength=len(words))
    ids = np.bincount(pieces, np.repeat(counts, piece_sizes), minlength=encode.end + 1).astype(np.int64)
    some = np.flatnonzero(ids)
    own = np.add.reduceat(piece_sizes[places], np.cumsum(sizes) - sizes)
    lines = _lines(words, np.array([0, len(words)]))[0].as_py()
    return (
        key, [d for d, _ in rows], sizes, _squeeze(places), lines, counts.astype(np.int64).tobytes(), int(counts.sum()), _squeeze(pieces),
        piece_sizes.astype(np.int32), some.astype(np.int32), ids[some], int((-(-own[learnt] // shape.context)).sum()),
    )


def _opened(doc_ids, sizes, places, pieces, piece_sizes) -> tuple:
    """A block's columns as arrays."""
    sizes, piece_sizes = sizes.values.to_numpy(), piece_sizes.values.to_numpy().astype(np.int64)
    places, pieces = _spring(places.as_py(), int(sizes.sum())), _spring(pieces.as_py(), int(piece_sizes.sum()))
    return doc_ids.values, sizes, places, pieces, piece_sizes


def _learnt(doc_ids, sizes, places, pieces, piece_sizes) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of a block's training documents and a mark, and where each document ends: at the next one's mark."""
    learnt = np.array([not is_held_out(x) for x in doc_ids.to_pylist()], bool)
    sequence, each = _spread(places[np.repeat(learnt, sizes)], pieces, piece_sizes)
    return np.append(sequence, pieces[0]), np.cumsum(each)[np.cumsum(sizes[learnt]) - 1]


def _compact(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pieces, and each one's place in them."""
    ids = np.flatnonzero(np.bincount(pieces))
    place = np.zeros(ids[-1] + 1, np.int64)
    place[ids] = np.arange(len(ids))
    return ids, place[pieces]


def window_bounds(ends: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin, and where their texts end: without gaps, so that every id is a target in just one of them."""
    lengths = np.diff(ends, prepend=0)
    many = -(-lengths // shape.context)
    text = np.repeat(np.arange(len(ends)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    order = np.argsort(nth % shape.train_every, kind="stable")
    return ((ends - lengths)[text] + nth * shape.context)[order], ends[text][order]


def cut_windows(sequence: np.ndarray, begins: np.ndarray, ends: np.ndarray, shape: Shape) -> np.ndarray:
    """A row for each window: its ids, the one to come, -1 behind the mark at its text's end."""
    where = begins[:, None] + np.arange(shape.context + 1)
    out = sequence.take(where, mode="clip")
    out[where > ends[:, None]] = -1
    return out


def _blocks(docs: DataFrame, model_path: str, shape: Shape, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _pieces(model_path)
        key = TaskContext.get().partitionId() << 32
        rows: list[tuple[int | None, bytes]] = []
        held = 0

        def pack() -> pa.RecordBatch:
            values = _block(key, rows, encode, shape)
            columns = [pa.array([v], kind) for v, kind in zip(values, _BLOCKS.values(), strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=list(_BLOCKS))

        for batch in batches:
            for i in range(batch.num_rows):
                rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
                held += len(rows[-1][1])
                if held >= _BLOCK_BYTES or len(rows) >= _BLOCK_ROWS:
                    yield pack()
                    rows, held, key = [], 0, key + 1
        if rows:
            yield pack()

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(F.col(text_col)).alias("text"))
    return kept(columns.mapInArrow(run, _BLOCKS_SQL), "blocks")


# Counts


def _counted(blocks: DataFrame) -> DataFrame:
    """For each block and some of its words (`at`): how often all training documents have them (`n`, 64-bit integers).

    Words meet in buckets of about `_BUCKET_WORDS` by their hash; `distinct` is how many a bucket has that are learnt.
    """
    buckets = 1 + (blocks.agg(F.sum(F.size("piece_sizes"))).first()[0] or 0) // _BUCKET_WORDS

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lines, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = lines.split(b"\n")
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
                at = np.argsort(bucket, kind="stable").astype(np.int32)
                some, begins = np.unique(bucket[at], return_index=True)
                bounds = np.append(begins, len(words))
                held = np.frombuffer(counts, np.int64)[at]
                columns = [
                    pa.array(some), pa.array(np.full(len(some), block)), _lines(pa.array(words, pa.binary()).take(pa.array(at)), bounds),
                    *(pa.array([x[a:b].tobytes() for a, b in itertools.pairwise(bounds)], pa.binary()) for x in (at, held)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "words", "at", "counts"])

    def meet(rows: pa.Table) -> pa.Table:
        lists = [x.as_py().split(b"\n") for x in rows["words"]]
        coded = pa.array(chain.from_iterable(lists), pa.binary()).dictionary_encode().indices.to_numpy()
        total = np.zeros(int(coded.max()) + 1, np.int64)
        np.add.at(total, coded, np.frombuffer(b"".join(rows["counts"].to_pylist()), np.int64))
        bounds = np.append(0, np.cumsum([len(x) for x in lists]))
        n = [total[coded[a:b]].tobytes() for a, b in itertools.pairwise(bounds)]
        distinct = [int((total > 0).sum()), *([0] * (len(n) - 1))]
        return pa.table({"block": rows["block"], "at": rows["at"], "n": pa.array(n, pa.binary()), "distinct": pa.array(distinct)})

    cells = blocks.select("block", "words", "counts").mapInArrow(split, "bucket long, block long, words binary, at binary, counts binary")
    # A task for each bucket or so, whatever its bytes.
    cells = cells.repartition(buckets, "bucket")
    return kept(cells.groupBy("bucket").applyInArrow(meet, "block long, at binary, n binary, distinct long"), "words")


# Model


def commonest(counts: np.ndarray, shape: Shape) -> np.ndarray:
    """A class for each of the commonest ids, `single` for the others."""
    order = np.lexsort((np.arange(len(counts)), -counts))[: shape.single]
    out = np.full(len(counts), shape.single, np.int64)
    out[order] = np.arange(len(order))
    return out


def neighbours(sequence: np.ndarray, of: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often ids without a class of their own have each class before them, and (behind those columns) after them."""
    n = shape.single + 1
    of = of[sequence]
    left, right = np.flatnonzero(of[1:] == shape.single), np.flatnonzero(of[:-1] == shape.single)
    keys = np.concatenate((sequence[left + 1] * (2 * n) + of[left], sequence[right] * (2 * n) + n + of[right + 1]))
    found = np.bincount(keys, minlength=1)
    key = np.flatnonzero(found)
    return key // (2 * n), key % (2 * n), found[key]


def classes_of(counts: np.ndarray, windows: np.ndarray, shape: Shape) -> np.ndarray:
    """The classes of ids by the neighbours they have in windows."""
    of = commonest(counts, shape)
    beside = np.zeros((len(counts), 2 * (shape.single + 1)))
    for x in windows:
        at, column, n = neighbours(x[x >= 0], of, shape)
        beside[at, column] += n
    return cluster(counts, beside, shape)


def cluster(counts: np.ndarray, beside: np.ndarray, shape: Shape) -> np.ndarray:
    """A class for each id: the commonest have one of their own, others are clustered by the ids beside them."""
    out = commonest(counts, shape)
    rest = np.lexsort((np.arange(len(counts)), -counts))[shape.single :]
    seen = rest[(beside[rest].sum(axis=1) > 0)]
    if not len(seen):
        return out
    x = np.sqrt(beside[seen] / beside[seen].sum(axis=1, keepdims=True))
    weights = counts[seen].astype(float) + 1
    centres = x[: shape.clusters].copy()
    for _ in range(12):
        own = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = np.average(x[own == c], axis=0, weights=weights[own == c])
    out[seen] = shape.single + own
    return out


def groups_of(pairs: np.ndarray, classes: np.ndarray, shape: Shape) -> np.ndarray:
    """A group for each class, of `group` classes at most: halves along what tells their neighbours apart most.

    `pairs` are rows (id, class before, count) over all training documents.
    """
    n, of = shape.classes, classes[pairs[:, 0]]
    beside = np.zeros((n, 2 * n))
    np.add.at(beside, (of, pairs[:, 1]), pairs[:, 2])
    np.add.at(beside, (pairs[:, 1], n + of), pairs[:, 2])
    x = np.sqrt(beside / np.maximum(1, beside.sum(axis=1, keepdims=True)))
    parts = [np.arange(n)]
    while len(parts[0]) > shape.group:
        halves = []
        for part in parts:
            y = x[part] - x[part].mean(axis=0)
            order = np.argsort(y @ np.linalg.svd(y, full_matrices=False)[2][0], kind="stable")
            halves += [np.sort(part[order[: -(-len(part) // 2)]]), np.sort(part[order[-(-len(part) // 2) :]])]
        parts = halves
    out = np.zeros(n, np.int64)
    for i, part in enumerate(parts):
        out[part] = i
    return out


def _sums_by_id(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids, and the sums of their rows."""
    # Integers of 16 bits are sorted by their digits.
    order = np.argsort(ids.astype(np.uint16) if ids.max() < 1 << 16 else ids, kind="stable")
    ids = ids[order]
    at = np.flatnonzero(np.diff(ids, prepend=-1))
    return ids[at], np.add.reduceat(rows.take(order, axis=0), at, axis=0)


def _exp2(x: np.ndarray) -> None:
    if x.size and x.max() > _MOST:
        np.minimum(x, _MOST, out=x)
    np.exp2(x, out=x)


class Model:
    """Embedding, one causal attention, groups of classes, classes of groups, shares of classes.

    Weights are float32, named in `w`. As the attention has one head as wide as the embedding, queries meet keys by one
    matrix, the product of theirs, and values meet the output by another: keys and values are the embeddings themselves.
    """

    def __init__(self, counts: np.ndarray, classes: np.ndarray, shape: Shape, seed: int = 5, groups: np.ndarray | None = None):
        self.shape, self.classes = shape, classes
        self.group = np.arange(shape.classes) // shape.group if groups is None else groups
        rng = np.random.default_rng(seed)
        d, n, self.groups = shape.width, len(counts), int(self.group.max()) + 1

        def normal(*size: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(size) * scale).astype(np.float32)

        order = np.argsort(self.group, kind="stable")
        #: Columns of the head: those of groups are first, then those of each group's classes.
        self.ends = (self.groups + np.append(0, np.cumsum(np.bincount(self.group)))).tolist()
        place = np.empty(shape.classes, np.int64)
        place[order] = self.groups + np.arange(shape.classes)
        place += self.groups - np.array(self.ends)[self.group]
        #: An id's group, and its class's place behind the groups' columns; the last is for id -1, which has none.
        self.in_group = np.append(self.group[classes], self.groups).astype(np.min_scalar_type(self.groups))
        self.in_columns = np.append(place[classes], 0)
        #: For each group, two columns, whose products are the sums over groups and over the group's classes.
        sizes = np.diff(self.ends)
        self.sides = [np.repeat(np.eye(2, dtype=np.float32), (self.groups, size), axis=0) for size in sizes]
        members = np.bincount(classes, minlength=shape.classes)
        by_class = np.bincount(classes, counts, minlength=shape.classes) + 1
        by_group = np.bincount(self.group, by_class)
        self.unused = np.append(np.bincount(self.group, members) == 0, members[order] == 0)
        self.w = {
            "tokens": normal(n, d, scale=0.3), "places": normal(shape.context, d, scale=0.1),
            "qkv": normal(d, 3 * d, scale=d**-0.5), "out": normal(d, d, scale=d**-0.5),
            # The last row is the bias; a class or group without ids gets no probability.
            "head": np.concatenate((normal(d, self.groups + shape.classes, scale=d**-0.5), np.zeros((1, self.groups + shape.classes), np.float32))),
        }
        self.w["head"][-1] = np.log(np.append(by_group / by_group.sum(), (by_class / by_group[self.group])[order]))
        self._close()
        self.mask = np.tril(np.ones((shape.context, shape.context), np.float32))
        self.moments: dict[str, list] = {}
        self.held: dict[str, np.ndarray] = {}
        self.steps = 0
        self.set_shares(counts, np.zeros((0, 3), np.int64))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": {}}

    def _close(self) -> None:
        self.w["head"][:, self.unused] = 0
        self.w["head"][-1, self.unused] = -80

    def set_shares(self, counts: np.ndarray, pairs: np.ndarray, kappa: float = 5) -> None:
        """An id's share of its class, by the class before: rows (id, class before, count), smoothed by its share of all."""
        by_class = np.bincount(self.classes, counts, minlength=self.shape.classes)
        members = np.bincount(self.classes, minlength=self.shape.classes)
        plain = (counts + 1) / (by_class + members)[self.classes]
        ids = np.unique(pairs[:, 0])
        #: Row of the table of an id; 0 for ids without pairs.
        self.row = np.zeros(len(counts), np.int32)
        self.row[ids] = 1 + np.arange(len(ids))
        found = np.zeros((len(ids) + 1, self.shape.classes))
        found[self.row[pairs[:, 0]], pairs[:, 1]] = pairs[:, 2]
        before = np.zeros((self.shape.classes, self.shape.classes))
        np.add.at(before, (self.classes[pairs[:, 0]], pairs[:, 1]), pairs[:, 2])
        self.kappa_share = np.log10(kappa * plain)
        own = np.concatenate(([0.0], plain[ids]))[:, None]
        #: log10 of (pairs of its class + kappa), by the class before, and of an id's (pairs + kappa * its share) by that.
        self.before = np.log10(before + kappa)
        self.pairs = np.log10(found + kappa * own + 1e-300)
        self.pairs[1:] -= self.before[self.classes[ids]]
        self.pairs = self.pairs.astype(np.float32)

    def share(self, last: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 of the target's share of its class after the id `last`."""
        row, before = self.row[target], self.classes[last]
        out = self.pairs[row, before]
        new = np.flatnonzero(row == 0)
        if len(new):
            out[new] = self.kappa_share[target[new]] - self.before[self.classes[target[new]], before[new]]
        return out

    def _room(self, name: str, kind: type, *size: int) -> np.ndarray:
        """An array that is used again by the next call of the same size; it is of ones at first."""
        held = self.held.get(name)
        if held is None or held.shape != size or held.dtype != kind:
            held = self.held[name] = np.ones(size, kind)
        return held

    def _attend(self, ids: np.ndarray, first: int) -> tuple[np.ndarray, ...]:
        """What the places from `first` on see: embeddings x, the same on end with a row of ones, x times the matrix of
        queries and keys, powers (not divided by their sums), one by their sums, the mean embedding, and states of the
        head, whose last column is one, for the bias. Logits are of base 2, as that is faster.
        """
        w, d, t = self.w, self.shape.width, self.shape.context
        kind, n, m = w["head"].dtype.type, len(ids), t - first
        x = self._room("x", kind, n, t, d)
        np.take(w["tokens"], ids, axis=0, out=x, mode="clip")
        x += w["places"]
        on_end = self._room("on end", kind, n, d + 1, t)
        on_end[:, :d] = x.transpose(0, 2, 1)
        own = x.reshape(-1, d) if not first else x[:, first:].reshape(-1, d)
        meet = (w["qkv"][:, :d] @ w["qkv"][:, d : 2 * d].T) * kind(_LOG2_E * d**-0.5)
        g = np.matmul(own, meet, out=self._room("g", kind, n * m, d)).reshape(n, m, d)
        # The second half of each window's rows is for the gradients of the first.
        a = self._room("a", kind, n, 2 * m, t)[:, :m]
        np.matmul(g, on_end[:, :d], out=a)
        _exp2(a)
        a *= self.mask[first:]
        part = 1 / (a @ np.ones(t, kind) + kind(1e-30))[:, :, None]
        y = np.matmul(a, x, out=self._room("y", kind, n, m, d))
        y *= part
        h = self._room("h", kind, n * m, d + 1)
        np.add(own, y.reshape(-1, d) @ (w["qkv"][:, 2 * d :] @ w["out"]), out=h[:, :d])
        return x, on_end, g, a, part, y, h

    def _head(self, j: int) -> np.ndarray:
        """The columns of groups, and those of the classes of one."""
        return np.concatenate((self.w["head"][:, : self.groups], self.w["head"][:, self.ends[j] : self.ends[j + 1]]), axis=1)

    def _by_group(self, ids: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
        """An order of ids by group, with those of -1 left out, where groups end (from 0), and the classes' columns."""
        group = self.in_group[ids]
        order = np.argsort(group, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(group, minlength=self.groups)[: self.groups])).tolist()
        order = order[: ends[-1]]
        return order, ends, self.in_columns[ids[order]]

    def ready(self) -> None:
        """Weights for `log10`: for each group, what gives its logits of base 2."""
        self.heads = [self._head(j) * np.float32(_LOG2_E) for j in range(self.groups)]

    def log10(self, ids: np.ndarray, targets: np.ndarray, first: int) -> np.ndarray:
        """log10 probabilities of targets (windows x places from `first` on) after the ids of their windows."""
        h = self._attend(ids, first)[-1]
        flat, last = targets.ravel(), ids[:, first:].ravel()
        order, ends, at = self._by_group(flat)
        h = h.take(order, axis=0)
        likely, whole = np.empty((len(h), 2)), np.empty((len(h), 2))
        for j in range(self.groups):
            some = slice(ends[j], ends[j + 1])
            p = h[some] @ self.heads[j]
            _exp2(p)
            np.matmul(p, self.sides[j], out=whole[some])
            likely[some, 0] = p[:, j]
            likely[some, 1] = p.ravel()[np.arange(0, p.size, p.shape[1]) + at[some]]
        likely /= whole
        out = np.empty(len(h))
        out[order] = np.log10(likely[:, 0] * likely[:, 1] + 1e-300)
        return (out + self.share(last, flat)).reshape(targets.shape)

    def gradients(self, windows: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, float]:
        """Gradients of the mean loss: of the dense weights, of the ids of `touched`; and the loss."""
        w, d, t = self.w, self.shape.width, self.shape.context
        kind = w["head"].dtype.type
        ids, targets = np.maximum(windows[:, :-1], 0), windows[:, 1:].ravel()
        n = len(windows)
        x, on_end, g, a, per, y, h = self._attend(ids, 0)
        order, ends, at = self._by_group(targets)
        count = kind(max(1, len(order)))
        some = h.take(order, axis=0)
        out = {"head": np.zeros_like(w["head"])}
        back, likely = self._room("back", kind, n * t, d), np.empty((len(order), 2))
        back[len(order) :] = 0
        for j in range(self.groups):
            i, e, head, sides = ends[j], ends[j + 1], self._head(j), self.sides[j]
            p = some[i:e] @ (head * kind(_LOG2_E))
            _exp2(p)
            p *= (1 / (p @ sides)) @ sides.T
            flat, own = p.ravel(), np.arange(0, p.size, p.shape[1]) + at[i:e]
            likely[i:e, 0], likely[i:e, 1] = p[:, j], flat[own]
            p[:, j] -= 1
            flat[own] -= 1
            part = some[i:e].T @ p
            out["head"][:, : self.groups] += part[:, : self.groups]
            out["head"][:, self.ends[j] : self.ends[j + 1]] = part[:, self.groups :]
            np.matmul(p, head[:d].T, out=back[i:e])
        out["head"] /= count
        back /= count
        where = np.full(n * t, n * t - 1)
        where[order] = np.arange(len(order))
        dh = back.take(where, axis=0)
        queries, keys, values = w["qkv"][:, :d], w["qkv"][:, d : 2 * d], w["qkv"][:, 2 * d :]
        outer = y.reshape(-1, d).T @ dh
        out["out"] = values.T @ outer
        # Below the gradients of y are the queries' products, so that one product sums over both of a place's parts.
        both = self._room("both", kind, n, 2 * t, d + 1)
        dy = both[:, :t]
        np.multiply(np.matmul(dh, (values @ w["out"]).T, out=back).reshape(n, t, d), per, out=dy[:, :, :d])
        np.negative((dy[:, :, :d] * y) @ np.ones(d, kind), out=dy[:, :, d])
        np.multiply(g, kind(1 / _LOG2_E), out=both[:, t:, :d])
        parts = self._room("a", kind, n, 2 * t, t)
        da = parts[:, t:]
        np.matmul(dy, on_end, out=da)
        da *= a
        dg = np.matmul(da, x, out=self._room("dg", kind, n, t, d)).reshape(-1, d)
        flat, scale = x.reshape(-1, d), kind(d**-0.5)
        meet = (flat.T @ dg) * scale
        out["qkv"] = np.concatenate((meet @ keys, meet.T @ queries, outer @ w["out"].T), axis=1)
        dx = np.matmul(parts.transpose(0, 2, 1), both[:, :, :d], out=self._room("dx", kind, n, t, d)).reshape(-1, d)
        dx += dh
        dx += dg @ ((keys @ queries.T) * scale)
        out["places"] = dx.reshape(n, t, d).sum(axis=0)
        touched, rows = _sums_by_id(ids.ravel(), dx)
        return out, touched, rows, -float(np.log(likely + 1e-30).sum()) / float(count)

    def learn(self, windows: np.ndarray, rate: float) -> float:
        """One step: Adam for dense weights, Adagrad for the embeddings of the ids at hand."""
        dense, touched, rows, loss = self.gradients(windows)
        self.steps += 1
        # All dense weights are one row.
        g = np.concatenate([x.ravel() for x in dense.values()])
        if "dense" not in self.moments:
            self.moments["dense"] = [np.zeros_like(g), np.zeros_like(g)]
        m = self.moments["dense"]
        m[0] += np.float32(0.1) * (g - m[0])
        m[1] += np.float32(0.005) * (g * g - m[1])
        up, down = 1 - 0.9**self.steps, 1 - 0.995**self.steps
        g = (rate * (m[0] / up) / (np.sqrt(m[1] / down) + 1e-8)).astype(np.float32)
        at = 0
        for name, x in dense.items():
            self.w[name] -= g[at : at + x.size].reshape(x.shape)
            at += x.size
        if "tokens" not in self.moments:
            self.moments["tokens"] = [np.full(len(self.w["tokens"]), 1e-8, np.float32)]
        seen = self.moments["tokens"][0]
        now = seen.take(touched) + (rows * rows).mean(axis=1)
        seen[touched] = now
        rows *= (np.float32(10 * rate) / np.sqrt(now))[:, None]
        self.w["tokens"][touched] = self.w["tokens"].take(touched, axis=0) - rows
        self._close()
        return loss

    def rows(self) -> np.ndarray:
        """All weights as rows of `width`: first the embeddings, then the others, padded."""
        rest = np.concatenate([self.w[k].ravel() for k in sorted(self.w) if k != "tokens"])
        rest = np.append(rest, np.zeros(-len(rest) % self.shape.width, np.float32))
        return np.concatenate((self.w["tokens"], rest.reshape(-1, self.shape.width)))

    def set_rows(self, rows: np.ndarray) -> None:
        n = len(self.w["tokens"])
        self.w["tokens"] = rows[:n].astype(np.float32)
        rest, at = rows[n:].ravel(), 0
        for k in sorted(self.w):
            if k != "tokens":
                size = self.w[k].size
                self.w[k] = rest[at : at + size].reshape(self.w[k].shape).astype(np.float32)
                at += size


def fit_start(model: Model, windows: np.ndarray, rate: float = 0.01) -> None:
    """Steps over the bounded sample, in an order of their own, with a falling rate."""
    shape = model.shape
    if not len(windows):
        return
    rng = np.random.default_rng(7)
    for i in range(shape.seed_steps):
        some = rng.integers(0, len(windows), shape.batch)
        model.learn(windows[some], rate * (1 - i / shape.seed_steps) + 1e-3)


def _round(blocks: DataFrame, model: Model, rate: float) -> None:
    """Every task learns from all its windows; the weighted mean of the changes is the shared weights' change."""
    spark, shape = blocks.sparkSession, model.shape
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = copy.copy(sent.value)
        start = own.rows()
        own.w, own.moments, own.steps = {k: v.copy() for k, v in own.w.items()}, {}, 0
        used = np.zeros(len(start))
        held = np.zeros((0, shape.context + 1), np.int64)
        tokens = len(own.w["tokens"])

        def step(windows: np.ndarray) -> None:
            own.learn(windows, rate)
            seen = windows[windows >= 0]
            np.add.at(used, seen, 1.0)
            used[tokens:] += len(seen)

        for batch in batches:
            for i in range(batch.num_rows):
                sequence, ends = _learnt(*_opened(*(c[i] for c in batch.columns)))
                begins, ends = window_bounds(ends, shape)
                for j in range(0, len(begins), shape.batch):
                    held = np.concatenate((held, cut_windows(sequence, begins[j : j + shape.batch], ends[j : j + shape.batch], shape)))
                    if len(held) >= shape.batch:
                        step(held[: shape.batch])
                        held = held[shape.batch :]
        if len(held):
            step(held)
        change = (own.rows() - start) * used[:, None]
        some = np.flatnonzero(used)
        columns = [pa.array(some.astype(np.int32)), pa.array(used[some]), *(pa.array(c) for c in change[some].T)]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "used", *(f"c{i}" for i in range(shape.width))])

    schema = "at int, used double, " + ", ".join(f"c{i} double" for i in range(shape.width))
    changes = blocks.where("windows > 0").select(*_TEXTS).mapInArrow(run, schema)
    mean = [(F.sum(f"c{i}") / F.sum("used")).alias(f"c{i}") for i in range(shape.width)]
    rows = model.rows().astype(np.float64)
    # One row for each id of the vocabulary and each row of the other weights.
    for r in changes.groupBy("at").agg(*mean).collect():
        rows[r["at"]] += r[1:]
    model.set_rows(rows)


def _pairs(blocks: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """Rows (id, class of the id before, count) over all training documents: vocabulary times classes at most."""
    sent = blocks.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, sizes, places, pieces, piece_sizes = _opened(*(c[i] for c in batch.columns))
                learnt = np.array([not is_held_out(x) for x in doc_ids.to_pylist()], bool)
                if not learnt.any():
                    continue
                some = places[np.repeat(learnt, sizes)]
                ids, compact = _compact(pieces)
                flat, _ = _spread(some, compact, piece_sizes)
                flat = np.append(flat, compact[0])  # the mark behind the last text
                found = np.bincount(flat[1:] * n_classes + of[ids][flat[:-1]], minlength=1)
                key = np.flatnonzero(found)
                columns = [pa.array(x) for x in (ids[key // n_classes].astype(np.int32), (key % n_classes).astype(np.int32), found[key])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "before", "n"])

    columns = blocks.where("windows > 0").select(*_TEXTS)
    found = columns.mapInArrow(run, "id int, before int, n long").groupBy("id", "before").agg(F.sum("n").alias("n")).toArrow()
    return np.stack([found[c].to_numpy().astype(np.int64) for c in ("id", "before", "n")], 1)


def _start(blocks: DataFrame, of: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours of ids over all training documents, and the windows of the start: those of the least numbers drawn."""
    width, columns = shape.context + 1, 2 * (shape.single + 1)
    total = blocks.agg(F.sum("windows")).first()[0] or 0
    # By a bound on the numbers: tasks send what is taken, not their own least each.
    bound = min(_HASHES, _HASHES * shape.seed_windows // max(1, total) + 1)
    sent = blocks.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, sizes, places, pieces, piece_sizes = _opened(*(c[i] for c in batch.columns[1:]))
                ids, compact = _compact(pieces)
                sequence, ends = _learnt(doc_ids, sizes, places, compact, piece_sizes)
                at, column, n = neighbours(sequence, of[ids], shape)
                begins, ends = window_bounds(ends, shape)
                drawn = np.random.default_rng(batch.column(0)[i].as_py()).integers(0, _HASHES, len(begins))
                some = np.flatnonzero(drawn < bound)
                windows = cut_windows(sequence, begins[some], ends[some], shape)
                windows = np.where(windows >= 0, ids[windows], -1).astype(np.int32)
                keys = np.concatenate((ids[at] * columns + column, -1 - drawn[some]))
                rows = pa.array([None] * len(at) + [x.tobytes() for x in windows], pa.binary())
                found = [pa.array(keys), pa.array(np.append(n, np.ones(len(some), np.int64))), rows]
                yield pa.RecordBatch.from_arrays(found, names=["key", "n", "window"])

    found = blocks.where("windows > 0").select("block", *_TEXTS).mapInArrow(run, "key long, n long, window binary")
    found = found.groupBy("key", "window").agg(F.sum("n").alias("n")).toArrow()
    key, n = (found[c].to_numpy() for c in ("key", "n"))
    beside = np.zeros((len(of), columns))
    beside.reshape(-1)[key[key >= 0]] = n[key >= 0]
    drawn = found.select(["key", "window"]).filter(pa.array(key < 0)).to_pylist()
    taken = sorted((-r["key"], r["window"]) for r in drawn)[: shape.seed_windows]
    return beside, np.frombuffer(b"".join(x for _, x in taken), np.int32).reshape(-1, width).astype(np.int64)


def train(blocks: DataFrame, end: int, shape: Shape) -> Model:
    """The model of the blocks' training documents."""
    counts = np.zeros(end + 1, np.int64)
    by_id = blocks.select(F.explode(F.arrays_zip("ids", "id_counts")).alias("x")).groupBy("x.ids").agg(F.sum("x.id_counts").alias("n"))
    for r in by_id.collect():
        counts[r["ids"]] = r["n"]
    beside, seed = _start(blocks, commonest(counts, shape), shape)
    classes = cluster(counts, beside, shape)
    pairs = _pairs(blocks, classes, shape.classes)
    model = Model(counts, classes, shape, groups=groups_of(pairs, classes, shape))
    fit_start(model, seed)
    model.moments = {}
    for i in range(shape.rounds if len(seed) else 0):
        _round(blocks, model, 2e-3 / (i + 1))
    model.moments = {}
    model.set_shares(counts, pairs)
    return model


# Scoring


def score_block(model: Model, sequence: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The log10 probability of each text of `sequence`, marked ids one after another and a mark at the end.

    `begins` are the places of the marks before the texts, and that of the last one.
    """
    shape = model.shape
    t, step = shape.context, shape.step
    lengths = np.diff(begins)
    out = np.zeros(len(lengths))
    # Each place's ids from there on; behind the last one they are of no text.
    ahead = np.lib.stride_tricks.sliding_window_view(np.append(sequence, np.repeat(sequence[-1:], t)), t + 1)

    def add(text: np.ndarray, start: np.ndarray, first: int) -> None:
        for a in range(0, len(text), 2 * shape.batch):
            some, at = text[a : a + 2 * shape.batch], start[a : a + 2 * shape.batch]
            inside = np.arange(first, t) < (begins[some + 1] - at)[:, None]
            ids = ahead[at]
            found = model.log10(ids[:, :-1], ids[:, first + 1 :], first)
            found *= inside
            np.add.at(out, some, found.sum(axis=1))

    add(np.arange(len(lengths)), begins[:-1], 0)
    more = np.maximum(0, -(-(lengths - t) // step))
    text = np.repeat(np.arange(len(lengths)), more)
    nth = 1 + np.arange(len(text)) - np.repeat(np.cumsum(more) - more, more)
    add(text, begins[text] + nth * step, t - step)
    return out


_SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def score(
    docs: DataFrame, model_path: str, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row with its baseline and its model score; both learn from the rows that aren't held out."""
    spark = docs.sparkSession
    blocks = _blocks(docs, model_path, shape, id_col, text_col)
    counted = _counted(blocks)
    total = blocks.agg(F.sum("learnt")).first()[0] or 0
    distinct = counted.agg(F.sum("distinct")).first()[0] or 0
    spread = float(total + distinct + 1)
    back = counted.groupBy("block").agg(F.collect_list(F.struct("at", "n")).alias("known"))

    model = train(blocks, Pieces(model_path).end, shape)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = sent.value
        own.ready()
        for batch in batches:
            for i in range(batch.num_rows):
                *block, known = (c[i] for c in batch.columns)
                ids, sizes, places, pieces, piece_sizes = _opened(*block)
                count = np.zeros(len(piece_sizes), np.int64)
                for x in known.values:
                    count[np.frombuffer(x["at"].as_buffer(), np.int32)] = np.frombuffer(x["n"].as_buffer(), np.int64)
                begins = np.cumsum(sizes) - sizes
                base = np.add.reduceat(np.log10((count + 1) / spread)[places], begins)
                n_known = np.add.reduceat((count > 0)[places].astype(np.int64), begins)
                sequence, each = _spread(places, pieces, piece_sizes)
                ends = np.append(0, np.cumsum(each))
                marks = np.append(ends[begins], ends[-1])
                scores = score_block(own, np.append(sequence, pieces[0]), marks)
                held = pa.array([is_held_out(x) for x in ids.to_pylist()])
                columns = [ids, held, pa.array(sizes), pa.array(n_known), pa.array(np.full(len(ids), total)), pa.array(base), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                )

    whole = blocks.select("block", *_TEXTS)
    return whole.join(back, "block").drop("block").mapInArrow(run, _SCORES)
