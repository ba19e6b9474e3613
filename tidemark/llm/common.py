"""Shared pieces of the training-data operators: words, word hashes, Arrow batches, written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.workdir import new_path

#: A word is a maximal run of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_HELD_WORDS = 400_000


class WordHashes(dict):
    """Word (bytes) -> XXH64. Bounded: emptied when it holds too many words."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _HELD_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Rabin-Karp hashes, modulo 2**64, of every run of k values."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        def powers(b: int) -> np.ndarray:
            out = np.full(n, np.uint64(b))
            out[0] = 1
            return np.cumprod(out)

        self.up, self.down = powers(self.base), powers(self.inverse)

    def __call__(self, values: np.ndarray, k: int) -> np.ndarray:
        n = len(values)
        if n < k:
            return np.zeros(0, np.uint64)
        if n > len(self.up):
            self._grow(1 << n.bit_length())
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=sums[1:])
        return (sums[k:] - sums[:-k]) * self.down[: n - k + 1]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads them evenly."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbouring values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in `known`, an ascending array that isn't empty."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of `width` that begins at one of `starts`."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[..., Iterable[tuple]]],
    schema: str,
    flush_rows: int = 20_000,
    flush_bytes: int = 8 << 20,
) -> DataFrame:
    """Apply a row function to each row of `df`, in Arrow batches of bounded size.

    `make()` runs once a task and returns the function; that gets the row's columns in order and yields tuples for
    `schema`. One value at a time is turned into a Python object, so a batch of long texts is never held twice.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow
            )

        rows: list[tuple] = []
        held = 0
        for batch in batches:
            columns = batch.columns
            for i in range(batch.num_rows):
                for row in f(*(c[i].as_py() for c in columns)):
                    rows.append(row)
                    held += sum(len(x) for x in row if isinstance(x, (bytes, str, list)))
                    if len(rows) >= flush_rows or held >= flush_bytes:
                        yield pack(rows)
                        rows, held = [], 0
        if rows:
            yield pack(rows)

    return df.mapInArrow(run, schema)


def text_bytes(col) -> F.Column:
    """UTF-8 bytes of a text column, none for null."""
    return F.coalesce(col.cast("string"), F.lit("")).cast("binary")


def row_of(docs: DataFrame) -> F.Column:
    """All columns as one, named row, so that names of ours can't clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def place_of(docs: DataFrame, name: str) -> int:
    """A column's place by its name, as Spark would find it: letter case matters only if the session says so."""
    if name in docs.columns or docs.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        return docs.columns.index(name)
    return [c.lower() for c in docs.columns].index(name.lower())


def kept(df: DataFrame, what: str) -> DataFrame:
    """`df` as a written table in the shared folder: lineage ends here, and any executor can read it again."""
    spark = df.sparkSession
    at = new_path(spark, what)
    schema = df.schema
    # Small row groups: a writing task buffers one of them.
    df.write.option("parquet.block.size", 16 << 20).parquet(at)
    return spark.read.schema(schema).parquet(at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
