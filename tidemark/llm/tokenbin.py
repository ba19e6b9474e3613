"""Token-ID output: flat unsigned integer files, 64-bit document offsets beside them, read back memory-mapped.

Format, in one folder: for each partition p a file `ids-PPPPP-<attempt>.bin` of little-endian unsigned integers (2 bytes
if all ids of the vocabulary fit, else 4) and a file of the same name ending in `.off` with its documents' starts and the
end, as little-endian unsigned 64-bit integers; and `index`, a Parquet table (file, part, doc, doc_id, at, n_tokens).
Partitions hold ascending ids. The index is committed by Spark and names the files of the attempts that counted: a
repeated or speculative task writes files of its own name, which nothing refers to. The start of a document among all
ids is its partition's base, a prefix sum over partitions, plus its place in the file.

Defined cases: null text is the empty text, which is the end id alone; a null id sorts first; equal ids are ordered by
text hash; an empty table makes no file and an empty index; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.workdir import new_path
from .common import map_rows, partitions

_HELD_PIECES = 800_000
_AT_ONCE = 100_000
_MARKS = frozenset(".,;:!?")
# A normalizer and a pre-tokenizer under which no token crosses a space and letters never join a mark.
_FOLDING = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = re.compile(r"\s")
_INDEX = "file string, part int, doc long, doc_id long, at long, n_tokens long"


def _splits_at_spaces(tokenizer) -> bool:
    """Whether ids of a text are those of its pieces between spaces: told by the tokenizer's own settings."""
    settings = json.loads(tokenizer.to_str())
    before = settings["pre_tokenizer"] or {}
    first, *rest = before.get("pretokenizers") or [{}]
    split = first.get("type") == "Split" and first["pattern"] == {"Regex": _SPLIT} and first["behavior"] == "Removed" and first["invert"]
    byte_level = [x["type"] for x in rest] == ["ByteLevel"] and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
    plain = all(
        not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or _SPACE.search(t["content"]))
        for t in settings["added_tokens"]
    )
    return settings["normalizer"] == _FOLDING and split and byte_level and plain


class PieceEncoder:
    """Encodes texts with a tokenizer of any kind, to the ids it gives for the whole text.

    If the tokenizer's settings are those of `_FOLDING` and `_SPLIT`, a text is encoded piece by piece between spaces, and
    pieces are remembered (a bounded number of them). Letters up to U+024F other than a dotted capital I fold one by
    one and join no mark behind them, so such a piece is looked up in lower case and without its last mark. Added tokens
    are matched on raw text, so a piece that would hold one in lower case stays as it is. Any other tokenizer encodes
    each text at once.
    """

    def __init__(self, path: str, dtype: str):
        # Each task has one core; the library's own threads would only contend for it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype, self.whole = np.dtype(dtype), not _splits_at_spaces(self.tokenizer)
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, pieces: list[str]) -> None:
        for piece, e in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            ids = array(self.code, e.ids)
            if sys.byteorder == "big":
                ids.byteswap()
            self.known[piece] = ids.tobytes()

    def _parts(self, piece: str) -> tuple[str, str]:
        """What a piece's ids are made of: itself, or its letters in lower case and its last mark."""
        if not piece.isascii() and (max(piece) >= "\u0250" or "\u0130" in piece):
            return piece, ""
        low = piece.lower()
        if any(t in low for t in self.added):
            return piece, ""
        if len(low) > 1 and low[-1] in _MARKS and low[:-1].isalpha():
            return low[:-1], low[-1]
        return low, ""

    def _learn(self, new: list[str], needed: set[str]) -> None:
        """Two generations: when the young one is full it becomes the old one, from which pieces in use come back."""
        if len(self.known) + 3 * len(new) > _HELD_PIECES:
            self.known, self.old, new = {}, self.known, list(needed)
        known, old, unknown = self.known, self.old, []
        for p in new:
            if (ids := old.get(p)) is not None:
                known[p] = ids
            else:
                unknown.append(p)
        parts = [self._parts(p) for p in unknown]
        distinct = {x for both in parts for x in both}
        self._encode([x for x in distinct if x not in self.known])
        for p, (core, mark) in zip(unknown, parts, strict=True):
            self.known[p] = self.known[core] + self.known[mark]

    def __call__(self, text: str) -> bytes:
        if self.whole:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        pieces = text.replace("\n", " ").split(" ")
        out = []
        for i in range(0, len(pieces), _AT_ONCE):
            some = pieces[i : i + _AT_ONCE]
            known = self.known
            distinct = set(some)
            if new := [p for p in distinct if p not in known]:
                self._learn(new, distinct)
            out.append(b"".join(map(self.known.__getitem__, some)))
        return b"".join(out)


@functools.lru_cache(maxsize=1)
def _encoder(path: str, dtype: str) -> PieceEncoder:
    """The worker's encoder, with what it remembers from earlier tasks."""
    return PieceEncoder(path, dtype)


def _open(folder: str):
    """A file system of pyarrow's and the path in it; the file scheme and bare paths are the local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every text and write the folder described above."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)
    dtype = "<u2" if max(size - 1, end_id) < 1 << 16 else "<u4"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
        .repartitionByRange(partitions(spark), "doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
        .select("doc_id", "text")
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = _encoder(tokenizer_path, dtype)
        end = np.array([end_id], dtype).tobytes()
        part = TaskContext.get().partitionId()
        name = f"ids-{part:05d}-{uuid.uuid4().hex}"
        store, path = _open(folder)
        at, doc = 0, 0
        bins = offs = None
        try:
            for batch in batches:
                ids, rows = [], []
                for i in range(batch.num_rows):
                    if bins is None:
                        bins = store.open_output_stream(f"{path}/{name}.bin")
                        offs = store.open_output_stream(f"{path}/{name}.off")
                    data = encode(batch.column(1)[i].as_py()) + end
                    bins.write(data)
                    n = len(data) // encode.dtype.itemsize
                    ids.append(batch.column(0)[i].as_py())
                    rows.append((doc, at, n))
                    at, doc = at + n, doc + 1
                if rows:
                    offs.write(np.array([r[1] for r in rows], "<u8").tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(rows)),
                            pa.array([part] * len(rows), pa.int32()),
                            pa.array([r[0] for r in rows], pa.int64()),
                            pa.array(ids, pa.int64()),
                            pa.array([r[1] for r in rows], pa.int64()),
                            pa.array([r[2] for r in rows], pa.int64()),
                        ],
                        names=["file", "part", "doc", "doc_id", "at", "n_tokens"],
                    )
            if bins is not None:
                offs.write(np.array([at], "<u8").tobytes())
        finally:
            for f in (bins, offs):
                if f is not None:
                    f.close()

    store, path = _open(folder)
    store.create_dir(path, recursive=True)
    ordered.mapInArrow(run, _INDEX).write.parquet(f"{folder}/index")


class TokenFile:
    """One file of ids: memory-mapped on a mounted file system, else read by ranges."""

    def __init__(self, folder: str, name: str, itemsize: int):
        store, path = _open(folder)
        self.dtype = np.dtype("<u2" if itemsize == 2 else "<u4")
        at = f"{path}/{name}.bin"
        if store.type_name == "local":
            self.ids, self.file = np.memmap(at, self.dtype, "r"), None
        else:
            self.ids, self.file = None, store.open_input_file(at)

    def read(self, at: int, n: int) -> np.ndarray:
        if self.ids is not None:
            return self.ids[at : at + n]
        w = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(n * w, at * w), self.dtype)


def read_tokens(spark: SparkSession, folder: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)
    itemsize = 2 if max(size - 1, end_id) < 1 << 16 else 4
    index = spark.read.schema(_INDEX).parquet(f"{folder}/index")
    # A row for each partition of the writer.
    bases = (
        index.groupBy("part")
        .agg(F.sum("n_tokens").alias("n"))
        .select(
            "part",
            F.coalesce(
                F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("base"),
        )
    )
    placed = index.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "file", "at"
    )

    def make():
        held: dict[str, TokenFile] = {}

        def row(doc_id, start, n, file, at):
            if file not in held:
                held.clear()
                held[file] = TokenFile(folder, file, itemsize)
            crc, step = 0, 1 << 20
            for i in range(0, n, step):
                crc = zlib.crc32(held[file].read(at + i, min(step, n - i)).astype("<u4").tobytes(), crc)
            yield doc_id, start, n, crc

        return row

    return map_rows(placed, make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write `docs` to a new folder of token files and describe each document as read back from there."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    write_tokens(docs, folder, tokenizer_path, end_id)
    return read_tokens(spark, folder, tokenizer_path, end_id)
