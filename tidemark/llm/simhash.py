"""SimHash near-duplicate detection over blocks of fingerprint bits.

Fingerprints within `radius` differing bits are linked. 64 bits are cut into `radius` + r blocks; two such fingerprints
agree on r whole blocks at least (pigeonhole), so a join on every choice of r blocks finds all of them and the Hamming
distance is verified in the join. r is the least with at least as many key bits as the count of different fingerprints
has, so a key's bucket of unrelated fingerprints stays near one at any size; every r gives the same links.

Exact copies share a fingerprint and are one row from the start (pre-aggregated), whatever their number. A bucket with
more than `dense` different fingerprints is not joined with itself: each member spells out the values within
radius / 2 bits of it (on the bits outside the key), and members that meet in a value are linked to the least of them.
Two fingerprints are within the radius if and only if they meet, so that is exact, and its rows are linear in the bucket.

Defined cases: a text of no words (or null) has fingerprint zero, linked like any other; fewer words than a shingle are
one shingle; rows with a null id get fingerprint and component and lend no id to it; repeated ids and rows are kept, a row
out for each row in; a component without any id has a null one; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, WordHashes, among, kept, map_rows, mix64, row_of, text_bytes
from .components import connected_components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 15
_SQUARE = 1000
_SQUARE_BYTES = 32 << 20


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """SimHash of the text's word shingles; a bit is set if it is in over half of the shingles' XXH64."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, _CHUNK):
        n = min(_CHUNK, count - at)
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), seed) for i in range(at, at + n)), np.uint64, n
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    value = int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])
    return value - (1 << 64) if value >> 63 else value


def fingerprints(
    docs: DataFrame,
    shingle: int = 4,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, fp) of every row."""

    def make():
        return lambda doc_id, text: ((doc_id, fingerprint(text, shingle, seed)),)

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(F.col(text_col)).alias("text"))
    return map_rows(columns, make, "doc_id long, fp long")


def block_masks(radius: int, agreeing: int) -> list[int]:
    """Masks of every choice of `agreeing` out of radius + agreeing blocks, as signed 64-bit integers."""
    blocks = radius + agreeing
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    whole = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    masks = [sum(whole[i] for i in some) for some in combinations(range(blocks), agreeing)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def choose_agreeing(radius: int, count: int) -> int:
    """The least number of agreeing blocks whose keys have as many bits as `count`; at most 64 - radius."""
    agreeing = 1
    while agreeing < 8 and agreeing + radius < 64 and 64 * agreeing // (radius + agreeing) < count.bit_length():
        agreeing += 1
    return agreeing


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _meetings(members: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links of dense buckets: members that meet in a value within half the radius of both."""
    if radius % 2:
        raise ValueError("dense buckets need an even radius")
    half = radius // 2

    def make():
        tables = {}

        def row(c, k, fp):
            if c not in tables:
                free = [i for i in range(64) if not (masks[c] >> i) & 1]
                tables[c] = np.array(
                    [sum(1 << i for i in some) for d in range(half + 1) for some in combinations(free, d)], np.uint64
                )
            for at in (np.uint64(fp & (1 << 64) - 1) ^ tables[c]).view(np.int64).tolist():
                yield c, k, at, fp

        return row

    near = map_rows(members.select("c", "k", "fp"), make, "c int, k long, at long, fp long")
    least = near.groupBy("c", "k", "at").agg(F.min("fp").alias("least"), F.max("fp").alias("most"))
    met = near.join(least.where("least < most"), ["c", "k", "at"])
    return met.where("fp > least").select(F.col("fp").alias("a"), F.col("least").alias("b"))


def close_links(fps: DataFrame, radius: int = 4, dense: int = 1024) -> DataFrame:
    """Links (a, b) whose closure is that of all pairs in column fp of different values within the radius."""
    count = fps.count()
    masks = block_masks(radius, choose_agreeing(radius, count))
    keyed = fps.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("c", "k")
    )
    sizes = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where(F.col("n") > dense)
    crowded = kept(sizes, "dense")
    if crowded.isEmpty():
        usual, links = keyed, []
    else:
        usual = keyed.join(crowded, ["c", "k"], "left_anti")
        links = [_meetings(keyed.join(crowded, ["c", "k"], "left_semi"), masks, radius)]
    a, b = usual.alias("a"), usual.alias("b")
    pairs = a.join(
        b,
        (F.col("a.c") == F.col("b.c"))
        & (F.col("a.k") == F.col("b.k"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (distance(F.col("a.fp"), F.col("b.fp")) <= radius),
    ).select(F.col("b.fp").alias("a"), F.col("a.fp").alias("b"))
    for more in links:
        pairs = pairs.unionAll(more)
    return pairs


def near_duplicates(
    docs: DataFrame,
    shingle: int = 4,
    radius: int = 4,
    seed: int = 42,
    dense: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id that links reach."""
    rows = kept(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    classes = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = connected_components(close_links(classes.select("fp"), radius, dense))
    linked = kept(roots.join(classes, roots.node == classes.fp).select("fp", "root", "first"), "linked")
    firsts = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(firsts, "root").select("fp", "component_id")
    owners = classes.join(named, "fp", "left").select(
        "fp", F.when(F.col("component_id").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id")
    )
    # Written, so that the join below shuffles both sides anew and a large group of copies can be split.
    return rows.join(kept(owners, "owners"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


class Sketch:
    """Min-hash blocks of a text's word shingles: texts of similarity s share a given block with probability s ** rows."""

    def __init__(self, shingle: int, blocks: int, rows: int):
        self.shingle, self.blocks, self.rows = shingle, blocks, rows
        self.words, self.roll, self.fold = WordHashes(23), Rolling(0x9FB21C651E98DF25), Rolling(0xD1342543DE82EF95)
        self.factors = np.random.default_rng(7).integers(0, 1 << 63, blocks * rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def shingles(self, text: bytes) -> np.ndarray:
        """Hashes of the different shingles, ascending."""
        words = text.translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.sort(mix64(self.roll(self.words.of(words), min(self.shingle, len(words)))))
        return h[np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))]

    def __call__(self, text: bytes) -> list[int]:
        h = self.shingles(text)
        if not len(h):
            return []
        least = np.full(len(self.factors), np.iinfo(np.uint64).max)
        for at in range(0, len(h), _CHUNK):
            some = h[at : at + _CHUNK]
            for i, f in enumerate(self.factors):
                x = some * f
                least[i] = min(least[i], (x ^ (x >> np.uint64(32))).min())
        return mix64(np.array([self.fold(row, self.rows)[0] for row in least.reshape(self.blocks, self.rows)])).view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending arrays of different values."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = int(among(a, b).sum())
    return shared / (len(a) + len(b) - shared)


def _bodies(hashes: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(hash, text) of some texts, each from its row with the least id, so that copies don't meet."""
    owners = texts.join(hashes.select("hash").distinct(), "hash", "left_semi")
    owners = owners.select(F.col("hash").alias("_hash"), F.col("id").alias("_id"))
    same = (F.col("hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id"))
    return kept(docs.join(owners, same).select("hash", "text").dropDuplicates(["hash"]), "bodies")


def _verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, make_sketch, similarity: float) -> DataFrame:
    """The pairs (a, b) of text hashes whose shingle sets are so much alike."""
    pairs = kept(pairs.distinct(), "pairs")
    bodies = _bodies(pairs.select(F.col("a").alias("hash")).unionAll(pairs.select("b")), texts, docs)
    both = pairs.join(bodies.select(F.col("hash").alias("a"), F.col("text").alias("ta")), "a").join(
        bodies.select(F.col("hash").alias("b"), F.col("text").alias("tb")), "b"
    )

    def make():
        sketch = make_sketch()

        def row(a, b, ta, tb):
            if jaccard(sketch.shingles(ta), sketch.shingles(tb)) >= similarity:
                yield a, b

        return row

    return kept(map_rows(both.select("a", "b", "ta", "tb"), make, "a string, b string"), "similar")


def _similar_links(
    texts: DataFrame, docs: DataFrame, links: DataFrame, make_sketch, similarity: float, all_pairs: int
) -> DataFrame:
    """Links (a, b) that join to `links` those of all texts that share a block and are `similarity` alike or more.

    Of a block with up to `all_pairs` texts every pair is verified. In a larger one each text is first verified against
    three of it: the one with the least id, and the least and greatest by hash. Mostly that makes the block one component,
    and nothing is left to do; else the texts outside its largest component are verified against all that are in others,
    a square of texts at a time. So no pair that could join two components goes unseen.
    """
    members = texts.select("hash", "id", "n_bytes", F.posexplode("blocks").alias("block", "key"))
    groups = (
        members.groupBy("block", "key")
        .agg(
            F.count("*").alias("n"),
            F.sum("n_bytes").alias("n_bytes"),
            F.min(F.struct(F.col("id").isNull(), "id", "hash"))["hash"].alias("first"),
            F.min("hash").alias("low"),
            F.max("hash").alias("high"),
        )
        .where("n > 1")
    )
    met = kept(members.drop("n_bytes").join(kept(groups, "blocks"), ["block", "key"]).drop("id"), "members")
    few = met.where(F.col("n") <= all_pairs).select("block", "key", "hash")
    a, b = few.alias("a"), few.alias("b")
    same = (F.col("a.block") == F.col("b.block")) & (F.col("a.key") == F.col("b.key"))
    pairs = a.join(b, same & (F.col("a.hash") < F.col("b.hash"))).select(
        F.col("a.hash").alias("a"), F.col("b.hash").alias("b")
    )
    many = met.where(F.col("n") > all_pairs)
    stars = many.select("hash", F.explode(F.array_distinct(F.array("first", "low", "high"))).alias("other"))
    ordered = [F.least("hash", "other").alias("a"), F.greatest("hash", "other").alias("b")]
    pairs = pairs.unionAll(stars.where("hash <> other").select(*ordered))
    found = links.unionAll(_verified(pairs, texts, docs, make_sketch, similarity))
    if many.isEmpty():
        return found
    roots = kept(connected_components(found), "roots")
    owned = many.select("block", "key", "hash", "n", "n_bytes").join(roots, many.hash == roots.node, "left")
    owned = kept(owned.select("block", "key", "hash", "n", "n_bytes", F.coalesce("root", "hash").alias("root")), "owned")
    parts = owned.groupBy("block", "key", "root").agg(F.count("*").alias("m")).groupBy("block", "key")
    split = parts.agg(F.count("*").alias("parts"), F.max(F.struct("m", "root"))["root"].alias("main")).where("parts > 1")
    torn = kept(owned.join(kept(split.select("block", "key", "main"), "split"), ["block", "key"]), "torn")
    if torn.isEmpty():
        return found
    return found.unionAll(_torn_links(torn, texts, docs, make_sketch, similarity))


def _torn_links(torn: DataFrame, texts: DataFrame, docs: DataFrame, make_sketch, similarity: float) -> DataFrame:
    """Links between texts outside a block's largest component and texts of the block's other components.

    A block is cut into squares of _SQUARE by _SQUARE texts or _SQUARE_BYTES on a side at most or so, and a task holds one
    square; no row is made for a pair, yet a text is sent to every square of its row and column. A pair that shares an
    earlier block is looked at there.
    """
    bodies = _bodies(torn, texts, docs).join(texts.select("hash", "blocks"), "hash")
    cuts = F.greatest(
        F.call_function("div", F.col("n") + F.lit(_SQUARE - 1), F.lit(_SQUARE)),
        F.call_function("div", F.col("n_bytes"), F.lit(_SQUARE_BYTES)) + 1,
    )
    own = F.pmod(F.xxhash64("hash"), cuts)
    every = F.explode(F.sequence(F.lit(0).cast("long"), cuts - 1))
    columns = ["block", "key", "hash", "root"]
    minor = torn.where("root <> main").select(*columns, own.alias("x"), every.alias("y"), F.lit(True).alias("minor"))
    others = torn.select(*columns, every.alias("x"), own.alias("y"), F.lit(False).alias("minor"))
    cells = minor.unionAll(others).join(kept(bodies, "bodies"), "hash")

    def run(table: pa.Table) -> pa.Table:
        sketch = make_sketch()
        block = table.column("block")[0].as_py()
        rows = table.select(["minor", "hash", "root", "text", "blocks"]).to_pylist()
        shingles: dict[str, np.ndarray] = {}
        for r in rows:
            if r["hash"] not in shingles:
                shingles[r["hash"]] = sketch.shingles(r["text"])
        right = [r for r in rows if not r["minor"]]
        roots = np.array([r["root"] for r in right])
        earlier = np.array([r["blocks"][:block] for r in right], np.int64).reshape(len(right), block)
        out = []
        for r in (r for r in rows if r["minor"]):
            mine = np.array(r["blocks"][:block], np.int64)
            wanted = np.flatnonzero((roots != r["root"]) & ~(earlier == mine).any(axis=1))
            if not len(wanted):
                continue
            a = shingles[r["hash"]]
            sets = [shingles[right[i]["hash"]] for i in wanted.tolist()]
            sizes = np.array([len(x) for x in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            shared = np.bincount(owner[among(np.concatenate(sets), a)], minlength=len(sets))
            for i in np.flatnonzero(shared >= similarity * (len(a) + sizes - shared) - 1e-9).tolist():
                out.append(sorted((r["hash"], right[wanted[i]]["hash"])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.string()), "b": pa.array([x[1] for x in out], pa.string())})

    found = cells.groupBy("block", "key", "x", "y").applyInArrow(run, "a string, b string")
    return kept(found, "torn-links")


def one_of_each(
    docs: DataFrame,
    shingle: int = 4,
    radius: int = 4,
    seed: int = 42,
    dense: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    similar_shingle: int = 5,
    similarity: float | None = 0.8,
    all_pairs: int = 32,
    blocks: int = 16,
    rows: int = 5,
) -> DataFrame:
    """The documents, all columns, with one row left of each component: the least by id (null last), then text hash.

    Links are those of `near_duplicates`, and unless `similarity` is None also those of texts whose sets of
    `similar_shingle`-word shingles are so much alike. Fingerprints of 64 bits within a small radius miss most of the
    latter, so their candidates come from min-hash blocks, joined like the fingerprints' blocks; texts that are 0.8 alike
    share one of 16 blocks of 5 with a probability of 0.998.
    """
    names = [F.col(id_col).cast("long").alias("id"), F.md5(text_bytes(F.col(text_col))).alias("hash")]
    bodies = docs.select(*names, text_bytes(F.col(text_col)).alias("text"))

    def make():
        sketch = Sketch(similar_shingle, blocks, rows)

        def row(doc_id, hash_, text):
            yield doc_id, hash_, len(text), fingerprint(text, shingle, seed), sketch(text) if similarity is not None else []

        return row

    each = kept(map_rows(bodies, make, "id long, hash string, n_bytes long, fp long, blocks array<long>"), "sketches")
    texts = each.groupBy("hash").agg(
        F.min("id").alias("id"), F.first("n_bytes").alias("n_bytes"), F.first("fp").alias("fp"), F.first("blocks").alias("blocks")
    )
    texts = kept(texts, "texts")
    # A fingerprint stands for its texts by their least hash.
    classes = kept(texts.groupBy("fp").agg(F.min("hash").alias("hash")), "classes")
    close = close_links(classes.select("fp"), radius, dense)
    named = close.join(classes.select(F.col("fp").alias("a"), F.col("hash").alias("x")), "a").join(
        classes.select(F.col("fp").alias("b"), F.col("hash").alias("y")), "b"
    )
    links = named.select(F.col("x").alias("a"), F.col("y").alias("b")).unionAll(
        texts.join(classes.withColumnRenamed("hash", "owner"), "fp").where("hash <> owner").select("hash", "owner")
    )
    if similarity is not None:
        links = _similar_links(
            texts,
            bodies,
            kept(links, "close"),
            lambda: Sketch(similar_shingle, blocks, rows),
            similarity,
            all_pairs,
        )
    roots = kept(connected_components(links), "roots")
    owned = texts.join(roots, texts.hash == roots.node, "left").select(F.coalesce("root", "hash").alias("root"), "id", "hash")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("least")
    left = kept(owned.groupBy("root").agg(least).select("least.id", "least.hash"), "survivors")
    left = left.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"))
    same = docs.select(row_of(docs), *names).join(left, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_semi")
    repeats = each.groupBy("id", "hash").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (repeats or 0) > 1:
        same = same.dropDuplicates(["id", "hash"])
    return same.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
