"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks.

Targets. Sources in code point order, null last, weigh 5, 2, 1, repeating, and share all tokens; none takes more than
`most` times its size, and what it can't take is shared anew by weight. With caps that is water filling: target =
min(cap, level * weight), and the level comes from one pass over sources in the order of cap / weight.

Blocks. A source's documents are shuffled by a hash and their tokens form one stream, cut into equal blocks (by rounding,
within one token); a source whose target would have under `least_slots` slots has smaller blocks, of one token at the
least, so that the few slots by which a schedule misses a share are little of it. Schedule: slot n has the golden-ratio point n * phi mod 1, which falls into a source's interval of the
cumulative block shares; a slot's rank among its source's slots picks the block, and ranks past the last block begin a
new pass, of which there are `most` at most. A document is taken as often as the blocks that hold its tokens are, piece
by piece, so it is never taken more than `most` times its size.

Scale: no source is gathered. Stream offsets are two-level prefix sums over hash buckets, ranks two-level prefix sums over
runs of slots. The tables without a partitioning key have a row for each source, after aggregation.

Defined cases: null text or one of no words has size 0 and is taken 0; a null source is a source of its own, last; equal
ids are ordered by a hash of the text, rows equal in both are interchangeable; an empty table gives none; other columns
are kept by `mix` and ignored by `plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, kept, row_of

WEIGHTS = (5, 2, 1)
#: floor(2**32 / golden ratio), odd: n * PHI mod 2**32 runs through all values once.
PHI = 2654435769
_SPAN = 1 << 32
_RUN = 1 << 10


def _div(a: Column | str, b: Column | int) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size) -> also ord and target. A row for each source, so one task orders them."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("ord") % len(WEIGHTS) + 1).cast("int"))
    weighed = (
        sources.withColumn("ord", F.row_number().over(every) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size"))
    )
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    # The water stands at the level of the first source, in filling order, that isn't filled; later levels are lower.
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    target = F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight"))
    return (
        weighed.withColumn("level", level)
        .withColumn("water", F.max(open_level).over(everything))
        .select("source", "source_size", "ord", target.alias("target"))
    )


def _keys(id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """What names a row: key of the source, id, hash of the text."""
    source = F.col(source_col).cast("string")
    return {
        "_source": F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)),
        "_id": F.col(id_col).cast("long"),
        "_hash": F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))),
    }


def _streams(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Different rows, with their copies counted, and their order in the source's stream; a written table without texts."""
    keys = _keys(id_col, text_col, source_col)
    rows = docs.select(
        *[c.alias(k) for k, c in keys.items()],
        F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"),
    )
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.lit("")), "_hash"))
    counted = rows.groupBy("_source", "_id", "_hash", "source", "size").agg(F.count("*").alias("copies"))
    return kept(counted.withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, 2)), "streams")


def n_blocks(total: int, slots: int, least_slots: int) -> Column:
    """Blocks of a source: of one size for all sources, or as many more as give its target `least_slots` slots."""
    size = max(1, -(-total // slots))
    source = F.col("source_size")
    wanted = F.ceil(least_slots * source / F.col("target")).cast("long")
    even = _div(source + F.lit(size - 1), size)
    return F.when(F.col("target") > 0, F.greatest(even, F.least(source, wanted))).otherwise(even)


def schedule(sources: DataFrame) -> DataFrame:
    """(_source, ord, target, source_size, blocks) -> (_source, block, blocks, times): how often each block is taken.

    A source's share of the slots is its target in blocks, held in thousandths so that all engines agree.
    """
    spark = sources.sparkSession
    share = F.round(F.col("target") * F.col("blocks") / F.col("source_size") * 1000).cast("long")
    cut = (
        sources.where("source_size > 0")
        .withColumn("share", share)
        .withColumn("upto", F.sum("share").over(Window.orderBy("ord")))
    )
    cut = kept(cut, "sources")
    shares, n = cut.agg(F.coalesce(F.sum("share"), F.lit(0)), F.count("*")).first()
    if not shares:
        return cut.select("_source", F.lit(0).cast("long").alias("block"), "blocks", F.lit(0).alias("times")).limit(0)
    low = _div((F.col("upto") - F.col("share")) * F.lit(_SPAN), shares)
    high = _div(F.col("upto") * F.lit(_SPAN), shares)
    cell = _SPAN >> max(12, n.bit_length())
    owned = cut.select("_source", "blocks", low.alias("low"), high.alias("high")).where("low < high")
    cells = owned.withColumn("cell", F.explode(F.sequence(_div("low", cell), _div(F.col("high") - 1, cell))))
    points = spark.range(-(-shares // 1000)).withColumn("point", F.col("id") * F.lit(PHI) % F.lit(_SPAN))
    drawn = (
        points.withColumn("cell", _div("point", cell))
        .join(cells, "cell")
        .where((F.col("low") <= F.col("point")) & (F.col("point") < F.col("high")))
        .select("_source", "blocks", "id", _div("id", _RUN).alias("run"))
    )
    runs = drawn.groupBy("_source", "run").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("_source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select("_source", "run", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("_source", "run").orderBy("id")
    ranked = drawn.withColumn("place", F.row_number().over(inside) - 1).join(bases, ["_source", "run"])
    rank = F.col("base") + F.col("place")
    return (
        ranked.select("_source", "blocks", rank.alias("rank"))
        .groupBy("_source", "blocks", (F.col("rank") % F.col("blocks")).alias("block"))
        .agg(F.count("*").alias("times"))
    )


def plan(
    docs: DataFrame,
    most: int = 3,
    seed: int = 0,
    slots: int = 1 << 18,
    least_slots: int = 1000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Every row with its size, its source's size and target, `taken`, and `passes`: the first tokens taken in each pass.

    A pass takes the head of its source's stream, so of a document it takes all, a head, or nothing.
    """
    rows = _streams(docs, seed, id_col, text_col, source_col)
    words = F.col("size") * F.col("copies")
    buckets = rows.groupBy("_source", "_bucket").agg(F.sum(words).alias("n"), F.first("source").alias("source"))
    buckets = kept(buckets, "buckets")
    sizes = buckets.groupBy("_source").agg(F.sum("n").alias("source_size"), F.first("source").alias("source"))
    total = buckets.agg(F.sum("n")).first()[0] or 0
    targets = source_targets(sizes.select("source", "source_size"), most).withColumn("blocks", n_blocks(total, slots, least_slots))
    targets = kept(targets.withColumn("_source", _keys("ord", "source", "source")["_source"]).drop("source"), "targets")
    times = schedule(targets)
    upto = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = buckets.select("_source", "_bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("before", F.coalesce(F.sum(words).over(inside), F.lit(0)))
        .join(bases, ["_source", "_bucket"])
        .join(targets, "_source")
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("start", F.col("base") + F.col("before") + F.col("copy") * F.col("size"))
        .withColumn("end", F.col("start") + F.col("size"))
    )
    # Block i of n in a stream of S tokens begins at i * S div n, so token t lies in block ((t + 1) * n - 1) div S.
    stream, blocks = F.greatest(F.col("source_size"), F.lit(1)), F.col("blocks")
    first = _div((F.col("start") + 1) * blocks - 1, stream)
    last = _div(F.col("end") * blocks - 1, stream)
    pieces = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    begins, ends = _div(F.col("block") * F.col("source_size"), F.greatest(blocks, F.lit(1))), _div(
        (F.col("block") + 1) * F.col("source_size"), F.greatest(blocks, F.lit(1))
    )
    piece = F.coalesce(F.least(F.col("end"), ends) - F.greatest(F.col("start"), begins), F.lit(0))
    held = pieces.withColumn("words", piece).join(times.select("_source", "block", "times"), ["_source", "block"], "left")
    times_col = F.least(F.coalesce("times", F.lit(0)), F.lit(most))
    taken = [F.sum(F.when(times_col > p, F.col("words")).otherwise(0)).alias(f"_p{p}") for p in range(most)]
    row = ["_source", "_id", "_hash", "copy", "size", "source_size", "target"]
    summed = held.groupBy(*row).agg(F.sum(F.col("words") * times_col).cast("long").alias("taken"), *taken)
    return summed.select(
        F.col("_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        "taken",
        F.array(*[f"_p{p}" for p in range(most)]).alias("passes"),
        "_source",
        "_hash",
    )


def mix(
    docs: DataFrame,
    most: int = 3,
    seed: int = 0,
    slots: int = 1 << 18,
    least_slots: int = 1000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself, with the columns of `docs`: a row for each pass of a document, its text cut to the words taken.

    Only the document at which a pass ends is cut; its words are then joined by single spaces. A column n_chars, if there
    is one, follows the text.
    """
    decided = kept(plan(docs, most, seed, slots, least_slots, id_col, text_col, source_col), "mix")
    # Copies of a row take all, a head, or nothing: few different numbers, counted.
    wanted = (
        decided.select("_source", F.col("doc_id").alias("_id"), "_hash", "size", F.explode("passes").alias("head"))
        .where("head > 0")
        .groupBy("_source", "_id", "_hash", "size", "head")
        .agg(F.count("*").alias("times"))
    )
    named = docs.select(row_of(docs), *[c.alias(k) for k, c in _keys(id_col, text_col, source_col).items()])
    copies = decided.groupBy("_source", "doc_id", "_hash").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (copies or 0) > 1:
        named = named.dropDuplicates(["_source", "_id", "_hash"])
    same = F.struct("_source", "_hash", F.coalesce(F.col("_id").cast("string"), F.lit("")))
    left, right = named.withColumn("_key", same), wanted.withColumn("_key", same).drop("_source", "_id", "_hash")
    rows = left.join(right, "_key").withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    out = {c: F.col("row").getField(c) for c in docs.columns}
    found = F.regexp_extract_all(out[text_col], F.lit(f"({WORD_PATTERN})"))
    cut = F.array_join(F.slice(found, F.lit(1), F.col("head").cast("int")), " ")
    whole = F.col("head") == F.col("size")
    out[text_col] = F.when(whole, out[text_col]).otherwise(cut)
    if "n_chars" in out:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(whole, out["n_chars"]).otherwise(F.length(cut).cast(kind))
    return rows.select(*[c.alias(k) for k, c in out.items()])
