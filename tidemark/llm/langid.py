"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives, from any place in a text, the longest match that occurs in
that language's sample. Cross-parsing cuts the text greedily into such matches; the fewer phrases it takes per character,
the closer the language. The language with the fewest wins, a tie by name.

A text is parsed whole: its letters, lower-cased, one space for whatever lies between two runs of them and one at either
end, so a match may run over many words.

The sample is bounded: `sample_docs` labelled documents a language, least by a hash of the id, of each at most `doc_chars`
characters, and of them all `sample_chars` in equal shares: with 120 documents and 60,000 characters, the first 500 of each
document's letters. What a short document leaves of its share isn't used. `predict` takes any number of labels, in passes
of `pass_langs` languages by name: the sample of one pass is all that reaches the driver at a time and is broadcast, each
pass gives every text its two lowest rates, and the lowest of all passes decide, so the passes change no result. `learn`
gives the samples of few languages at once; it shares out `total_chars` and `total_docs` and refuses over `most_langs`.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any labelled text every row is `und`;
labels that are null or not eligible teach nothing; every row gives a row, whatever its id; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept, map_rows

#: Runs of letters of any script.
_LETTERS = re.compile(r"[^\W\d_]+")


class Automaton:
    """Suffix automaton of a text: a walk from state 0 succeeds exactly for its substrings."""

    def __init__(self, text: str):
        moves: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in text:
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at != -1 and c not in moves[at]:
                moves[at][c] = new
                at = link[at]
            if at != -1:
                to = moves[at][c]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    copy = len(moves)
                    moves.append(dict(moves[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    while at != -1 and moves[at].get(c) == to:
                        moves[at][c] = copy
                        at = link[at]
                    link[to] = link[new] = copy
            last = new
        # States as dictionaries from a character to the next state.
        states: list[dict] = [{} for _ in moves]
        for state, to in zip(states, moves, strict=True):
            state.update((c, states[i]) for c, i in to.items())
        self.root = states[0]

    def phrases(self, text: str) -> int:
        """Greedy longest matches that `text` is cut into; a character that occurs nowhere is a phrase of its own."""
        state = root = self.root
        count = 0
        for c in text:
            to = state.get(c)
            if to is None:
                count += state is not root
                to = root.get(c)
                if to is None:
                    count += 1
                    to = root
            state = to
        return count + (state is not root)


def letters(text: str) -> str:
    """The letters of a text, lower case, with one space for what lies between; empty if there are none."""
    words = _LETTERS.findall(text.lower())
    return f" {' '.join(words)} " if any(c.isalpha() for w in words for c in w) else ""


class Identifier:
    """Predicts (language, score) from texts; made from samples by language."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        self.parsers = [Automaton(samples[k]) for k in self.names]

    def lowest(self, text: str | None) -> list[tuple[float, str]]:
        """The two languages with the fewest phrases a character and their rates; none for a text without letters."""
        line = letters(text) if text else ""
        if not line:
            return []
        return sorted((p.phrases(line) / len(line), name) for p, name in zip(self.parsers, self.names, strict=True))[:2]

    def __call__(self, text: str | None) -> tuple[str, float]:
        return decide(self.lowest(text))


def decide(rates: list[tuple[float, str]]) -> tuple[str, float]:
    """The language and score from the lowest rates, in order."""
    if not rates:
        return "und", 0.0
    best, name = rates[0]
    rest = rates[1][0] if len(rates) > 1 else 2 * best
    return name, round(max(0.0, min(1.0, 1 - best / rest)), 6)


def learn(
    docs: DataFrame,
    eligible: Column,
    sample_docs: int = 120,
    sample_chars: int = 60_000,
    doc_chars: int = 4_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    total_docs: int = 6_000,
    total_chars: int = 600_000,
    most_langs: int = 1_000,
) -> dict[str, str]:
    """Sample text by language, from rows with a language and text for which `eligible` holds."""
    langs = docs.where(eligible).agg(F.count_distinct(F.col(lang_col).cast("string"))).first()[0] or 1
    if langs > most_langs:
        raise ValueError(f"{langs} labels are over the bound of {most_langs} languages")
    sample_docs = max(1, min(sample_docs, total_docs // langs))
    sample_chars = min(sample_chars, total_chars // langs)
    order = F.xxhash64(F.col(id_col).cast("string"))
    spark_text = F.col(text_col).cast("string")
    rows = docs.where(eligible & F.col(lang_col).isNotNull() & spark_text.isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"),
        order.alias("o"),
        F.col(id_col).cast("string").alias("id"),
        F.xxhash64(spark_text).alias("h"),
    )
    # Narrow rows only; each task keeps its own first few of a language before anything is shuffled.
    ranked = Window.partitionBy("lang").orderBy("o", "id", "h")
    chosen = rows.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= sample_docs)
    texts = docs.where(eligible & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(id_col).cast("string").alias("id"),
        F.xxhash64(spark_text).alias("h"),
        F.substring(spark_text, 1, doc_chars).alias("text"),
    )
    found = texts.join(F.broadcast(chosen.select("lang", "id", "h", "n")), ["lang", "id", "h"]).select("lang", "n", "text")
    by_lang: dict[str, dict[int, str]] = {}
    for r in found.collect():
        by_lang.setdefault(r["lang"], {})[r["n"]] = r["text"]
    out = {}
    for lang, some in by_lang.items():
        words = [_LETTERS.findall(some[n].lower()) for n in sorted(some)]
        share = max(1, sample_chars // max(1, len(words)))
        parts = []
        for each in words:
            line = " ".join(each)
            parts.append(line if len(line) <= share else line[:share].rpartition(" ")[0])
        if text := " ".join(p for p in parts if p):
            out[lang] = f" {text} "
    return out


def identify(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def make():
        model = Identifier(shared.value)
        return lambda doc_id, text: ((doc_id, *model(text)),)

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(columns, make, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is held out as well, and teaches nothing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _in_passes(docs: DataFrame, labelled: DataFrame, passes: DataFrame, n: int, sample_docs: int, sample_chars: int) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from the lowest rates of all passes."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    rows = kept(docs.select(F.monotonically_increasing_id().alias("key"), *columns), "texts")
    found = []
    for i in range(n):
        some = labelled.join(F.broadcast(passes.where(F.col("pass") == i)), "lang", "left_semi")
        shared = docs.sparkSession.sparkContext.broadcast(learn(some, F.lit(True), sample_docs, sample_chars))

        def make(shared=shared):
            model = Identifier(shared.value)
            return lambda key, text: ((key, rate, lang) for rate, lang in model.lowest(text))

        found.append(kept(map_rows(rows.select("key", "text"), make, "key long, rate double, lang string"), "rates"))
        shared.destroy()
    each = reduce(DataFrame.unionAll, found).groupBy("key").agg(F.collect_list(F.struct("rate", "lang")).alias("all"))
    each = each.select(F.col("key").alias("of"), F.slice(F.array_sort("all"), 1, 2).alias("rates"))
    best, rest = F.col("rates")[0]["rate"], F.coalesce(F.get("rates", F.lit(1))["rate"], 2 * F.col("rates")[0]["rate"])
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - best / rest)), 6)
    return rows.join(each, F.col("key") == F.col("of"), "left").select(
        "doc_id",
        F.coalesce(F.col("rates")[0]["lang"], F.lit("und")).alias("lang_pred"),
        F.when(F.col("of").isNull(), 0.0).otherwise(score).alias("score"),
    )


def predict(docs: DataFrame, sample_docs: int = 120, sample_chars: int = 60_000, pass_langs: int = 10) -> DataFrame:
    """Learn from the rows that are not held out and predict every row."""
    lang = F.col("lang").cast("string").alias("lang")
    labelled = docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "text", lang)
    langs = kept(labelled.select("lang").distinct(), "languages")
    n = -(-langs.count() // pass_langs)
    if n > 1:
        # One row a label.
        place = (F.row_number().over(Window.orderBy("lang")) - 1) / pass_langs
        passes = kept(langs.select("lang", F.floor(place).alias("pass")), "passes")
        found = _in_passes(docs, labelled, passes, n, sample_docs, sample_chars)
    else:
        found = identify(docs, learn(labelled, F.lit(True), sample_docs, sample_chars))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
