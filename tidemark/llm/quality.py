"""Line-first quality rules: judge every line, remove those that fail, reject documents that lose too much.

A line with words fails if it is

* boilerplate: it holds a phrase of the fixed list, or it is common: in at least `common_share` of all documents with a
  text. The share alone decides, at every size of the table; a line of one document is never common, and `common_docs`
  may ask for more documents than those two. Judged are lines whose number of words is in `common_words` (both ends
  included; None as its end takes lines of any length). Such lines are counted in Spark over the whole table; a table of
  n lines a document has n / `common_share` of them at most, which is what is collected and broadcast. A document that
  would lose over `most_common` of its words to common lines is a copy rather than a page with furniture, so it keeps
  them for deduplication;
* navigation: under 6 words without an end mark, or cut up by separators;
* no sentence: 6 words or more, of which none ends in an end mark, unless the sentence is wrapped: the line or the next
  one with words begins with a lower-case letter;
* noise: over a tenth symbols, or over half of its words without a letter.

A document is rejected if it fails the base rules (under 20 words, or over 30% of its words in 8-word windows that
repeat), if failing lines hold more than `most_lost` of its words, or if fewer than `least_left` words are left.

Defined cases: null text has no words and fails; blank lines are never judged; every row gives a row, whatever its id;
other columns are kept by `clean` and ignored by `assess`; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Set

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Rolling, WordHashes, covered, map_rows, place_of

# Fixed values of the contract: white space, symbols, window, limits.
_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_WINDOW = 8
_LEAST_WORDS = 20
_REPEAT_PERCENT = 30

#: Phrases of page furniture in several languages, lower case.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "accept all cookies",
    "we use cookies",
    "cookie policy",
    "cookie settings",
    "privacy policy",
    "terms of service",
    "terms of use",
    "terms and conditions",
    "click here to",
    "enable javascript",
    "lorem ipsum",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "skip to content",
    "skip to main content",
    "back to top",
    "share on facebook",
    "follow us on",
    "tous droits réservés",
    "accepter les cookies",
    "nous utilisons des cookies",
    "politique de confidentialité",
    "conditions d'utilisation",
    "mentions légales",
    "aller au contenu",
    "activer javascript",
    "abonnez-vous à notre",
    "cliquez ici pour",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "wir verwenden cookies",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "allgemeine geschäftsbedingungen",
    "zum inhalt springen",
    "newsletter abonnieren",
    "aktivieren sie javascript",
    "klicken sie hier",
    "todos los derechos reservados",
    "aceptar cookies",
    "utilizamos cookies",
    "política de privacidad",
    "política de cookies",
    "términos de uso",
    "términos y condiciones",
    "aviso legal",
    "ir al contenido",
    "saltar al contenido",
    "suscríbete a nuestro",
    "haz clic aquí",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_SEPARATORS = frozenset(["|", ">", "»", "›", "•", "·", "/", "-", "–", "—", "::"])
_ENDS = tuple(".!?…:;\"'”’)]。！？।")
_SHORT = 6
#: Lines of so many words may be common; None instead of the second takes any number.
COMMON_WORDS = (3, 40)
_SYMBOL_RUN = re.compile(r"[#*$%&|<>]")
_NO_LETTER = re.compile(r"(?<!\S)(?:[^\w\s]|[\d_])++(?!\S)")


class Measures:
    """The base numbers of texts."""

    def __init__(self):
        self.words, self.roll = WordHashes(5), Rolling(0xD6E8FEB86659FD93)

    def repeat_words(self, words: list[bytes]) -> int:
        if len(words) <= _WINDOW:
            return 0
        windows = self.roll(self.words.of(words), _WINDOW)
        _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
        again = np.flatnonzero(counts[back] > 1)
        return int(covered(again, _WINDOW, len(words)).sum()) if len(again) else 0

    def __call__(self, text: str) -> tuple[int, int, int, int, int, bool]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
        words = text.encode().split()
        seen: set[str] = set()
        dup = 0
        for line in text.split("\n"):
            if line.strip(_SPACES):
                dup += line in seen
                seen.add(line)
        repeat = self.repeat_words(words)
        chars = len(text) - sum(map(text.count, _SPACES))
        failed = len(words) < _LEAST_WORDS or 100 * repeat > _REPEAT_PERCENT * len(words)
        return len(words), chars, sum(map(text.count, _SYMBOLS)), dup, repeat, failed


def line_hash(line: str) -> int:
    """As Spark's xxhash64 of the line without white space around it."""
    h = xxhash.xxh64_intdigest(line.strip(_SPACES).encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def line_fault(line: str, words: list[str], wrapped: bool, common: Set[int]) -> str | None:
    """Why a line is removed; None if it stays. A line without words stays."""
    if not words:
        return None
    if _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    if sum(w in _SEPARATORS for w in words) * 5 >= len(words) and len(words) > 1:
        return "navigation"
    if not words[-1].endswith(_ENDS):
        if len(words) < _SHORT:
            return "navigation"
        if not wrapped and not any(w.endswith(_ENDS) for w in words):
            return "no sentence"
    chars = sum(map(len, words))
    if len(_SYMBOL_RUN.findall(line)) * 10 > chars:
        return "noise"
    if len(_NO_LETTER.findall(line)) * 2 > len(words):
        return "noise"
    if common and line_hash(line) in common:
        return "common"
    return None


def line_faults(lines: list[str], common: Set[int], most_common: float) -> list[str | None]:
    """The fault of every line of a text."""
    words = [x.split() for x in lines]
    out: list[str | None] = [None] * len(lines)
    next_low = False
    for i in reversed(range(len(lines))):
        if w := words[i]:
            low = w[0][0].islower()
            out[i] = line_fault(lines[i], w, low or next_low, common)
            next_low = low
    held = sum(len(w) for w, f in zip(words, out, strict=True) if f == "common")
    if held > most_common * sum(map(len, words)):
        out = [None if f == "common" else f for f in out]
    return out


def clean_text(text: str, common: Set[int] = frozenset(), most_common: float = 0.2) -> tuple[str, int]:
    """The text without its failing lines, and the words these held."""
    lines = text.split("\n")
    faults = line_faults(lines, common, most_common)
    if not any(faults):
        return text, 0
    lost = sum(len(x.encode().split()) for x, f in zip(lines, faults, strict=True) if f)
    return "\n".join(x for x, f in zip(lines, faults, strict=True) if not f), lost


def common_lines(
    docs: DataFrame,
    share: float = 0.01,
    least: int = 2,
    text_col: str = "text",
    n_words: tuple[int, int | None] = COMMON_WORDS,
) -> frozenset[int]:
    """Hashes of lines of `n_words` that are in `share` of the documents with a text or more, and in `least` or more."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    n = texts.count()
    lines = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_SPACES)))
    low, high = n_words[0], n_words[1] or (1 << 31) - 1
    usual = F.filter(lines, lambda x: F.regexp_count(x, F.lit(WORD_PATTERN)).between(low, high))
    each = texts.select(F.explode(F.array_distinct(F.transform(usual, lambda x: F.xxhash64(x)))).alias("line"))
    counted = each.groupBy("line").agg(F.count("*").alias("docs"))
    return frozenset(r["line"] for r in counted.where(F.col("docs") >= max(least, math.ceil(share * n))).select("line").collect())


def verdict(n_words: int, lost: int, base_failed: bool, most_lost: float, least_left: int) -> bool:
    return not base_failed and lost <= most_lost * n_words and n_words - lost >= least_left


def assess(
    docs: DataFrame,
    most_lost: float = 0.5,
    least_left: int = 20,
    common_share: float = 0.01,
    common_docs: int = 2,
    most_common: float = 0.2,
    common_words: tuple[int, int | None] = COMMON_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every row with its measures, base_failed, lost words and verdict."""
    sent = docs.sparkSession.sparkContext.broadcast(common_lines(docs, common_share, common_docs, text_col, common_words))

    def make():
        measures, common = Measures(), sent.value

        def row(doc_id, text):
            m = measures(text)
            _, lost = clean_text(text, common, most_common)
            yield doc_id, *m, verdict(m[0], lost, m[-1], most_lost, least_left), lost

        return row

    columns = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    return map_rows(
        columns,
        make,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, lost_words long",
    )


def clean(
    docs: DataFrame,
    most_lost: float = 0.5,
    least_left: int = 20,
    common_share: float = 0.01,
    common_docs: int = 2,
    most_common: float = 0.2,
    common_words: tuple[int, int | None] = COMMON_WORDS,
    text_col: str = "text",
) -> DataFrame:
    """The documents that are kept, all columns, with failing lines taken out of the text."""
    place = place_of(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(common_lines(docs, common_share, common_docs, text_col, common_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures, common = Measures(), sent.value
        for batch in batches:
            texts, keep = [], []
            for x in batch.column(place):
                text = x.as_py() or ""
                m = measures(text)
                new, lost = clean_text(text, common, most_common)
                keep.append(verdict(m[0], lost, m[-1], most_lost, least_left))
                texts.append(new if keep[-1] else None)
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
