"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

#: Names that operators use themselves, in any letter case.
CLASHING = ("row", "words", "size", "times", "head", "shard", "slot", "law", "text_crc32", "id", "hash", "_id", "_HASH", "_key", "_again", "_source")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    lines = []
    while words:
        k = rng.randint(8, 20)
        lines.append(" ".join(words[:k]) + ".")
        words = words[k:]
    return "\n".join(lines)


def awkward_rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Rows for SCHEMA, without the clashing columns, which `table` fills."""
    rng = random.Random(seed)
    passage = prose(rng, 70)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randint(1, 200))
        if i % 5 == 0:
            text += "\n" + passage
        if i % 7 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif i % 7 == 1 and rows and rows[-1][1]:
            words = rows[-1][1].split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        rows.append((i, text, "en", f"s{i % 4}"))
    rows += [
        (n, None, None, None),
        (n + 1, "", "en", "s1"),
        (n + 2, " \t\n\v\f\r", None, "s1"),
        (n + 3, prose(rng, 20_000), "en", "s0"),
        (n + 4, "Ünïcode ÉTÉ  \u00a0 x\u3000y 😀 <|endoftext|> don't", "fr", None),
        (None, passage, "en", "s2"),
        (3, passage, "en", "s2"),
        (7, passage + " tail", "en", "s2"),
        (None, None, None, None),
    ]
    rows += [(n + 5, passage, "en", "s3")] * 3
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def table(spark, rows):
    """Rows (doc_id, text, lang, source, n_chars), with `mine` in every other column."""
    return spark.createDataFrame([(*r[:5], *["mine"] * len(CLASHING)) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
