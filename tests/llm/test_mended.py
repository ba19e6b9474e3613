"""Bounded passes, column names in any letter case, the mix's SQL on small targets, rules that don't turn with size."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, mixing, pii, quality, queries

from .helpers import awkward_rows, prose, table
from .test_operators import plain_language


def test_equal_items_are_one(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item)] * 1000 + [(i, f"{item} {i}") for i in range(2, 102)] + [(None, None)], "item_id long, text string")
    passes = list(decontam._passes(bench, "item_id", "text", 500))
    assert sum(t for some in passes for _, _, t in some) == 1100
    assert all(sum(len(x[1]) for x in some) < 1500 for some in passes)
    docs = spark.createDataFrame([(7, item), (8, "nothing of it")], "doc_id long, text string")
    found = decontam.search(docs, bench.where("item_id = 1"), pass_bytes=500).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(7, 1)] * 1000
    none = bench.where("text IS NULL")
    assert decontam.search(docs, none).collect() == [] and decontam.clean(docs, none).count() == 2


@pytest.mark.parametrize("name", ["Text", "TEXT"])
def test_columns_in_any_letter_case(spark, name):
    text = prose(random.Random(1), 60)
    docs = spark.createDataFrame([(1, text)], f"doc_id long, {name} string")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert quality.clean(docs).columns == ["doc_id", name]
    assert decontam.clean(docs, bench).columns == ["doc_id", name] and decontam.clean(docs, bench).count() == 0


def test_the_sql_of_the_mix_with_blocks_of_many_words(spark, tmp_path):
    """A large source beside small ones: blocks of several words, and targets of few slots."""
    rows = [(i, "w " * 4000, "big") for i in range(150)] + [(1000 + i, "x " * (i + 1), "mid") for i in range(40)] + [(2000 + i, "y " * 3, "tiny") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    columns = ("doc_id", "size", "source_size", "target", "taken")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/docs/*.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES['op10_mixing']})").fetchall())
    got = sorted(tuple(r) for r in mixing.plan(docs).select(*columns).collect())
    assert sum(r[1] for r in want) > 1 << 18
    assert [(*r[:3], round(r[3], 6), r[4]) for r in got] == [(*r[:3], round(r[3], 6), r[4]) for r in want]


@pytest.mark.parametrize("n", [2, 19, 20, 40])
def test_common_lines_by_share_alone(spark, n):
    """Copies of a shared line in any number of documents are judged alike."""
    rng = random.Random(n)
    line = "Please visit the shop of our partners today."
    rows = [(i, prose(rng, 90, 3000) + "\n" + line, "en", "s", None) for i in range(n)]
    out = quality.assess(table(spark, rows)).collect()
    assert [r["lost_words"] for r in out] == [8] * n and all(r["kept"] for r in out)
    off = quality.assess(table(spark, rows), common_share=1.1).collect()
    assert [r["lost_words"] for r in off] == [0] * n


def test_long_common_lines_if_asked(spark):
    rng = random.Random(5)
    line = " ".join(["word"] * 44 + ["end."])
    rows = [(i, prose(rng, 400, 3000) + "\n" + line, "en", "s", None) for i in range(5)]
    for words, lost in (((3, 40), 0), ((3, None), 45)):
        assert {r["lost_words"] for r in quality.assess(table(spark, rows), common_words=words).collect()} == {lost}


@pytest.mark.parametrize("pass_langs", [1, 2, 3])
def test_languages_in_passes(spark, pass_langs):
    """Passes of few languages give what one pass gives, and a plain version, awkward rows included."""
    rng = random.Random(2)
    letters = ["abcde", "efghi", "aeiou", "klmno", "pqrst"]
    rows = [(i, " ".join("".join(rng.choices(letters[i % 5], k=rng.randint(2, 6))) for _ in range(30)), f"l{i % 5}", "s", None) for i in range(100)]
    docs = table(spark, [*rows, *awkward_rows()]).where(F.coalesce(F.length("text"), F.lit(0)) < 30_000)
    out = langid.predict(docs, sample_docs=5, sample_chars=1500, pass_langs=pass_langs).collect()
    assert Counter((r["doc_id"], r["lang_pred"], r["score"]) for r in out) == plain_language(docs.collect(), 5, 1500)


def test_more_labels_than_one_sample_holds(spark):
    rows = [(i, f"text {'abcdefghij'[i % 10] * 4} number", f"l{i}", "s", None) for i in range(60)]
    out = langid.predict(table(spark, rows), pass_langs=7).collect()
    assert len(out) == 60 and all(r["lang_pred"].startswith("l") for r in out)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("aws_secret_access_key=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
        ("password: hunter2", "hunter2"),
        ('{"db_password": "s3cr3t!x"}', "s3cr3t!x"),
        ("mot de passe : soleil42.", "soleil42"),
        ("Kennwort=geheim123", "geheim123"),
        ("contraseña: luna2024", "luna2024"),
        ("api_key => 'a8f3k2l9d0s7g6h5j4'", "a8f3k2l9d0s7g6h5j4"),
    ],
)
def test_secrets_by_the_name_before_them(text, found):
    assert [(k, text[s:e]) for k, s, e, _ in pii.find_spans(text)] == [("secret", found)]


@pytest.mark.parametrize("text", ["password: please", "the key: the whole idea1", "token: abc", "the password:\nhunter2", "at 10:30 see page2:line40", "secret:AAAAAAAAAAAAAAAA1"])
def test_no_secret_without_a_value(text):
    assert pii.find_spans(text) == []
