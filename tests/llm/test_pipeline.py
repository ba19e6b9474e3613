"""The pipeline: stages in order, each against what its operator decides on the stage's input, and run() as a whole."""

from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidemark.llm import decontam, mixing  # noqa: E402

from .helpers import awkward_rows, empty, table  # noqa: E402
from .test_operators import WORD, plain_cleaned, plain_common, plain_components, plain_fingerprint, plain_matches, plain_verdict  # noqa: E402


def words(text):
    return len(WORD.findall(text or ""))


def stages(spark, docs, sf_dir):
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.kept(stage(spark, docs, sf_dir), name)
        out.append(docs.collect())
    return out


@pytest.fixture(params=["table", "awkward"])
def results(request, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if request.param == "table" else table(spark, awkward_rows())
    return docs.columns, stages(spark, docs, sf_dir)


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mix_sources", "shard_rows"]


def test_stages_against_brute_force(spark, sf_dir, results):
    columns, (start, good, alone, clean, mixed, sharded) = results
    # Quality: rows whose text passes the rules, without their failing lines.
    common = plain_common([r["text"] for r in start if r["text"] is not None], 0.01, 20)
    want = Counter()
    for r in start:
        if plain_verdict(r["text"] or "", common):
            want[(r["doc_id"], plain_cleaned(r["text"] or "", common)[0])] += 1
    assert Counter((r["doc_id"], r["text"]) for r in good) == want and want
    # Near copies: one of each group.
    groups = defaultdict(list)
    texts = [r["text"] for r in good]
    components = plain_components(list(range(len(good))), [plain_fingerprint(t) for t in texts], texts=texts)
    for r, g in zip(good, components, strict=True):
        groups[g].append((r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    left = Counter((r["doc_id"], r["text"]) for r in alone)
    assert len(alone) == len(groups)
    for members in groups.values():
        least = min(m[:2] for m in members)
        assert sum(left[(None if m[0] else m[1], m[2])] for m in set(members) if m[:2] == least) >= 1
    # Benchmark items: no document that holds one.
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    shingles = {tuple(w[i : i + 5]) for _, t in items for w in [decontam.tokens(t)] for i in range(len(w) - 4)}

    def leaks(text):
        w = decontam.tokens(text or "")
        some = sum(tuple(w[i : i + 5]) in shingles for i in range(len(w) - 4)) >= 4
        return some and bool(plain_matches(text, items))

    assert Counter((r["doc_id"], r["text"]) for r in clean) == Counter((r["doc_id"], r["text"]) for r in alone if not leaks(r["text"]))
    # Mixing: as many words of each document as the plan takes, sources near their targets.
    taken = Counter()
    for r in mixed:
        taken[r["source"]] += words(r["text"])
    sizes = Counter()
    for r in clean:
        sizes[r["source"]] += words(r["text"])
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    for r in mixing.source_targets(df).collect():
        assert abs(taken[r["source"]] - r["target"]) <= max(0.02 * r["target"], 8)
    by_id, limit = Counter(), Counter()
    for r in mixed:
        by_id[r["doc_id"]] += words(r["text"])
    for r in clean:
        limit[r["doc_id"]] += 3 * words(r["text"])
    assert all(n <= limit[k] for k, n in by_id.items())
    # Sharding: the same rows, gapless slots.
    assert Counter((r["doc_id"], r["text"]) for r in sharded) == Counter((r["doc_id"], r["text"]) for r in mixed)
    slots = defaultdict(list)
    for r in sharded:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    inputs = [f"input_{c}" if c in corpus_pipeline.PLACE else c for c in columns]
    assert all(list(r.asDict()) == [*inputs, *corpus_pipeline.PLACE] for r in sharded[:1])
    assert all(r[f"input_{c}"] == "mine" for r in sharded for c in corpus_pipeline.PLACE if c in columns)
    for rows in (good, alone, clean, mixed):
        assert all(list(r.asDict()) == columns for r in rows[:1])


def test_nothing(spark, sf_dir):
    assert stages(spark, empty(spark), sf_dir)[-1] == []


def test_run_is_its_stages(spark, sf_dir):
    a = corpus_pipeline.run(spark, sf_dir).select("doc_id", "shard", "slot", "text_crc32").collect()
    b = stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)[-1]
    assert Counter(map(tuple, a)) == Counter((r["doc_id"], r["shard"], r["slot"], r["text_crc32"]) for r in b) and a
