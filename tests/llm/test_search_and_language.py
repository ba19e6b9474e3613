"""Periodic runs, ranked search and language-model scores against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lexical, lmscore, periodic, queries

from .helpers import awkward_rows, empty, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


# 11 Periodic runs


def plain_runs(x, least=12):
    """Every maximal stretch with its least period, by trying all periods."""
    n, found = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(i, j) + 1
    return sorted(((a, b, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng, n):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return [0] * n
    if kind == 2:
        p = rng.randrange(1, max(2, n // 3))
        x = ([rng.randrange(3) for _ in range(p)] * (n // p + 1))[:n]
        if n:
            x[rng.randrange(n)] = 9
        return x
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    x = []
    while len(x) < n:
        x += [rng.randrange(3) for _ in range(rng.randrange(1, 5))] * rng.randrange(1, 8)
        if rng.random() < 0.5:
            x += x[-rng.randrange(1, len(x) + 1) :]
    return x[:n]


@pytest.mark.parametrize("least", [2, 3, 5, 12, 20])
def test_all_runs(least):
    rng = random.Random(least)
    find = periodic.Finder(least)
    for _ in range(60):
        texts = [repetitive(rng, rng.randrange(90)) for _ in range(5)]
        got = find.of_many([np.array(x, np.int64) for x in texts])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(x, least) for x in texts]


def test_wavelet_tree_finds_successors():
    rng = random.Random(2)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.sample(range(n), n)
        tree = periodic.Wavelet(np.array(values))
        for _ in range(50):
            lo = rng.randrange(n)
            hi, x = rng.randint(lo + 1, n), rng.randint(0, n)
            some = sorted(values[lo:hi])
            below = tree.below(np.array([lo]), np.array([hi]), np.array([x]))[0]
            assert below == sum(v < x for v in some)
            if below < len(some):
                assert tree.nth(np.array([lo]), np.array([hi]), np.array([below]))[0] == some[below]


def plain_digest(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for a, b, q in runs for i in range(a + q, b)}
    best = min(((b - a, a, q) for a, b, q in runs), key=lambda r: (-r[0], r[1], r[2]), default=None)
    longest = (best[1], best[0], best[2], 1000 * best[0] // best[2]) if best else (None,) * 4
    said = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *longest, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_digest_of_runs(spark):
    rng = random.Random(4)
    rows = [r for r in awkward_rows() if len(r[1] or "") < 20_000]
    rows += [(1000 + i, " ".join(f"w{x}" for x in repetitive(rng, rng.randrange(200))), "en", "s", None) for i in range(60)]
    rows += [(2000 + i, prose(rng, 150), "en", "s", None) for i in range(60)]
    out = periodic.digest(table(spark, rows)).collect()
    assert Counter(map(tuple, out)) == Counter(plain_digest(r[0], r[1]) for r in rows)
    assert periodic.digest(empty(spark)).collect() == []


def test_runs_and_texts(spark):
    (row,) = periodic.find_runs(table(spark, [(1, "x " + "a b c " * 5 + "y", None, None, None)]), texts=True).collect()
    assert [tuple(r) for r in row["runs"]] == [(1, 15, 3)]
    assert row["collapsed"] == "x a b c y"


def test_a_long_text_of_one_word(spark):
    (row,) = periodic.find_runs(table(spark, [(1, "a " * 300_000, None, None, None)])).collect()
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (1, 0, 300_000, 1)


# 12 Ranked search


def plain_search(docs, items, k=10):
    counted = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs if t is not None]
    counted = [(i, c) for i, c in counted if c]
    total = sum(c.total() for _, c in counted)
    having = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(TERM.findall(lower(t or "")))
    out = []
    for item, some in wanted.items():
        scores = []
        for doc, c in counted:
            m = 100 - 90 + (90 * c.total() * len(counted)) // total
            score = 0
            for t in some & c.keys():
                w = math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * having[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:k])]
    return out


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "mine", 1) for r in rows], "item_id long, text string, score string, rank int")


@pytest.mark.parametrize("pass_bytes", [8 << 20, 200])
@pytest.mark.parametrize("tiles", [(256, 256, 4096), (3, 7, 5)])
def test_search(spark, monkeypatch, pass_bytes, tiles):
    for name, value in zip(("_ITEM_TILE", "_DOC_TILE", "_TERM_TILE"), tiles, strict=True):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(6)
    rows = awkward_rows()
    items = [(i, prose(rng, rng.randint(1, 40))) for i in range(20)]
    items += [(20, None), (21, ""), (22, "no such term"), (None, "w1 w2"), (3, "w7"), (3, "w7"), (23, "ÜNÏCODE 😀 x don't"), (24, "w1 " * 50)]
    out = lexical.search(table(spark, rows), items_of(spark, items), pass_bytes=pass_bytes).collect()
    assert Counter(map(tuple, out)) == Counter(plain_search([(r[0], r[1]) for r in rows], items))


def test_tied_documents_come_by_id(spark):
    rows = [(i, "same words here" if i % 3 else "other words", None, None, None) for i in random.Random(1).sample(range(900), 900)]
    out = lexical.search(table(spark, rows).repartition(7), items_of(spark, [(1, "same here")])).collect()
    assert [(r["rank"], r["doc_id"]) for r in sorted(out)] == list(enumerate([i for i in range(900) if i % 3][:10], 1))


def test_nothing_to_search(spark):
    some = items_of(spark, [(1, "w1")])
    assert lexical.search(empty(spark), some).collect() == []
    assert lexical.search(table(spark, awkward_rows()), items_of(spark, [])).collect() == []


def test_partial_sums_are_exact():
    # Weights and impacts so large that a tile holds few terms.
    scorer = lexical.Scorer([list(range(5000))], {i: 20_000_000 + i for i in range(5000)}, 10, 1000, 3)
    assert all(m.shape[1] * m.max() * 1_000_000 < 1 << 53 for _, _, parts in scorer.tiles for _, m in parts)
    places = np.arange(5000)
    scorer.add(np.array([4]), np.array([False]), np.array([5000]), np.array([5000]), places, np.full(5000, 1000))
    impact = (10**9 * 1000) // (1000 * 1000 + 8 * (10 + 90 * 5000 * 10 // 1000))
    assert scorer.best.tolist() == [[0, sum(20_000_000 + i for i in range(5000)) * impact, 0, 4]]


# 13 Language-model scores

SMALL = replace(lmscore.Shape(), single=20, clusters=6, seed_windows=300, seed_steps=120, train_every=2)


def plain_base(rows):
    words = [(i, [*(lower(w) for w in WORD.findall(t or "")), None]) for i, t in rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for (_, some), h in zip(words, held, strict=True) if not h for w in some)
    n, v = counts.total(), len(counts)
    for (i, some), h in zip(words, held, strict=True):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in some)
        yield (i, h, len(some), sum(counts[w] > 0 for w in some), n, round(base, 6))


def test_base_scores(spark):
    rows = awkward_rows()
    out = lmscore.score(table(spark, rows), queries.piece_path(), SMALL).collect()
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in out)
    got = Counter((*r[:5], round(r["base_score"], 6)) for r in out)
    assert got == Counter(plain_base([(r[0], r[1]) for r in rows]))
    again = lmscore.score(table(spark, rows), queries.piece_path(), SMALL)
    assert Counter(again.collect()) == Counter(out)


def test_no_texts_to_score(spark):
    assert lmscore.score(empty(spark), queries.piece_path(), SMALL).collect() == []
    alone = next(i for i in range(100) if lmscore.is_held_out(i))
    (row,) = lmscore.score(table(spark, [(alone, "a b", None, None, None)]), queries.piece_path(), SMALL).collect()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (True, 3, 0, 0)
    assert math.isfinite(row["score"])


def test_probabilities_sum_to_one():
    counts = np.random.default_rng(1).integers(0, 50, 200)
    windows = np.random.default_rng(2).integers(0, 200, (40, SMALL.context + 1))
    model = lmscore.Model(counts, lmscore.classes_of(counts, windows, SMALL), SMALL)
    lmscore.fit_start(model, windows)
    key, n = np.unique(windows[:, 1:].ravel() * SMALL.classes + model.classes[windows[:, :-1].ravel()], return_counts=True)
    model.set_shares(counts, np.stack((key // SMALL.classes, key % SMALL.classes, n), 1))
    model.ready()
    ids = np.repeat(windows[:1, :-1], 200, axis=0)
    each = model.log10(ids, np.repeat(np.arange(200)[:, None], SMALL.context, axis=1), 0)
    # Shares are smoothed by counts of other texts here, so a class sums to one only about.
    assert np.allclose((10.0**each).sum(axis=0), 1, atol=0.02)


def test_each_id_is_scored_once_and_sees_only_what_is_before():
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 50, 100)
    model = lmscore.Model(counts, np.arange(100) % SMALL.classes, SMALL)
    model.ready()
    t, step = SMALL.context, SMALL.step
    for length in (1, 2, t - 1, t, t + 1, t + step, 3 * t + 5):
        text = np.append(rng.integers(0, 99, length), 99)
        got = lmscore.score_block(model, text, np.array([0, length]))
        total = 0.0
        for i in range(length):
            # The window in which place i is new.
            begin = 0 if i < t else ((i - t) // step + 1) * step
            window = np.full(t, 7)
            window[: i - begin + 1] = text[begin : i + 1]
            total += model.log10(window[None], np.array([[text[i + 1]] * t]), 0)[0, i - begin]
        assert got[0] == pytest.approx(total, rel=1e-4)


def test_every_id_is_learnt(spark):
    """A round moves the embedding of each id of a long text, wherever it stands, and of none in held-out texts only."""
    words = [f"{a}{b}{c}{d}" for a in "bdfgklm" for b in "aeiou" for c in "nprstvz" for d in "aeiou"]
    learnt, held = (next(i for i in range(100) if lmscore.is_held_out(i) == k) for k in (False, True))
    shape = replace(SMALL, train_every=32)
    rows = [(learnt, " ".join(words), "x", "s", None), (held, "\u4e16\u754c", "x", "s", None)]
    blocks = lmscore._blocks(table(spark, rows), queries.piece_path(), shape, "doc_id", "text")
    pieces = lmscore.Pieces(queries.piece_path())
    model = lmscore.Model(np.ones(pieces.end + 1, np.int64), np.arange(pieces.end + 1) % shape.classes, shape)
    before = model.w["tokens"].copy()
    lmscore._round(blocks, model, 1e-2)
    moved = set(np.flatnonzero((model.w["tokens"] != before).any(axis=1)).tolist())
    assert moved == {pieces.end, *(i for word in pieces.of([w.encode() for w in words]) for i in word)}


def test_windows_have_each_id_as_a_target_once(spark):
    rng = np.random.default_rng(4)
    t = SMALL.context
    lengths = np.array([1, 2, t - 1, t, t + 1, 2 * t, 7 * t + 5])
    ends = np.cumsum(lengths)
    sequence = rng.permutation(ends[-1] + 1)
    for every in (1, 2, 32):
        shape = replace(SMALL, train_every=every)
        windows = lmscore.cut_windows(sequence, *lmscore.window_bounds(ends, shape), shape)
        targets = windows[:, 1:]
        assert sorted(targets[targets >= 0].tolist()) == sorted(sequence[1:].tolist())
        assert len(windows) == sum(-(-n // t) for n in lengths)


def test_neighbours_are_those_of_all_training_texts(spark):
    rng = random.Random(8)
    words = ["the", "a", "of", *(f"{a}{b}{c}" for a in "bdfgklmnp" for b in "aeiou" for c in "nprst")]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([3, 60, 700]))), "x", "s", None) for i in range(40)]
    shape = replace(SMALL, seed_windows=5)
    blocks = lmscore._blocks(table(spark, rows), queries.piece_path(), shape, "doc_id", "text")
    pieces = lmscore.Pieces(queries.piece_path())
    texts = [[i for w in pieces.of([w.encode() for w in r[1].split()]) for i in w] for r in rows if not lmscore.is_held_out(r[0])]
    count = Counter(i for text in texts for i in text)
    counts = np.array([count[i] for i in range(pieces.end + 1)])
    of = lmscore.commonest(counts, shape)
    beside, seed = lmscore._start(blocks, of, shape)
    want = np.zeros_like(beside)
    for text in texts:
        for left, right in itertools.pairwise([pieces.end, *text, pieces.end]):
            if of[right] == shape.single:
                want[right, of[left]] += 1
            if of[left] == shape.single:
                want[left, shape.single + 1 + of[right]] += 1
    assert (beside == want).all() and len(seed) == 5


def test_gradients():
    rng = np.random.default_rng(5)
    shape = replace(SMALL, width=4, context=6, single=5, clusters=2)
    counts = rng.integers(1, 9, 12)
    model = lmscore.Model(counts, rng.integers(0, 7, 12), shape)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    windows = rng.integers(0, 12, (3, 7))
    windows[0, 5:] = -1
    dense, touched, rows, _ = model.gradients(windows)
    for name in ("qkv", "out", "head", "places", "tokens"):
        for _ in range(5):
            at = tuple(int(rng.integers(0, n)) for n in model.w[name].shape)
            if name == "tokens" and at[0] not in touched.tolist():
                continue
            want = rows[touched.tolist().index(at[0]), at[1]] if name == "tokens" else dense[name][at]
            losses = []
            for e in (1e-4, -1e-4):
                model.w[name][at] += e
                losses.append(model.gradients(windows)[3])
                model.w[name][at] -= e
            assert (losses[0] - losses[1]) / 2e-4 == pytest.approx(want, abs=2e-4)


def test_gradients_of_classes_in_groups():
    """Two softmaxes, over groups and over a group's classes, and no more columns for an id than these have."""
    rng = np.random.default_rng(6)
    shape = replace(SMALL, width=4, context=6, single=5, clusters=4, group=3)
    classes = rng.integers(0, 9, 14)
    pairs = np.stack((np.repeat(np.arange(14), 9), np.tile(np.arange(9), 14), rng.integers(1, 30, 126)), 1)
    groups = lmscore.groups_of(pairs, classes, shape)
    assert np.bincount(groups).max() <= 3 and len(groups) == 9
    model = lmscore.Model(rng.integers(1, 9, 14), classes, shape, groups=groups)
    assert all(len(side) <= model.groups + 3 for side in model.sides)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    windows = rng.integers(0, 14, (3, 7))
    windows[1, 3:] = -1
    dense = model.gradients(windows)[0]
    for name, all_of in dense.items():
        for at in map(tuple, rng.integers(0, all_of.shape, (8, all_of.ndim))):
            if name == "head" and model.unused[at[1]]:
                continue
            losses = []
            for e in (1e-4, -1e-4):
                model.w[name][at] += e
                losses.append(model.gradients(windows)[3])
                model.w[name][at] -= e
            assert (losses[0] - losses[1]) / 2e-4 == pytest.approx(all_of[at], abs=2e-4)


def test_words_of_a_block_and_their_pieces(monkeypatch):
    monkeypatch.setattr(lmscore, "_REMEMBERED", 5)
    pieces = lmscore.Pieces(queries.piece_path())
    blocks = [[b"", b" ", b"A b\x0b\x0cC\x1dc a\x85", b"\xff\xc3 \xe2\x82"], ["Über ein Wort a b".encode()], [b""], [b" b  x y\n\nz a b "]]
    for texts in blocks * 2:
        sizes, places, words = lmscore._words(texts)
        lists = [[b"", *text.lower().split()] for text in texts]
        assert sizes.tolist() == [len(x) for x in lists]
        words = words.to_pylist()
        assert [words[i] for i in places] == [w for x in lists for w in x]
        assert len(set(words)) == len(words)
        ids, many = pieces.of_distinct(pa.array(words[1:], pa.binary()))
        want = pieces.of(words[1:])
        assert many.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        assert len(pieces.known) <= 5


def test_word_counts_meet_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "_BUCKET_WORDS", 40)
    monkeypatch.setattr(lmscore, "train", lambda blocks, end, shape: lmscore.Model(np.ones(end + 1, np.int64), np.arange(end + 1) % shape.classes, shape))
    rng = random.Random(10)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(40)), "x", "s", None) for i in range(60)]
    out = lmscore.score(table(spark, rows).repartition(3), queries.piece_path(), SMALL).collect()
    got = Counter((*r[:5], round(r["base_score"], 6)) for r in out)
    assert got == Counter(plain_base([(r[0], r[1]) for r in rows]))


def test_the_model_learns_from_what_came_before(spark):
    """Texts in one of two made-up languages: held-out texts of the right words score above the same ids out of order."""
    rng = random.Random(9)
    halves = [[f"{a}{b}" for a in "abcdef" for b in "aeiou"], [f"{a}{b}" for a in "klmnop" for b in "aeiou"]]
    rows = [(i, " ".join(rng.choice(halves[i % 2]) for _ in range(60)), "x", "s", None) for i in range(400)]
    mixed = [(1000 + i, " ".join(rng.choice(halves[j % 2]) for j in range(60)), "x", "s", None) for i in range(60)]
    mixed = [r for r in mixed if lmscore.is_held_out(r[0])]
    out = lmscore.score(table(spark, rows + mixed), queries.piece_path(), replace(SMALL, seed_steps=400)).where(F.col("held_out")).collect()
    rate = {k: np.mean([r["score"] / r["n_tokens"] for r in out if (r["doc_id"] >= 1000) == k]) for k in (True, False)}
    assert rate[False] > rate[True] + 0.1
