import math
import zlib
from collections import Counter

import numpy as np
import pytest

from provlake.llm import pitman_yor as py


def lowered(words):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words] + [None]


def test_base_scores_equal_plain_counting(spark, odd_docs, odd_rows, split_words):
    docs = [(r[0], lowered(split_words(r[1]))) for r in odd_rows]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(t for d, ts in docs if not held(d) for t in ts)
    n, v = sum(c.values()), len(c)
    want = sorted(((d, held(d), len(ts), sum(t in c for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)) for d, ts in docs), key=str)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in py.score_documents(odd_docs).collect()), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(g[5] == pytest.approx(w[5], abs=1e-6) for g, w in zip(got, want, strict=True))


def test_probabilities_sum_to_one():
    """Over all spellings of bounded length, from restaurants seated with random customers."""
    rng = np.random.default_rng(2)
    model = py.Spelling()
    for _ in range(3):
        model.resample({int(k): int(rng.integers(1, 50)) for k in rng.choice(py.SLOTS * 256, 4000, replace=False)})
    for p in model.levels:
        assert np.allclose(p.sum(axis=1), 1)


def test_seating_follows_the_process():
    n, a, d = 400, 3.0, 0.5
    keys = np.arange(4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = py.seat(np.full(4000, float(n)), np.full(4000, a), d, keys, 1)
    rng = np.random.default_rng(1)
    want = np.ones(4000)
    for i in range(1, n):
        want += rng.random(4000) < a / (a + i - d * want)
    assert got.mean() == pytest.approx(want.mean(), rel=0.03) and got.std() == pytest.approx(want.std(), rel=0.15)
    assert (py.seat(np.zeros(3), np.ones(3), d, keys[:3], 1) == 0).all() and (py.seat(np.ones(3), np.ones(3), d, keys[:3], 1) == 1).all()


def test_held_out_texts_are_better_predicted_than_by_the_base(spark):
    rows = py.op8_pitman_yor(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out and r.n_tokens > 20]
    assert len(rows) == 1000 and sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) / len(held) > 0.75
    again = {r.doc_id: r.score for r in py.op8_pitman_yor(spark, "/root/testdata/sf0.01").collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in rows)


def test_empty_table(spark, no_docs):
    assert py.score_documents(no_docs).count() == 0


def test_word_order_counts(spark):
    """Held-out texts in the training texts' word order score above the same words shuffled, and repeated pairs are learned."""
    import random

    rnd = random.Random(1)
    follow = {f"w{i}": [f"w{rnd.randrange(200)}" for _ in range(2)] for i in range(200)}

    def text():
        at, out = "w0", []
        for _ in range(100):
            at = rnd.choice(follow[at])
            out.append(at)
        return out

    texts = [text() for _ in range(300)]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    ids = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2][:60]
    held = [text() for _ in ids[:30]]
    rows += [(i, " ".join(x)) for i, x in zip(ids, held, strict=False)] + [(i, " ".join(rnd.sample(x, len(x)))) for i, x in zip(ids[30:], held, strict=True)]
    got = {r.doc_id: r for r in py.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    pairs = [(got[i], got[j]) for i, j in zip(ids[:30], ids[30:], strict=True)]
    assert all(a.held_out and b.held_out and a.base_score == pytest.approx(b.base_score) and a.score > b.score + 50 for a, b in pairs)


def test_pairs_are_counted_over_blocks(spark, monkeypatch):
    """The same scores whether a corpus is one block or many."""
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 30}" for k in range(60))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r.score for r in py.score_documents(df.coalesce(1)).collect()}
    many = {r.doc_id: r.score for r in py.score_documents(df.repartition(5)).collect()}
    assert all(many[i] == pytest.approx(s, rel=1e-6) for i, s in one.items())


def test_numbers_come_back_from_their_steps():
    numbers = np.array([0, py.ONCE, 3, 4, py.NEVER, 900, py.ONCE, 901])
    assert (py.unstepped(py.stepped(numbers)) == numbers).all() and len(py.unstepped(py.stepped(numbers[:0]))) == 0
    assert (np.cumsum(py.steps(np.array([2, 5, 5, 9]))) == [2, 5, 5, 9]).all()


def test_what_is_saved_between_steps_stays_small(spark):
    """Blocks, lists, pairs and seatings: 2.5 times the documents' file (4.4 with rows in place of packed columns)."""
    import os

    from provlake.llm.common import shared_folder

    def size(folder):
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder.removeprefix("file:")) for f in files)

    path = "/root/testdata/sf0.01/documents.parquet"
    before = size(shared_folder(spark))
    assert py.score_documents(spark.read.parquet(path)).count() == 1000
    assert size(shared_folder(spark)) - before <= 3 * os.path.getsize(path)
