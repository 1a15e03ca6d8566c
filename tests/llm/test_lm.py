import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from glyphmill.llm import lm


def corpus():
    rng = random.Random(4)
    common, rows = ["the", "of", "and", "Word"], []
    for i in range(60):
        rows.append((i, " ".join(rng.choice(common) if rng.random() < 0.7 else f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 90)))))
    return rows + [(100, None), (101, ""), (None, "the of"), (7, "the of"), (102, "x " * 3000)]


def plain_step(net, x, h):
    """One word after the state h [lane, unit]: the gates written out."""
    k, sigmoid = lm.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    a, g = net.e[x], h @ net.u
    z, r = sigmoid(a[:, :k] + g[:, :k]), sigmoid(a[:, k : 2 * k] + g[:, k : 2 * k])
    n = np.tanh(a[:, 2 * k :] + r * g[:, 2 * k :])
    return (1 - z) * n + z * h


def words(text):
    return (text or "").encode().lower().split() + [b"\n"]


@pytest.mark.parametrize("heavy", [3, 10_000])
def test_counts_and_scores(spark, heavy):
    rows = corpus()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    seen = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(seen.values()), len(seen)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "'x' AS score").repartition(3)
    out = lm.score(df, heavy=heavy).collect()
    want = sorted((str(i), len(words(t)), sum(w in seen for w in words(t)), held(i)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.held_out) for r in out) == want
    base = sorted((str(i), sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows)
    got = sorted((str(r.doc_id), r.base_score) for r in out)
    assert [g[0] for g in got] == [b[0] for b in base]
    assert np.allclose([g[1] for g in got], [b[1] for b in base])
    assert {r.train_tokens for r in out} == {n}
    assert all(r.score < 0 for r in out)
    total = lambda k: sum(r[k] for r in out if r.held_out)
    assert total("score") > 1.3 * total("base_score")


def test_distribution_and_stepwise():
    counts = np.array([50.0, 30, 20, 9, 3])
    net = lm.Network.start(counts, 40.0)
    h = np.random.default_rng(0).normal(0, 1, (1, lm.HIDDEN)).astype(np.float32)
    y = np.array([*range(5), lm.VOCAB])
    p = np.exp(net.log_probs(np.repeat(h, len(y), 0), y))
    assert abs(p.sum() - 1) < 1e-5
    rng = np.random.default_rng(2)
    docs = [rng.choice([0, 1, 2, 3, 4, lm.VOCAB], n).astype(np.int16) for n in (1, 70, 33, 5, 200)]
    for d, got in zip(docs, lm.score_documents(net, docs, lanes=2, window=8)):
        h, want = np.zeros((1, lm.HIDDEN), np.float32), 0.0
        for w in d:
            want += float(net.log_probs(h, np.array([int(w)]))[0])
            h = plain_step(net, np.array([int(w)]), h)
        assert abs(want - got) < 1e-3 * abs(want)


def test_gradient():
    rng = np.random.default_rng(1)
    net = lm.Network(lm.Network.start(np.arange(300.0, 0, -1), 50.0).vector.astype(np.float64))
    xs, m = rng.choice([*range(300), lm.VOCAB], (5, 3)), np.ones((5, 3), bool)
    m[3:, 1] = False

    def loss(v):
        q, h, total = lm.Network(v), np.zeros((3, lm.HIDDEN)), 0.0
        for x, k in zip(xs, m):
            total -= (q.log_probs(h, x) * k).sum()
            h = plain_step(q, x, h)
        return total / m.sum()

    g = net.gradient(xs, xs, np.zeros((3, lm.HIDDEN)), m)[0].vector
    for j in rng.choice(np.flatnonzero(np.abs(g) > 1e-4), 20):
        d = np.zeros_like(g)
        d[j] = 1e-5
        assert abs((loss(net.vector + d) - loss(net.vector - d)) / 2e-5 - g[j]) < 1e-6


def test_trains_on_every_token(spark):
    rows = corpus()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    df = spark.createDataFrame([(k, i, held(i), t) for k, (i, t) in enumerate(rows)], "uid long, doc_id long, held_out boolean, text string").repartition(3)
    counts = lm.Counts(lm._counted(df), 10_000)
    place = {int(h): k for k, h in enumerate(counts.h[: counts.vocab])}
    encoded = lm._encoded(df, counts)
    got = {r.uid: tuple(np.frombuffer(r.words, np.int16)) for r in encoded.collect()}
    assert got == {k: tuple(place.get(lm.word_hash(w), lm.VOCAB) for w in words(t)) for k, (_, t) in enumerate(rows)}


def test_state_is_carried_to_the_end(monkeypatch):
    monkeypatch.setattr(lm, "LANES", 2)
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 300, n).astype(np.int16) for n in (1, 130, 24, 70, 49)]
    net = lm.Network.start(np.arange(300.0, 0, -1), 50.0)
    seen, whole = [], lm.Network.gradient

    def spy(self, xs, ys, h, mask, fresh):
        seen.append((xs, h, mask, fresh))
        return whole(self, xs, ys, h, mask, fresh)

    monkeypatch.setattr(lm.Network, "gradient", spy)
    lm.train_shard(net, docs, rate=0.0)  # the network stays, so states can be followed
    assert sum(int(m.sum()) for *_, m, _ in seen) == sum(map(len, docs))
    got = []
    for lane in range(2):
        h = np.zeros((1, lm.HIDDEN), np.float32)
        for xs, before, mask, fresh in seen:
            if lane < xs.shape[1]:
                assert np.allclose(before[lane], h[0], atol=1e-5)
                for x, m, new in zip(xs[:, lane], mask[:, lane], fresh[:, lane]):
                    if new:
                        h = np.zeros_like(h)
                        got.append([])
                    if m:
                        got[-1].append(int(x))
                    h = plain_step(net, np.array([x]), h)
    assert sorted(got) == sorted(d.tolist() for d in docs)


def test_gradient_stops_at_a_document_start():
    rng = np.random.default_rng(6)
    net = lm.Network(lm.Network.start(np.arange(300.0, 0, -1), 50.0).vector.astype(np.float64))
    xs, h = rng.integers(0, 300, (7, 1)), rng.normal(0, 1, (1, lm.HIDDEN))
    mask, fresh = np.ones((7, 1), bool), np.zeros((7, 1), bool)
    fresh[4] = True
    both = net.gradient(xs, xs, h, mask, fresh)[0].vector
    parts = [net.gradient(xs[:4], xs[:4], h, mask[:4])[0].vector, net.gradient(xs[4:], xs[4:], np.zeros_like(h), mask[4:])[0].vector]
    assert np.allclose(both, (4 * parts[0] + 3 * parts[1]) / 7, atol=1e-9)


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_very_long_texts_take_a_window_of_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    net = lm.Network.start(np.arange(900.0, 0, -1), 50.0)
    docs = [rng.integers(0, 900, n).astype(np.int16) for n in (60_000, *[40] * 600)]
    tracemalloc.start()
    out = lm.score_documents(net, docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and (out < 0).all()
