import random

import pytest
from pyspark.sql import Row

from glyphmill.llm import near_dedup as N


def _shingles(text, k):
    w = (text or "").encode().lower().split()
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows, k):
    ids = sorted({i for i, _ in rows if i is not None})
    par = {i: i for i in ids}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    sets = [(i, _shingles(t, k)) for i, t in rows]
    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if i is not None and j is not None and s and u and 100 * len(s & u) >= 80 * len(s | u):
                x, y = find(i), find(j)
                par[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i) if i is not None else None) for i, s in sets)


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    rows, n = [], 0
    passage = " ".join(word() for _ in range(60))
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 20, 60, 120]))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n + i, passage + " " + " ".join(word() for _ in range(rng.choice([3, 8, 15, 30])))) for i in range(40)]
    rows += [(900, ""), (901, None), (902, " \t "), (903, "One"), (904, "one"), (905, "x " * 5000), (906, "x " * 5000)]
    return rows


@pytest.mark.parametrize("least", [64, 2])  # 2: most keys are hot
def test_against_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr("glyphmill.llm._common.HOT_LEAST", least)
    rows = corpus()
    df = spark.createDataFrame([Row(doc_id=i, text=t, n_shingles="clash", component_id=0) for i, t in rows]).repartition(3)
    out = N.near_groups(df, shingle=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_groups(empty).collect() == []
    same = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (9, "A B C D E"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in N.near_groups(same).collect())
    assert got == [("5", 1, "5", True), ("5", 1, "5", True), ("9", 1, "5", False), ("None", 0, "None", True), ("None", 1, "5", False)]
    kept = N.keep_one(same.selectExpr("*", "1 AS n", "2 AS kept"))
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["5", "None", "None"]
    assert kept.columns == ["doc_id", "text", "n", "kept"]


def test_ids_of_text_and_ids_with_several_texts(spark):
    rows = [("k3", "a b c d e f"), ("k5", "A b c d e f"), ("k5", "p q r s t u"), ("k9", "P q r s t u"), ("k7", "x y z z y x")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in N.near_groups(df, shingle=4).collect())
    assert got == [("k3", "k3", True), ("k5", "k3", False), ("k5", "k3", False), ("k7", "k7", True), ("k9", "k3", False)]


def test_recall_at_the_threshold():
    """Pairs of a similarity of exactly 0.8: how many meet in enough coordinates."""
    rng = random.Random(8)
    met = 0
    for _ in range(3000):
        s = N.np.array([rng.getrandbits(64) for _ in range(90)], N.np.uint64)
        a, b = N.signature(s[:81]), N.signature(s[9:])  # 72 of 90 in both
        met += int((a == b).sum() >= N.MATCHES)
    assert met >= 2999
