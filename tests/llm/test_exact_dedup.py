import hashlib
import random
from collections import Counter

from glyphmill.llm import exact_dedup as X
from glyphmill.llm.suffix_array import suffix_array


def brute(rows, width):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for (i, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for k in range(len(r) - width + 1):
            if seen[r[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((i, len(r), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.choice([38, 45, 60, 90])) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, 40)
            parts += [p[a : len(p) - rng.randint(0, 40)], text(rng.randint(0, 40))]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[0][1]), (101, rows[1][1] + " tail"), (102, None), (103, ""), (104, "x" * 700), (105, "ab" * 300), (105, "short")]
    return rows


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(800):
        t = [rng.randrange(rng.choice([1, 2, 3, 26])) for _ in range(rng.randint(0, 30))]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS k1").repartition(3)
    want = brute(rows, 200)
    # 3: nearly every anchor goes through the further rounds; 2: most keys are hot; 7: a map too full to tell
    for pieces, least, bits in ((256, 64, 30), (3, 2, 7)):
        monkeypatch.setattr(X, "PIECES", pieces)
        monkeypatch.setattr(X, "MOST_BITS", bits)
        monkeypatch.setattr("glyphmill.llm._common.HOT_LEAST", least)
        got = sorted((tuple(r) for r in X.remove_repeats(df).collect()), key=str)
        assert got == want


def test_long_texts_are_cut(monkeypatch):
    rng = random.Random(2)
    raw = bytes(rng.choice(b"abcdefgh") for _ in range(30_000))
    whole = X.runs(raw, X.np.array([len(raw)]))
    windows = {}
    for h, p, a, b in zip(*(x.tolist() for x in whole)):
        windows |= {s: (h, p) for s in range(a, b + 1)}
    assert sorted(windows) == list(range(len(raw) - 199))


def test_empty(spark):
    assert X.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
