import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from glyphmill.llm import pack as P


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.default_tokenizer())


TEXTS = ["", "a  b", "a   b", " x", " x ", "x\n y", "x \ny", "x\n \ny", "a<|endoftext|>b c", "don't you're  'tis", "x\n", "x \n ", "日本 語   x　 y", "a\tb \t c", "\x1c \x1d x", "x  y  ", "Wörter und Sätze, 123 x1"]


def test_ids_equal_the_tokenizers(tokenizer):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab é\n 1.' ") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    encode = P.Encoder(P.default_tokenizer())
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert encode(text) == np.array(want.ids, "<u4").tobytes(), repr(text)


def check_plan(counts, capacity):
    plan = P.Plan(counts, capacity, groups=8, small=capacity // 8)
    places, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, sequence, offset in plan.runs:
        ranks[length] += range(rank, rank + n)
        for i in range(n):
            places[sequence + i].append((offset, length))
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in counts.items()}
    return len(places)


def test_plans():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([16, 100, 1024])
        counts = dict(Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 400))))
        n = check_plan(counts, capacity)
        least = -(-sum(x * c for x, c in counts.items()) // capacity)
        assert n <= max(least + 2, 1.25 * least)
    assert check_plan({600: 10, 424: 10}, 1024) == 10
    assert check_plan({}, 1024) == 0


def test_pack(spark, tokenizer):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "of", "nation", "é!", "x\n"]) for _ in range(rng.choice([0, 3, 50, 400, 900, 2500])))) for i in range(60)]
    rows += [(None, "no id"), (7, rows[7][1]), (100, None)] + [(200 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS piece", "'x' AS length").repartition(4)
    out = P.pack(df, keep_ids=True).collect()
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(str(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), ids[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in out) == sorted(want)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
    assert P.pack(df.limit(0)).collect() == []
