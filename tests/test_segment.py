import random
import re
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import segment, stats, transducer
from glyphmill.operators.segment import Automaton
from glyphmill.operators.vocabulary import Vocabulary, pretty_json
from glyphmill.plans import queries as Q

SPACE, Z, V = ["\x10", "2", "0"], ["\x10", "7", "a"], ["\x10", "7", "6"]
GOLDEN = [  # method, text, entries beyond the hex base, tokens
    ("optimal", "ab", ["a", "b", "ab"], ["ab"]),
    ("greedy", "ab", ["a", "b", "ab"], ["ab"]),
    ("optimal", "ab ab ab", ["a", "b", "ab"], ["ab", *SPACE, "ab", *SPACE, "ab"]),
    ("greedy", "ab ab ab", ["a", "b", "ab"], ["ab", *SPACE, "ab", *SPACE, "ab"]),
    ("optimal", "xyz", ["x", "xy", "yz"], ["x", "yz"]),
    ("greedy", "xyz", ["x", "xy", "yz"], ["xy", *Z]),
    ("optimal", "xyz xyz xyz", ["x", "xy", "yz"], ["x", "yz", *SPACE, "x", "yz", *SPACE, "x", "yz"]),
    ("greedy", "xyz xyz xyz", ["x", "xy", "yz"], ["xy", *Z, *SPACE, "xy", *Z, *SPACE, "xy", *Z]),
    ("optimal", "xyztuv", ["xy", "zt", "uv", "xyztu"], ["xy", "zt", "uv"]),
    ("optimal", "xyztuv", ["x", "y", "z", "t", "u", "xyztu"], ["xyztu", *V]),
]


@pytest.mark.parametrize("method, text, entries, want", GOLDEN)
def test_golden(spark, method, text, entries, want):
    v = Vocabulary.hex(e.encode() for e in entries)
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(getattr(segment, method)(F.col("text"), v).alias("t")).first()["t"]
    assert [bytes(t).decode("latin-1") if method == "optimal" else t for t in got] == want


def plain_ids(vocabulary, data):
    """Dynamic programming over all tokens, longest first."""
    strings = [t.string for t in vocabulary]
    cost, way = [0], [None]
    for n in range(1, len(data) + 1):
        found = [(len(s), 1, i) for i, s in enumerate(strings) if data[:n].endswith(s)]
        b = data[n - 1]
        if data[n - 1 : n] not in vocabulary:
            found.append((1, vocabulary.literal_cost, len(strings) + b))
        found.sort(key=lambda f: -f[0])
        best = min(found, key=lambda f: cost[n - f[0]] + f[1])
        cost.append(cost[n - best[0]] + best[1])
        way.append(best)
    out, n = [], len(data)
    while n:
        out.append(way[n][2])
        n -= way[n][0]
    return out[::-1]


def test_automaton_against_plain_search():
    rng = random.Random(3)
    for _ in range(300):
        base = rng.choice([Vocabulary.hex, Vocabulary.bits])
        v = base(bytes(rng.choice(b"abcx\xc3") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 12)))
        m = Automaton(v)
        data = bytes(rng.choice(b"abcx\xc3z") for _ in range(rng.randint(0, 30)))
        ids = m.ids(data)
        assert ids == plain_ids(v, data)
        assert b"".join(m.string(i) for i in ids) == data
        assert len(m.expand(ids)) == m.cost(data) <= len(data) * v.literal_cost


def test_greedy_and_bytes_against_loops(spark):
    rng = random.Random(4)
    v = Vocabulary.bits([b" ", b"e", "é".encode(), b"the", b"th", b"er", b"."])
    rows = [("".join(rng.choice("the ré.x\n") for _ in range(40)),) for _ in range(20)] + [("",), (None,)]
    df = spark.createDataFrame(rows, "text string")

    def loop(text, longest):
        data, out, i = text.encode(), [], 0
        while i < len(data):
            s = next((data[i : i + n] for n in range(longest, 0, -1) if data[i : i + n] in v), None)
            out += [s] if s else v.fallback_of(data[i])
            i += len(s) if s else 1
        return [t.decode("latin-1") for t in out]

    for r in df.select("text", segment.greedy(F.col("text"), v).alias("g"), segment.by_bytes(F.col("text"), v).alias("b")).collect():
        assert r["g"] == (None if r["text"] is None else loop(r["text"], 3))
        assert r["b"] == (None if r["text"] is None else loop(r["text"], 1))


def test_counts_and_stats(spark):
    v = Vocabulary.hex([b" ", b"the", b"e"])
    rows = [("the then",), ("",), (None,), ("e",)]
    s = stats.SegmentStats(spark.createDataFrame(rows, "text string").repartition(2), v, pairs=True)
    assert {k.decode(): n for k, n in s.tokens.items() if n} == {"the": 2, " ": 1, "e": 1}
    assert s.literals == {b"n": 1} and s.pairs == {(b"the", b" "): 1, (b" ", b"the"): 1, (b"the", b"n"): 1}
    assert s.cost == 4 + 3 and s.raw_bytes == s.scanned_bytes == 9
    j = s.as_json()
    assert j["total_tokens"] == 7 and j["used_tokens"] == 5 and j["ntokens"] == 19
    none = stats.SegmentStats(spark.createDataFrame([], "text string"), v).as_json()
    assert none["total_tokens"] == 0 and none["bytes_per_token"] is None


def test_vocabulary_json():
    v = Vocabulary.bits([b"the", b"\xc3", b"a"])
    saved = v.to_json({"total_tokens": 3}, {"type": "bpe"})
    assert saved["config"] == {"fallback16": False} and [195] in saved["tokens"]
    again = Vocabulary.from_json(saved)
    assert {t.string for t in again} == {t.string for t in v} and again.fallback == "bits"
    assert Vocabulary.from_json({"tokens": ["\x11", "\x12"]}).fallback == "bits"
    assert Vocabulary.from_json({"tokens": ["a"]}).fallback == "hex"
    assert v.suffix_of(b"the") == b"e" and v.suffix_of(b"a") is None
    assert v.without(b"a").id_of(b"\xc3") == 3
    with pytest.raises(ValueError):
        Vocabulary().fallback


def test_pretty_json():
    assert pretty_json([1, 2]) == "[1, 2]"
    wide = pretty_json({"tokens": ["x" * 30, "y" * 30, "z" * 30], "n": 1})
    assert wide.split("\n")[0] == "{" and all(len(line) <= 82 for line in wide.split("\n"))
    import json

    assert json.loads(wide) == {"tokens": ["x" * 30, "y" * 30, "z" * 30], "n": 1}
    assert not re.search(r",\n\s*[}\]]", wide)


def test_tokens_decode_to_their_bytes():
    rng = random.Random(9)
    for base in (Vocabulary.hex, Vocabulary.bits):
        m = Automaton(base([b"the", b"e", "é".encode()]))
        for _ in range(100):
            data = "".join(rng.choice("the é0fz") for _ in range(rng.randint(0, 30))).encode()
            assert segment.decoded(m.string(i) for i in m.expand(m.ids(data))) == data


def test_many_texts_at_once_are_segmented_as_one_by_one(monkeypatch):
    rng = random.Random(10)
    flat = lambda m, raws: [i for x in raws for i in (-1, *m.ids(x))]
    for k in range(200):
        base = rng.choice([Vocabulary.hex, Vocabulary.bits])
        letters = rng.choice([b"abcx\xc3", b"ab", b"a", b"a\xff"])
        v = base(bytes(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([3, 5, 9])))) for _ in range(rng.randint(0, 12)))
        raws = [bytes(rng.choice(letters + rng.choice([b"", b"z"])) for _ in range(rng.choice([0, 3, 30, 700]))) for _ in range(rng.randint(0, 12))]
        m, many = Automaton(v), segment.Segmenter(v)
        assert many.table is not None
        assert many.ids(raws).tolist() == flat(m, raws) and many.costs(raws).tolist() == [m.cost(x) for x in raws]
        assert many.tokens([*raws, None]).to_pylist() == [*([m.string(i) for i in m.expand(m.ids(x))] for x in raws), None]
    # a text that hangs on its first byte to its end, and machines of too many states or without a byte to part texts
    v, raws = Vocabulary.hex([b"aa", b"aaa"]), [b"a" * 50_001, b"b" + b"a" * 50_000]
    assert segment.Segmenter(v).ids(raws).tolist() == flat(Automaton(v), raws)
    every = Vocabulary.hex(bytes([b, 255 - b]) for b in range(256))
    assert segment.Segmenter(every).table is None and segment.Segmenter(every).ids([b"ab", b""]).tolist() == flat(Automaton(every), [b"ab", b""])
    monkeypatch.setattr(transducer, "MOST_STATES", 2)
    assert segment.Segmenter(v).table is None and segment.Segmenter(v).costs([b"aab", b"z"]).tolist() == [2, 3]


def test_training_passes_are_fast():
    """The plain program takes about 1 us a byte; a training query takes a dozen passes over the corpus."""
    rng = random.Random(11)
    raws = [" ".join(rng.choice(["the", "nation", "é", "Of", "zebra"]) for _ in range(400)).encode() for _ in range(2000)]
    v = Vocabulary.hex([b"the", b"tion", b" ", b"e", b"na"])
    m, many, few = Automaton(v), segment.Segmenter(v), raws[:40]

    def seconds(run, xs):
        began = time.perf_counter()
        run(xs)
        return (time.perf_counter() - began) / sum(map(len, xs))

    plain = min(seconds(lambda xs: [m.ids(x) for x in xs], few) for _ in range(3))
    assert min(seconds(many.ids, raws) for _ in range(3)) * 4 < plain


def test_written_tokens(spark):
    """As the column functions give them, by a scan whose Python batches stay small however long the tokens are."""
    rng = random.Random(13)
    v = Vocabulary.bits([b" ", b"e", "é".encode(), b"the", b"th", b"er", b".", b"xyz"])
    rows = [(k, "".join(rng.choice("the ré.xyz\n\0") for _ in range(rng.choice([0, 1, 400])))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for longest, method in ((True, segment.greedy), (False, segment.by_bytes)):
        want = {r["doc_id"]: [t.encode("latin-1").hex().upper() for t in r["t"]] for r in df.select("doc_id", method(F.col("text"), v).alias("t")).collect()}
        found = segment.written(df, v, longest)
        assert found.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("tokens", "string")]
        assert {r["doc_id"]: (r["n_tokens"], r["tokens"]) for r in found.collect()} == {k: (len(t), " ".join(t)) for k, t in want.items()}
    assert segment.written(spark.createDataFrame([(1, None)], "doc_id long, text string"), v, True).collect()[0][:] == (1, 0, "")
    plans = [Q.QUERIES[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString() for n in ("tokenize_greedy", "tokenize_bytes_hex", "tokenize_bytes_bits")]
    assert all("regexp_extract_all" not in p for p in plans)


def test_round_trip_holds_the_tokens_of_a_slice_only(spark):
    rng = random.Random(14)
    v = Vocabulary.bits([b"the", b"e", "é".encode()])
    rows = [(k, k % 3, "".join(rng.choice("the é0fz") for _ in range(rng.randint(0, 200)))) for k in range(50)] + [(50, 0, None), (51, 0, "")]
    df = spark.createDataFrame(rows, "id long, turn long, text string").repartition(2)
    assert sorted(map(tuple, segment.round_trip(df, v, ("id", "turn")).collect())) == rows
    assert sorted(map(tuple, df.select("id", "turn", segment.decode(segment.optimal(F.col("text"), v))).collect())) == rows
    data = pa.array(["z" * 1000] * 2000)
    most = max(len(segment.Segmenter(v).tokens(raws).values) for _, raws in transducer.slices(data, segment.WRITTEN))
    assert most <= 8 * segment.WRITTEN < 8 * 1000 * 2000


def test_tokens_and_pairs_are_counted_where_they_end(monkeypatch):
    """Without the tokens in the order of the text, which took twice as long as finding them."""
    rng = random.Random(15)
    plain = lambda m, raws: [m.ids(x) for x in raws]
    for k in range(200):
        base = rng.choice([Vocabulary.hex, Vocabulary.bits])
        letters = rng.choice([b"abcx\xc3", b"ab", b"a", b"a\xff"])
        v = base(bytes(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([3, 5, 40])))) for _ in range(rng.randint(0, 12)))
        raws = [bytes(rng.choice(letters + rng.choice([b"", b"z"])) for _ in range(rng.choice([0, 3, 30, 700]))) for _ in range(rng.randint(0, 12))]
        if k == 199:
            monkeypatch.setattr(transducer, "MOST_STATES", 1)
        many, n = segment.Segmenter(v), len(v) + 256
        assert many.table is None or k < 199
        ids = plain(Automaton(v), raws)
        seen, pairs = Counter(i for x in ids for i in x), Counter(p for x in ids for p in zip(x, [*x[1:], n]))
        assert {i: c for i, c in enumerate(many.counts(raws).tolist()) if c} == seen
        found = many.pairs(raws)
        assert found.shape == (n, n + 1) and {(int(i), int(j)): int(found[i, j]) for i, j in zip(*found.nonzero())} == pairs


def test_bytes_are_written_all_at_once():
    rng = random.Random(16)
    for v in (Vocabulary.bits([b"e", b" "]), Vocabulary.hex([b"e", b" ", b"\xc3"])):
        spelled = [" ".join(s.hex().upper() for s in ([bytes([b])] if bytes([b]) in v else v.fallback_of(b))) for b in range(256)].__getitem__
        plain = lambda raws: [" ".join(map(spelled, x)) for x in raws]  # noqa: E731, B023
        write = segment._bytes_written(v)
        for _ in range(50):
            raws = [rng.randbytes(rng.choice([0, 0, 1, 40])) for _ in range(rng.randint(0, 9))]
            n, tokens = write(raws)
            assert tokens.to_pylist() == plain(raws) and n.to_pylist() == [len(t.split()) for t in plain(raws)]
        raws = [rng.randbytes(20_000) for _ in range(10)]

        def seconds(run, xs=raws):
            began = time.perf_counter()
            run(xs)
            return time.perf_counter() - began

        assert min(seconds(write) for _ in range(7)) < min(seconds(plain) for _ in range(7))
