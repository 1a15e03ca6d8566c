import random
from collections import Counter

from pyspark.sql import functions as F

from glyphmill.functions import filters
from glyphmill.operators import mining, train
from glyphmill.operators.segment import Automaton
from glyphmill.operators.vocabulary import Vocabulary, load_json


def corpus():
    rng = random.Random(8)
    words = ["the", "then", "other", "ion", "nation", "é", "Of"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(30)] + [""]


def plain_top(texts, n):
    data = [t.encode() for t in texts]
    rank = lambda kv: (-kv[1], len(kv[0]), kv[0])
    best = Counter(d[i : i + 1] for d in data for i in range(len(d)))
    size = 2
    while any(len(s) == size - 1 for s in best):
        more = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1) if best.get(d[i : i + size - 1], 0))
        best = dict(sorted((best | more).items(), key=rank)[:n])
        size += 1
    return sorted(best.items(), key=rank)[:n]


def test_top_substrings(spark):
    texts = corpus()
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3)
    assert mining.top_substrings(df, 40) == plain_top(texts, 40)
    assert mining.top_substrings(df.limit(0), 5) == []


class Plain:
    """Counts of one pass, without Spark."""

    def __init__(self, texts, vocabulary):
        m = Automaton(vocabulary)
        self.vocabulary, self.tokens, self.literals, self.pairs = vocabulary, {t.string: 0 for t in vocabulary}, Counter(), Counter()
        for t in texts:
            ids = m.ids(t.encode())
            for i in ids:
                if i < m.size:
                    self.tokens[m.string(i)] += 1
                else:
                    self.literals[m.string(i)] += 1
            self.pairs.update((m.string(a), m.string(b)) for a, b in zip(ids, ids[1:]))
        self.cost = sum(self.tokens.values()) + vocabulary.literal_cost * sum(self.literals.values())

    def expanded(self):
        out = Counter(self.tokens)
        for b, n in self.literals.items():
            out.update({s: n * k for s, k in Counter(self.vocabulary.fallback_of(b[0])).items()})
        return out


def test_training_on_spark_equals_a_local_run(spark):
    texts = corpus()
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2).cache()
    far, near = train.evaluator(df), lambda v, pairs: Plain(texts, v)
    names = lambda v: [t.string for t in v]
    start = Vocabulary.hex([b"the", b"en", b"zz", b"qq", b" "])
    for how in (
        lambda e: train.train_by_strings(e, Vocabulary.hex(), 22),
        lambda e: train.train_by_ids(e, Vocabulary.hex(), 22)[0],
        lambda e: train.prune_rarest(e, start, 19),
        lambda e: train.prune_best(e, start, 19),
    ):
        assert names(how(far)) == names(how(near))
    assert names(train.prune_best(far, start, 19, costs=train.coster(df))) == names(train.prune_best(near, start, 19))


def plain_strings(texts, tokens, n):
    """tokens: bytes, the base first. Add the best joined string; past n, drop the first that is worth it, rarest first."""
    base, tokens = set(tokens), list(tokens)
    of = lambda ts: Plain(texts, Vocabulary.hex(t for t in ts if t not in base))
    while True:
        now = of(tokens)
        gain = Counter({b: 2 * c for b, c in now.literals.items()})
        for (a, b), c in now.pairs.items():
            if a in tokens and b in tokens:
                gain[a + b] += c
        for t in tokens:
            gain.pop(t, None)
        if not gain:
            return tokens
        most = max(gain.values())
        new = min(s for s, c in gain.items() if c == most)
        more = [*tokens, new]
        if len(more) > n:
            count = of(more).expanded()
            for s in sorted((s for s in more if s not in base and s != new), key=lambda s: (count[s], s)):
                if of([t for t in more if t != s]).cost < now.cost:
                    more.remove(s)
                    break
            else:
                return tokens
        tokens = more


def plain_ids(texts, tokens, n):
    """The most frequent pair, or the most frequent literal if it is more frequent; the new token may go again."""
    base, tokens = set(tokens), list(tokens)
    of = lambda ts: Plain(texts, Vocabulary.hex(t for t in ts if t not in base))
    while True:
        now = of(tokens)
        pairs = sorted(now.pairs.items(), key=lambda x: (-x[1], x[0]))
        literals = sorted(now.literals.items(), key=lambda x: (-x[1], x[0]))
        if not pairs and not literals:
            return tokens
        new = literals[0][0] if literals and literals[0][1] > (pairs[0][1] if pairs else 0) else b"".join(pairs[0][0])
        if new in tokens:
            return tokens
        more = [*tokens, new]
        if len(more) > n:
            count = of(more).tokens
            for s in sorted((s for s in more if s not in base), key=lambda s: (count[s], s)):
                if of([t for t in more if t != s]).cost < now.cost:
                    more.remove(s)
                    break
            else:
                return tokens
        tokens = more


def plain_prune(texts, tokens, base, n, best):
    of = lambda ts: Plain(texts, Vocabulary.hex(t for t in ts if t not in base))
    used = of(tokens).expanded()
    tokens = [t for t in tokens if t in base or used[t]]
    while len(tokens) > n and (free := sorted(t for t in tokens if t not in base)):
        count = of(tokens).expanded()
        worth = {s: of([t for t in tokens if t != s]).cost if best else count[s] for s in free}
        tokens.remove(min(free, key=lambda s: (worth[s], s)))
    return tokens


def test_training_follows_its_rules():
    texts = corpus()
    near = lambda v, pairs: Plain(texts, v)
    names = lambda v: [t.string for t in v]
    base = names(Vocabulary.hex())
    for n in (19, 24):
        assert names(train.train_by_strings(near, Vocabulary.hex(), n)) == plain_strings(texts, base, n)
        assert names(train.train_by_ids(near, Vocabulary.hex(), n)[0]) == plain_ids(texts, base, n)
    start = Vocabulary.hex([b"the", b"en", b"zz", b"qq", b" ", b"th", b"on"])
    for n in (18, 20):
        assert names(train.prune_rarest(near, start, n)) == plain_prune(texts, names(start), set(base), n, False)
        assert names(train.prune_best(near, start, n)) == plain_prune(texts, names(start), set(base), n, True)


def test_saved_vocabularies(spark, tmp_path):
    df = spark.createDataFrame([(t,) for t in corpus()], "text string").coalesce(1).cache()
    saved = train.train_and_save(df, 20, str(tmp_path / "v.json"), filters=("caps",))
    again = load_json(str(tmp_path / "v.json"))
    assert again == saved and saved["stats"]["ntokens"] == len(saved["tokens"]) <= 20
    vocabulary, names = train.restored(again)
    assert names == ["caps"] and sorted(t.string for t in vocabulary) == sorted(t.encode() if isinstance(t, str) else bytes(t) for t in saved["tokens"])
    assert train.generate(df, 6, str(tmp_path / "g.json"), filter_sets=((),)) == load_json(str(tmp_path / "g.json"))
    rows = train.size_sweep(df, (17, 20)).collect()
    assert [r["size"] for r in rows] == [17, 20] and rows[0].total_tokens >= rows[1].total_tokens


def test_training_lowers_cost():
    texts = corpus()
    near = lambda v, pairs: Plain(texts, v)
    sizes = [Plain(texts, train.train_by_strings(near, Vocabulary.hex(), n)).cost for n in (17, 20, 26)]
    assert sizes[0] >= sizes[1] >= sizes[2]
    assert len(train.train_by_strings(near, Vocabulary.bits(), 9)) <= 9


def test_select_best(spark):
    df = spark.createDataFrame([(t,) for t in corpus()], "text string").coalesce(1).cache()
    best = train.select_best(df, 6, filter_sets=((), ("caps",)))
    candidates = list(train.strategies(df, 6, filter_sets=((), ("caps",))))
    assert len(candidates) == 6 and best["config"] == {"fallback16": False} and len(best["tokens"]) <= 6
    assert set(best["optimizer"]) == {"fallback16", "filters", "type"}


def test_filters_run_once_for_all_lengths(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    runs = spark.sparkContext.accumulator(0)

    def counted(text):
        @F.udf("string")
        def same(x):
            runs.add(1)
            return x.upper()

        return same(text)

    monkeypatch.setitem(filters.BY_NAME, "counted", counted)
    assert mining.top_substrings(df, 40, filters=("counted",)) == plain_top([t.upper() for t in texts], 40)
    assert runs.value == len(texts)


def test_substrings_of_any_bytes():
    rng = random.Random(12)
    for _ in range(100):
        letters = bytes(rng.randrange(256) for _ in range(rng.randint(1, 4)))
        raws = [bytes(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 50]))) for _ in range(rng.randint(0, 9))]
        size = rng.randint(1, 5)
        prefixes = sorted({bytes(rng.choice(letters) for _ in range(size)) for _ in range(6)})
        want = Counter(x[i : i + size + 1] for x in raws for i in range(len(x) - size))
        found = mining._Extensions(prefixes).count(raws)
        assert {prefixes[k >> 8] + bytes([k & 255]): int(found[k]) for k in found.nonzero()[0].tolist()} == {g: c for g, c in want.items() if g[:-1] in prefixes}


def test_bytes_and_pairs_are_counted_in_one_pass(spark, monkeypatch):
    rng = random.Random(17)
    for _ in range(100):
        raws = [bytes(rng.choice(b"\0ab\xff") for _ in range(rng.choice([0, 1, 2, 50]))) for _ in range(rng.randint(0, 9))]
        want = Counter(x[i : i + n] for x in raws for n in (1, 2) for i in range(len(x) - n + 1))
        found = mining._short(raws).tolist()
        assert {bytes([k]) if k < 256 else divmod(k - 256, 256): c for k, c in enumerate(found) if c} == {g if len(g) == 1 else tuple(g): c for g, c in want.items()}
    monkeypatch.setattr(mining, "_level", None)  # longer ones only
    texts = corpus()
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = Counter(d[i : i + n] for d in (t.encode() for t in texts) for n in (1, 2) for i in range(len(d) - n + 1))
    assert mining.top_substrings(df, 40, longest=2) == sorted(want.items(), key=lambda kv: (-kv[1], len(kv[0]), kv[0]))[:40]


def test_removals_are_counted_around_the_string_in_one_pass(spark):
    rng = random.Random(3)
    texts = [*corpus(), *("".join(rng.choice("theorn ,xyz\n") for _ in range(rng.randint(0, 90))) for _ in range(40)), "the", "x"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3)
    every = bytes(range(256))  # no byte parts such texts
    for strings in ([b"the", b"en", b"n", b" ", b"other", b"on", b"x", b"\n", b"tt", b"zz"], [b"the", b"he", b"o", every]):
        start = Vocabulary.hex(strings)
        removed = [b"the", b"x", b" ", b"en", b"n"] if every not in strings else [b"he", b"the", b"o"]
        counts, left = Plain(texts, start).expanded(), start
        for s, change in zip(removed, train.changer(df)(start, removed), strict=True):
            left = left.without(s)
            counts = {t: n + change.get(t, 0) for t, n in counts.items()}
            assert counts == {s: 0 for s in removed} | dict.fromkeys((t.string for t in start), 0) | Plain(texts, left).expanded()
    start, passes = Vocabulary.hex([b"the", b"en", b"n", b" ", b"other", b"on", b"x", b"\n", b"qq"]), []

    def counted(evaluate):
        return lambda *args: passes.append(args) or evaluate(*args)

    names = lambda v: [t.string for t in v]
    near = counted(lambda v, pairs: Plain(texts, v))
    for n in range(17, 27):
        want = plain_prune(texts, names(start), set(names(Vocabulary.hex())), n, False)
        passes.clear()
        assert names(train.prune_rarest(near, start, n)) == want
        assert len(passes) == 1 + max(0, 24 - n)  # the first counts serve until a token that is used goes, the last are not needed
        passes.clear()
        assert names(train.prune_rarest(near, start, n, counted(train.changer(df)))) == want
        assert len(passes) <= 1 + max(0, 24 - n)


def test_prune_simple_takes_two_passes(spark, monkeypatch):
    from glyphmill.operators import segment, stats
    from glyphmill.plans import queries

    passes = []
    for where, name in ((stats, "optimal_counts"), (train, "optimal_changes")):
        monkeypatch.setattr(where, name, lambda *args, name=name: passes.append(name) or getattr(segment, name)(*args))
    assert queries.prune_simple(spark, "/root/testdata/sf0.001").count() == len(queries.HEX) - 6
    assert passes == ["optimal_counts", "optimal_changes"]
