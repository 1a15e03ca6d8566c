"""Vocabulary training: each evaluation is one distributed pass, the decisions are the driver's.

All rules break ties by a total order, so a result does not depend on the order of rows: of equal scores, the
string first in byte order. Segmentation never crosses rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.mining import top_substrings
from glyphmill.operators.segment import optimal_changes, optimal_costs
from glyphmill.operators.stats import SegmentStats, top_bytes
from glyphmill.operators.vocabulary import Vocabulary, save_json

Evaluate = Callable[[Vocabulary, bool], SegmentStats]
Costs = Callable[[list[Vocabulary]], list[int]]
Changes = Callable[[Vocabulary, list[bytes]], list[dict[bytes, int]]]

AHEAD = 8  # removals counted in one pass


def evaluator(docs: DataFrame, text_col: str = "text", filters: Iterable[str] = ()) -> Evaluate:
    names = tuple(filters)
    return lambda vocabulary, pairs: SegmentStats(docs, vocabulary, text_col, names, pairs)


def coster(docs: DataFrame, text_col: str = "text", filters: Iterable[str] = ()) -> Costs:
    names = tuple(filters)
    return lambda vocabularies: optimal_costs(docs, vocabularies, text_col, names)


def changer(docs: DataFrame, text_col: str = "text", filters: Iterable[str] = ()) -> Changes:
    names = tuple(filters)
    return lambda vocabulary, strings: optimal_changes(docs, vocabulary, strings, text_col, names)


def _best(scores: dict[bytes, int]) -> bytes | None:
    return min(scores, key=lambda s: (-scores[s], s)) if scores else None


def _rarest(counts: dict[bytes, int], vocabulary: Vocabulary) -> list[bytes]:
    """Removable tokens, rarest first."""
    free = [t.string for t in vocabulary if not t.mandatory]
    return sorted(free, key=lambda s: (counts[s], s))


def train_by_strings(evaluate: Evaluate, start: Vocabulary, ntokens: int) -> Vocabulary:
    """Add the best joined string of two tokens, or literal (worth its cost less one); past ``ntokens``, drop the
    rarest token whose loss still beats the cost before the addition; stop when none does."""
    vocabulary = start.copy()
    while True:
        stats = evaluate(vocabulary, True)
        scores = {s: n * (vocabulary.literal_cost - 1) for s, n in stats.literals.items()}
        for (a, b), n in stats.pairs.items():
            if a in vocabulary and b in vocabulary:
                scores[a + b] = scores.get(a + b, 0) + n
        added = _best({s: n for s, n in scores.items() if s not in vocabulary})
        if added is None:
            return vocabulary
        grown = vocabulary.copy()
        grown.add(added)
        if len(grown) > ntokens:
            counts = evaluate(grown, False).expanded()
            for s in _rarest(counts, grown):
                if s != added and evaluate(smaller := grown.without(s), False).cost < stats.cost:
                    grown = smaller
                    break
            else:
                return vocabulary
        vocabulary = grown


def train_by_ids(evaluate: Evaluate, start: Vocabulary, ntokens: int) -> tuple[Vocabulary, SegmentStats]:
    """The other rule set: pairs of ids, literals among them; a literal is worth its count and must beat the pair."""
    vocabulary, stats = start.copy(), None
    while True:
        stats = stats if stats is not None and stats.pairs else evaluate(vocabulary, True)
        literal = _best(stats.literals)
        pair = min(stats.pairs, key=lambda p: (-stats.pairs[p], p)) if stats.pairs else None
        if literal is None and pair is None:
            return vocabulary, stats
        n_literal, n_pair = stats.literals.get(literal, 0), stats.pairs.get(pair, 0)
        grown, kept = vocabulary.copy(), None
        added = literal if n_literal > n_pair else b"".join(pair)
        if added in grown:
            return vocabulary, stats
        grown.add(added)
        if len(grown) > ntokens:
            counts = evaluate(grown, False).tokens
            for s in _rarest(counts, grown):
                kept = evaluate(smaller := grown.without(s), True)
                if kept.cost < stats.cost:
                    grown = smaller
                    break
            else:
                return vocabulary, stats
        vocabulary, stats = grown, kept


def _without_unused(evaluate: Evaluate, start: Vocabulary) -> tuple[Vocabulary, SegmentStats]:
    stats = evaluate(start, False)
    counts = stats.expanded()
    vocabulary = Vocabulary(t for t in start if t.mandatory or counts[t.string])
    return vocabulary, stats


def prune_rarest(evaluate: Evaluate, start: Vocabulary, ntokens: int, changes: Changes | None = None) -> Vocabulary:
    """Drop unused tokens, then the rarest one again and again, counting anew each time.

    changes: of the counts as strings are dropped one after another, in one pass; they are guessed from the counts so far,
    and what was counted after a wrong guess is not used. Without it, each removal is a pass.
    """
    vocabulary, stats = _without_unused(evaluate, start)
    counts = stats.expanded()  # still those of the vocabulary: no best way leads over an unused token
    known: deque[tuple[bytes, dict[bytes, int]]] = deque()
    while (over := len(vocabulary) - ntokens) > 0 and (rare := _rarest(counts, vocabulary)):
        smaller = vocabulary.without(rare[0])
        if over == 1:
            return smaller
        if changes is None:
            counts = evaluate(smaller, False).expanded()
        else:
            if not known or known[0][0] != rare[0]:
                tried = rare[: min(over - 1, AHEAD)]
                known = deque(zip(tried, changes(vocabulary, tried), strict=True))
            change = known.popleft()[1]
            counts = {s: n + change.get(s, 0) for s, n in counts.items()}
        vocabulary = smaller
    return vocabulary


def prune_best(evaluate: Evaluate, start: Vocabulary, ntokens: int, candidates: int | None = None, costs: Costs | None = None) -> Vocabulary:
    """Drop unused tokens, then again and again the one whose loss costs least, of all or of the rarest few.

    costs: of many vocabularies in one pass; without it, each one tried is a pass.
    """
    costs = costs or (lambda tried: [evaluate(v, False).cost for v in tried])
    vocabulary, _ = _without_unused(evaluate, start)
    while len(vocabulary) > ntokens:
        if candidates:
            tried = _rarest(evaluate(vocabulary, False).expanded(), vocabulary)[:candidates]
        else:
            tried = [t.string for t in vocabulary if not t.mandatory]
        if not tried:
            break
        cost = dict(zip(tried, costs([vocabulary.without(s) for s in tried]), strict=True))
        vocabulary = vocabulary.without(min(tried, key=lambda s: (cost[s], s)))
    return vocabulary


def ranked_bytes(docs: DataFrame, text_col: str = "text", filters: Iterable[str] = ()) -> list[bytes]:
    return [bytes.fromhex(r["byte"]) for r in top_bytes(docs, 256, text_col, filters).collect()]


def substring_vocabulary(docs: DataFrame, ntokens: int, text_col: str = "text", base: str = "hex") -> Vocabulary:
    """The base and the best substrings, up to ``ntokens``."""
    out = Vocabulary.hex() if base == "hex" else Vocabulary.bits()
    out.add_ranked([s for s, _ in top_substrings(docs, ntokens, text_col)], ntokens)
    return out


def strategies(docs: DataFrame, ntokens: int, text_col: str = "text", filter_sets=((), ("caps",), ("caps", "words"))) -> Iterator[tuple[Vocabulary, dict]]:
    """Candidates: for each set of filters, bits up to 64 tokens and hex from 17 on; bytes, substrings, training."""
    for names in filter_sets:
        first = ranked_bytes(docs, text_col, names)
        strings = [s for s, _ in top_substrings(docs, ntokens, text_col, names)]
        evaluate = evaluator(docs, text_col, names)
        bases = [(Vocabulary.bits, False)] * (ntokens <= 64) + [(Vocabulary.hex, True)] * (ntokens >= 17)
        for base, fallback16 in bases:
            about = {"fallback16": fallback16, "filters": list(names)}
            v = base()
            v.add_ranked(first, ntokens)
            v.add_ranked(strings, ntokens)
            yield v, about | {"type": "top_bytes"}
            v = base()
            v.add_ranked(strings, ntokens)
            yield v, about | {"type": "top_strings"}
            yield train_by_strings(evaluate, base(), ntokens), about | {"type": "bpe"}


def select_best(docs: DataFrame, ntokens: int, text_col: str = "text", **options) -> dict:
    """The saved form of the candidate with the fewest tokens; of equal ones the first."""
    best = None
    for vocabulary, about in strategies(docs, ntokens, text_col, **options):
        stats = SegmentStats(docs, vocabulary, text_col, about["filters"]).as_json()
        if best is None or stats["total_tokens"] < best["stats"]["total_tokens"]:
            best = vocabulary.to_json(stats, about)
    return best


def generate(docs: DataFrame, ntokens: int, path: str, text_col: str = "text", **options) -> dict:
    """The best candidate, saved."""
    best = select_best(docs, ntokens, text_col, **options)
    save_json(best, path)
    return best


def train_and_save(docs: DataFrame, ntokens: int, path: str, text_col: str = "text", filters: Iterable[str] = (), start: Vocabulary | None = None) -> dict:
    """Train by ids, measure the result and save it with its filters."""
    names = list(filters)
    vocabulary, _ = train_by_ids(evaluator(docs, text_col, names), start or Vocabulary.hex(), ntokens)
    saved = vocabulary.to_json(SegmentStats(docs, vocabulary, text_col, names).as_json(), {"type": "bpe", "filters": names})
    save_json(saved, path)
    return saved


def restored(saved: dict) -> tuple[Vocabulary, list[str]]:
    """The vocabulary and the names of the filters of a saved form."""
    return Vocabulary.from_json(saved), list(saved.get("optimizer", {}).get("filters", []))


def size_sweep(docs: DataFrame, sizes: Iterable[int], text_col: str = "text", filters: Iterable[str] = ()) -> DataFrame:
    """The measures of a vocabulary trained for each size."""
    rows = []
    for n in sizes:
        vocabulary = train_by_strings(evaluator(docs, text_col, filters), Vocabulary.hex(), n)
        s = SegmentStats(docs, vocabulary, text_col, filters).as_json()
        rows.append((n, s["ntokens"], s["scanned_bytes"], s["used_tokens"], s["total_tokens"], s["bytes_per_token"], s["bits_per_byte"], s["entropy_per_byte"]))
    names = "size int, ntokens int, scanned_bytes long, used_tokens long, total_tokens long, bytes_per_token double, bits_per_byte double, entropy_per_byte double"
    return docs.sparkSession.createDataFrame(rows, names)


def frame(spark, vocabulary: Vocabulary) -> DataFrame:
    """token (hex), length, mandatory."""
    rows = [(t.string.hex(), len(t.string), t.mandatory) for t in vocabulary]
    return spark.createDataFrame(rows, "token string, length int, mandatory boolean").orderBy(F.col("token"))
