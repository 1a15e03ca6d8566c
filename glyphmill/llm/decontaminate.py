"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A window is eight consecutive words of a benchmark item (a shorter item is one window). The search
alphabet is the benchmark's own words; every other word is one symbol that no pattern holds. For the
patterns of one length m there is a shift table over blocks of two words: the least distance from the
end of a pattern at which the block occurs, or m - 1 where it occurs in none. A scan jumps by that
shift; only blocks with shift 0 open a bucket of patterns that end so, and each is compared directly.

Scale: one scan of the documents without a shuffle. The compiled patterns are broadcast in chunks of
at most ``max_windows`` windows; a larger benchmark makes one scan for each chunk, with what it found written
and its broadcast gone before the next one's, so no executor's table grows with the benchmark.

Defined cases: ids may be of any type; very long texts are read whole;
a null or wordless text has no words, hits and items; items without words have no
windows; items with equal windows all count; repeated item ids count once; a repeated document row
gives a repeated result row; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._common import Workspace, each_text, slot

WINDOW = 8
MAX_WINDOWS = 500_000  # of one broadcast chunk, about 100 MB compiled

#: ASCII that is not a digit or letter separates words; A-Z become a-z; all other bytes stay.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WuManber:
    """Patterns: word tuples with the ids of the items they come from."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item_id, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                owners[tuple(w[i : i + window])].add(item_id)
        by_length: dict[int, dict] = defaultdict(dict)
        for p, who in owners.items():
            by_length[len(p)][p] = tuple(sorted(who))
        self.tables = [self._compile(m, patterns) for m, patterns in sorted(by_length.items())]

    def _compile(self, m: int, patterns: dict) -> tuple:
        b, v = min(2, m), len(self.ids) + 1
        shift: dict[int, int] = {}
        buckets: dict[int, list] = defaultdict(list)
        for p, who in patterns.items():
            for end in range(b, m + 1):
                key = p[end - 1] if b == 1 else p[end - 2] * v + p[end - 1]
                shift[key] = min(shift.get(key, m), m - end)
            buckets[key].append((list(p), who))
        return m, b, v, shift, dict(buckets)

    def search(self, text: bytes) -> tuple[int, list[tuple[int, int, tuple[str, ...]]]]:
        """The number of words, and (start, end, items) of every occurrence."""
        get, found = self.ids.get, []
        w = [get(x, 0) for x in words(text)]
        n = len(w)
        for m, b, v, shift, buckets in self.tables:
            i, far, get_shift = m - 1, m - b + 1, shift.get
            while i < n:
                last = w[i]
                if not last:
                    i += m
                    continue
                key = last if b == 1 else w[i - 1] * v + last
                jump = get_shift(key, far)
                if jump:
                    i += jump
                    continue
                start = i - m + 1
                here = w[start : i + 1]
                for p, who in buckets[key]:
                    if p == here:
                        found.append((start, i + 1, who))
                i += 1
        return n, found


def _union(spans: list[int]) -> list[int]:
    """Flat (start, end) pairs as flat disjoint pairs in order."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _chunks(benchmark: DataFrame, id_col: str, text_col: str, max_windows: int) -> Iterator[WuManber]:
    """Compiled chunks; the driver holds two of them at a time."""
    part, n = [], 0
    for item_id, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        raw = (text or "").encode()
        part.append((item_id if item_id is not None else "", raw))
        n += max(1, len(words(raw)) - WINDOW + 1)
        if n >= max_windows:
            yield WuManber(part)
            part, n = [], 0
    if part or n == 0:
        yield WuManber(part)


def _with_last(items: Iterator) -> Iterator[tuple]:
    """Each item, and whether it is the last."""
    before = next(items, None)
    while before is not None:
        after = next(items, None)
        yield before, after is None
        before = after


def find_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """doc_id, text, n_words, spans (flat disjoint word ranges hit), items (ids, sorted as strings)."""
    work = Workspace(docs.sparkSession)
    state = slot(docs, id_col, text_col).select(
        "doc_id",
        "text",
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<bigint>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    schema = state.schema
    for machine, last in _with_last(_chunks(benchmark, item_col, item_text_col, max_windows)):
        shared = docs.sparkSession.sparkContext.broadcast(machine)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = shared.value.search
            for batch in batches:
                n_words, spans, items = [], [], []
                for text, old, who in zip(
                    batch["text"].cast(pa.binary()).to_pylist(),
                    batch["spans"].to_pylist(),
                    batch["items"].to_pylist(),
                    strict=True,
                ):
                    n, found = search(text or b"")
                    n_words.append(n)
                    if found:
                        old = _union(old + [x for a, b, _ in found for x in (a, b)])
                        who = sorted({*who}.union(*(x[2] for x in found)))
                    spans.append(old)
                    items.append(who)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"],
                        batch["text"],
                        pa.array(n_words, pa.int64()),
                        pa.array(spans, pa.list_(pa.int64())),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    names=["doc_id", "text", "n_words", "spans", "items"],
                )

        state = state.mapInArrow(scan, schema)
        if not last:
            state = work.cut(state)
            shared.destroy()
    return state


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, **columns) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_windows(docs, benchmark, **columns)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: x - s)  # pairs: end - (start - so far)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_items: int = 1, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents, all columns, in which windows of fewer than ``min_items`` items occur."""
    work = Workspace(docs.sparkSession)
    for machine, last in _with_last(_chunks(benchmark, item_col, item_text_col, max_windows)):
        shared = docs.sparkSession.sparkContext.broadcast(machine)
        clean = each_text(lambda raw, shared=shared: len(set().union(*(x[2] for x in shared.value.search(raw or b"")[1]))) < min_items, pa.bool_())
        docs = docs.where(clean(F.col(text_col)))
        if not last:
            docs = work.cut(docs)
            shared.destroy()
    return docs


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    from glyphmill.llm._common import read

    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))

