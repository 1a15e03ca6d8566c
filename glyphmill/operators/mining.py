"""Frequent substrings of bytes, level by level."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from glyphmill.functions.filters import compose
from glyphmill.operators.transducer import slices

LONGEST = 1000
BLOCK = 1 << 17  # places counted at once


def _rank(item: tuple[bytes, int]) -> tuple:
    return -item[1], len(item[0]), item[0]


class _Extensions:
    """Counts of the extensions by one byte of strings of one length, over many texts at once."""

    def __init__(self, prefixes: list[bytes]) -> None:
        self.prefixes, self.length = prefixes, len(prefixes[0]) + 1
        places: dict[bytes, int] = {}
        for p in prefixes:
            for k in range(1, len(p) + 1):
                places.setdefault(p[:k], len(places) + 1)
        kind = np.min_scalar_type(len(places))
        self.step = np.zeros((len(places) + 1) * 256, kind)  # 0: no prefix
        self.first = np.zeros(256, kind)
        self.second = np.zeros(1 << 16, kind)
        for p, k in places.items():
            if len(p) == 1:
                self.first[p[0]] = k
            else:
                self.step[places[p[:-1]] << 8 | p[-1]] = k
            if len(p) == 2:
                self.second[p[0] << 8 | p[1]] = k
        self.number = np.zeros(len(places) + 1, np.int64)
        self.number[[places[p] for p in prefixes]] = np.arange(len(prefixes))

    def count(self, raws: list[bytes]) -> np.ndarray:
        """A number for each prefix and byte."""
        data, sizes = np.frombuffer(b"".join(raws), np.uint8), np.array([len(x) for x in raws], np.int64)
        none = np.zeros(len(self.prefixes) << 8, np.int64)
        if len(data) < self.length:
            return none
        known = min(self.length - 1, 2)
        at = self.first[data] if known == 1 else np.append(np.take(self.second, _bigrams(data), mode="clip"), self.second.dtype.type(0))
        # places too near to the end of their text
        near = np.minimum(sizes, self.length - 1)
        after = np.cumsum(near)
        at[np.repeat(np.cumsum(sizes) - after, near) + np.arange(after[-1])] = 0
        place = np.flatnonzero(at != 0)
        at = at[place]
        for k in range(known, self.length - 1):
            at = self.step[at.astype(np.intp) << 8 | data[place + k]]
            kept = np.flatnonzero(at)
            place, at = place[kept], at[kept]
        return np.bincount(self.number[at] << 8 | data[place + self.length - 1], minlength=len(none))


def _bigrams(data: np.ndarray) -> np.ndarray:
    """Two bytes as a number, at each byte but the last."""
    return data[:-1].astype(np.uint16) << 8 | data[1:]


def _short(raws: list[bytes]) -> np.ndarray:
    """The number of each byte, then of each two bytes within a text."""
    data, ends = np.frombuffer(b"".join(raws), np.uint8), np.unique(np.cumsum([0, *map(len, raws)]))
    two, one = np.zeros(1 << 16, np.int64), np.zeros(256, np.int64)
    if len(data):
        both = _bigrams(data)
        for k in range(0, len(both), BLOCK):
            two += np.bincount(both[k : k + BLOCK], minlength=len(two))
        one += two.reshape(256, 256).sum(axis=1)
        one[data[-1]] += 1
        two -= np.bincount(both[ends[1:-1] - 1], minlength=len(two))  # across texts
    return np.concatenate([one, two])


def _counted(text: DataFrame, count: Callable[[list[bytes]], np.ndarray], grams: Callable[[list[int]], list[bytes]]) -> DataFrame:
    """gram, cnt of strings numbered as in ``count``. Tasks count, the shuffle adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = count([])
        for batch in batches:
            for _, raws in slices(batch["text"].drop_null()):
                seen += count(raws)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(grams(found.tolist()), pa.binary()), pa.array(seen[found])], names=["gram", "cnt"])

    return text.mapInArrow(run, "gram binary, cnt long").groupBy("gram").agg(F.sum("cnt").alias("cnt"))


def _rows(counted: DataFrame, order: list, n: int) -> list[tuple[bytes, int]]:
    return [(bytes(r["gram"]), r["cnt"]) for r in counted.orderBy(*order).limit(n).collect()]


def _level(docs: DataFrame, prefixes: set[bytes], n: int) -> list[tuple[bytes, int]]:
    """The n best extensions by one byte of the prefixes; only these come back."""
    known = sorted(prefixes)
    counted = _counted(docs, _Extensions(known).count, lambda found: [known[k >> 8] + bytes([k & 255]) for k in found])
    return _rows(counted, [F.desc("cnt"), "gram"], n)


def _first_levels(docs: DataFrame, n: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
    """All bytes, and the n best of two bytes, in one pass."""
    counted = _counted(docs, _short, lambda found: [bytes([k]) if k < 256 else (k - 256).to_bytes(2) for k in found])
    rows = _rows(counted, [F.octet_length("gram"), F.desc("cnt"), "gram"], 256 + n)
    one = [r for r in rows if len(r[0]) == 1]
    return one, rows[len(one) : len(one) + n]


def top_substrings(docs: DataFrame, n: int, text_col: str = "text", filters: Iterable[str] = (), longest: int = LONGEST) -> list[tuple[bytes, int]]:
    """The n best byte strings of any length by count, then shorter first, then in byte order.

    A string counts wherever it occurs within a row, overlaps included, if its prefix one shorter is among the
    best so far. A length's own best n suffice, as no other of that length can be among the best of all.
    """
    names = tuple(filters)
    text = docs.select(compose(names)(F.col(text_col)).alias("text"))  # a condition on it would run the filters twice
    if names:  # filters cost far more than a count, so they run once and not for each length
        text.persist(StorageLevel.DISK_ONLY)
    try:
        one, two = _first_levels(text, n)
        best = dict(sorted(one + (two if longest > 1 else []), key=_rank)[:n])
        for length in range(3, longest + 1):
            prefixes = {s for s in best if len(s) == length - 1}
            if not prefixes:
                break
            best |= dict(_level(text, prefixes, n))
            best = dict(sorted(best.items(), key=_rank)[:n])
    finally:
        if names:
            text.unpersist()
    return sorted(best.items(), key=_rank)[:n]
