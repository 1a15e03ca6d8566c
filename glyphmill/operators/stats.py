"""Compression statistics of a segmentation, and frequency counts of bytes, characters and digits."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.filters import compose
from glyphmill.operators.segment import optimal_counts
from glyphmill.operators.vocabulary import Vocabulary


def _counted(docs: DataFrame, text: Column, count: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """place, cnt: each task adds up the counts of its rows' bytes before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                found = count(batch["text"].slice(at, 1024).cast(pa.binary()).drop_null().to_pylist())
                if len(found) > len(total):
                    total = np.append(total, np.zeros(len(found) - len(total), np.int64))
                total[: len(found)] += found
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total[place])], names=["place", "cnt"])

    return docs.select(text.alias("text")).mapInArrow(run, "place int, cnt long").groupBy("place").agg(F.sum("cnt").alias("cnt"))


def _byte(place: Column) -> Column:
    return F.lpad(F.hex(place), 2, "0")


def byte_histogram(docs: DataFrame, text_col: str = "text", filters: Iterable[str] = ()) -> DataFrame:
    """byte (two hex digits), cnt; bytes that do not occur have no row."""

    def count(raws: list[bytes]) -> np.ndarray:
        return np.bincount(np.frombuffer(b"".join(raws), np.uint8), minlength=256)

    return _counted(docs, compose(filters)(F.col(text_col)), count).select(_byte(F.col("place")).alias("byte"), "cnt")


def top_bytes(docs: DataFrame, n: int, text_col: str = "text", filters: Iterable[str] = ()) -> DataFrame:
    """The n most frequent bytes; of equal counts, smaller bytes first."""
    return byte_histogram(docs, text_col, filters).orderBy(F.desc("cnt"), "byte").limit(n)


def char_histogram(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """code (code point), cnt."""

    def count(raws: list[bytes]) -> np.ndarray:
        return np.bincount(np.frombuffer(b"".join(raws).decode().encode("utf-32-le"), np.uint32))

    return _counted(docs, F.col(text_col), count).select(F.col("place").alias("code"), "cnt")


def reserved_chars(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The character histogram where the reserved alphabet and plain text lie: 0 to 499 and U+E000 to U+E01F."""
    return char_histogram(docs, text_col).where("code < 500 or code between 57344 and 57375").orderBy("code")


def hex_digit_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """digit, cnt over the hex digits of all bytes, rarest first; of equal counts, smaller digits first."""
    both = F.lower("byte")
    digits = byte_histogram(docs, text_col).select(F.explode(F.array(F.substring(both, 1, 1), F.substring(both, 2, 1))).alias("digit"), "cnt")
    return digits.groupBy("digit").agg(F.sum("cnt").alias("cnt")).orderBy("cnt", "digit")


def bigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """left, right (bytes in hex), cnt: neighbouring bytes within a row."""

    def count(raws: list[bytes]) -> np.ndarray:
        raws = [x for x in raws if x]
        if not raws:
            return np.zeros(0, np.int64)
        x = np.frombuffer(b"".join(raws), np.uint8).astype(np.int32)
        pairs = x[:-1] * 256 + x[1:]
        within = np.ones(len(pairs), bool)
        within[np.cumsum([len(r) for r in raws])[:-1] - 1] = False
        return np.bincount(pairs[within], minlength=1 << 16)

    place = F.col("place")
    return _counted(docs, F.col(text_col), count).select(_byte(F.shiftright(place, 8)).alias("left"), _byte(place.bitwiseAND(255)).alias("right"), "cnt")


def token_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    """token, cnt of an array column of tokens."""
    return docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))


def measures(counts: DataFrame, ntokens: int, scanned: DataFrame, digits: int = 9) -> DataFrame:
    """One row of measures of (token, cnt) over ``scanned`` (one row, scanned_bytes). Ratios of nothing are null."""
    sums = counts.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_tokens"),
        F.count_if(F.col("cnt") > 0).alias("used_tokens"),
        F.sum(F.col("cnt") * F.log2("cnt")).alias("weighted"),
    )
    total, size = F.col("total_tokens"), F.when(F.col("scanned_bytes") > 0, F.col("scanned_bytes"))
    per = F.when(total > 0, total)
    return sums.crossJoin(F.broadcast(scanned)).select(  # two frames of one row each
        F.lit(ntokens).cast("long").alias("ntokens"),
        "scanned_bytes",
        "used_tokens",
        "total_tokens",
        F.round(F.col("scanned_bytes") / per, digits).alias("bytes_per_token"),
        F.round(total * math.log2(ntokens) / size, digits).alias("bits_per_byte"),
        F.round((total * F.log2(per) - F.col("weighted")) / size, digits).alias("entropy_per_byte"),
    )


def report(counts: DataFrame, n: int = 200) -> DataFrame:
    """The n most frequent tokens; of equal counts, in the order of bytes."""
    return counts.orderBy(F.desc("cnt"), "token").limit(n)


class SegmentStats:
    """What one pass of optimal segmentation counts, on the driver: at most one number for each token and byte
    (and for each pair that occurs, if asked for)."""

    def __init__(self, docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", filters: Iterable[str] = (), pairs: bool = False) -> None:
        self.vocabulary = vocabulary
        self.tokens: dict[bytes, int] = {t.string: 0 for t in vocabulary}
        self.literals: dict[bytes, int] = {}
        self.pairs: dict[tuple[bytes, bytes], int] = {}
        self.raw_bytes = self.scanned_bytes = 0
        for r in optimal_counts(docs, vocabulary, text_col, filters, pairs).collect():
            left = bytes.fromhex(r["left"]) if r["left"] is not None else b""
            if r["kind"] == "token":
                self.tokens[left] = r["cnt"]
            elif r["kind"] == "literal":
                self.literals[left] = r["cnt"]
            elif r["kind"] == "pair":
                self.pairs[left, bytes.fromhex(r["right"])] = r["cnt"]
            elif r["kind"] == "bytes":
                self.raw_bytes = r["cnt"] or 0
            else:
                self.scanned_bytes = r["cnt"] or 0

    @property
    def cost(self) -> int:
        return sum(self.tokens.values()) + self.vocabulary.literal_cost * sum(self.literals.values())

    def expanded(self) -> dict[bytes, int]:
        """Counts of tokens with literals written by the fallback."""
        out = dict(self.tokens)
        for byte, n in self.literals.items():
            for s in self.vocabulary.fallback_of(byte[0]):
                out[s] += n
        return out

    def as_json(self) -> dict:
        counts, n = self.expanded(), len(self.vocabulary)
        total, size = sum(counts.values()), self.raw_bytes
        used = [c for c in counts.values() if c]
        return {
            "ntokens": n,
            "scanned_bytes": size,
            "used_tokens": len(used),
            "total_tokens": total,
            "bytes_per_token": size / total if total else None,
            "bits_per_byte": total * math.log2(n) / size if size else None,
            "entropy_per_byte": -sum(c * math.log2(c / total) for c in used) / size if size and total else None,
        }
