"""Quality classifier: supervised subword embeddings.

A document's features are its words, their character n-grams (3 to 5, with word borders) and its pairs of neighbouring
words, hashed to a fixed table of learned vectors. The vectors are averaged and a softmax layer over the two labels
follows. Training is stochastic gradient descent in numpy on a bounded sample of labelled rows: the ``SAMPLE`` labelled
documents least in a hash of their id. Scores cover every document. As averaging and the output layer are linear, scoring
needs one number for each feature, and one (sum, count) for each distinct word.

Scale: the labels' sample is bounded, so its join is a broadcast; what the driver gets of a sampled document is at most
one number for each of ``BUCKETS`` features, however long its text is. Scoring is a map without a shuffle, and the model has
a fixed size (``BUCKETS`` numbers).

Defined cases: a null or empty text has no features and gets the score of the bias alone; very long texts are read
whole; without any labelled row every score is 0.5; labels that are null are left out; an id with several labels has the
greatest; repeated rows get equal scores.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._common import each_text, slot

SAMPLE = 2000  # labelled documents that training may use, held by the driver
BITS, DIM, STEPS, RATE = 17, 8, 8_000, 0.4  # STEPS: documents seen in training, at any size
BUCKETS = 1 << BITS
WORDS = 50_000  # distinct words that a task remembers at a time


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes (32 bits each), the buckets of all their n-grams, and the place of each n-gram's word.

    An n-gram is told by its bytes and its length; one that is the whole word, borders included, is left out.
    """
    hashes = np.fromiter(map(crc32, words), np.uint64, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    x = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    room, size = ends[owner] - np.arange(len(x)), sizes[owner]
    gram, grams, owners = x.copy(), [], []
    for k in range(2, 6):
        gram = gram[:-1] | x[k - 1 :] << np.uint64(8 * (k - 1))
        if k >= 3:
            at = np.flatnonzero((room[: len(gram)] >= k) & (size[: len(gram)] > k))
            grams.append((gram[at] + np.uint64(k << 56)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS))
            owners.append(owner[at])
    return hashes, np.concatenate(grams).astype(np.int64), np.concatenate(owners)


def _whole(hashes: np.ndarray) -> np.ndarray:
    """The buckets of whole words."""
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def pair_features(hashes: np.ndarray) -> np.ndarray:
    """The buckets of neighbouring words, from the words' hashes (32 bits each), of either order. As these meet by exclusive
    or, a word and itself are one feature, whatever the word."""
    return ((hashes[:-1] ^ hashes[1:]) * np.uint64(0x9E3779B1) >> np.uint64(9)) % np.uint64(BUCKETS)


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature ids, in order, and their counts."""
    words = text.split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    times = Counter(words)
    hashes, grams, owners = word_features(list(times))
    n = np.fromiter(times.values(), np.int64, len(times))
    pairs = pair_features(np.fromiter(map(crc32, words), np.uint64, len(words))).astype(np.int64)
    total = np.bincount(np.concatenate([_whole(hashes), grams, pairs]), np.concatenate([n, n[owners], np.ones(len(pairs))]), BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


class Model:
    """weight: one number for each feature, the difference of the labels' logits; bias likewise."""

    def __init__(self, weight: np.ndarray, bias: float) -> None:
        self.weight, self.bias = weight, bias
        self._forget()

    def _forget(self) -> None:
        self.places: dict[bytes, int] = {}
        self.known = np.zeros((3, 1024))  # of each word: weight of its features, their number, hash

    def __getstate__(self) -> dict:
        return {"weight": self.weight, "bias": self.bias}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _learn(self, words: list[bytes]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.places]
        if len(self.places) + len(new) > WORDS:
            self._forget()
            new = list(dict.fromkeys(words))
        while self.known.shape[1] < len(self.places) + len(new):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)], 1)
        hashes, grams, owners = word_features(new)
        at = slice(len(self.places), len(self.places) + len(new))
        self.known[0, at] = self.weight[_whole(hashes)] + np.bincount(owners, self.weight[grams], len(new))
        self.known[1, at] = 1 + np.bincount(owners, minlength=len(new))
        self.known[2, at] = hashes
        self.places.update(zip(new, range(at.start, at.stop)))

    def score(self, text: bytes) -> float:
        words, total, n, last = text.split(), 0.0, 0.0, None
        for at in range(0, len(words), WORDS // 2):  # very long texts in parts, whose borders are pairs too
            part = words[at : at + WORDS // 2]
            try:
                places = list(map(self.places.__getitem__, part))
            except KeyError:
                self._learn(part)
                places = list(map(self.places.__getitem__, part))
            sums, counts, hashes = self.known[:, places]
            hashes = hashes.astype(np.uint64) if last is None else np.append(last, hashes.astype(np.uint64))
            last = hashes[-1:]
            total += sums.sum() + self.weight[pair_features(hashes)].sum(dtype=np.float64)
            n += counts.sum() + len(hashes) - 1
        z = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """rows: feature ids, their counts, label."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    share = np.bincount([y for *_, y in rows], minlength=2) / len(rows)
    bias[:] = np.log(np.maximum(share, 1e-3))
    order, steps, done = list(range(len(rows))), max(STEPS, 2 * len(rows)), 0
    shuffle = random.Random(seed).shuffle
    while done < steps:
        shuffle(order)
        for i in order[: steps - done]:
            f, c, y = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            c = c / c.sum() if len(c) else c
            h = c @ vectors[f] if len(f) else np.zeros(DIM, np.float32)
            z = out @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ out
            out -= rate * p[:, None] * h
            bias -= 0.1 * rate * p
            if len(f):
                vectors[f] -= rate * len(f) ** 0.5 * c[:, None] * back
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of the labelled documents whose id is not held out."""
    chosen = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .where(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = slot(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").withColumn("key", F.xxhash64("doc_id"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [document_features(x or b"") for x in part["text"].cast(pa.binary()).to_pylist()]
                # sorted ids by their steps, which compress well
                columns = [pa.array([zlib.compress(x.tobytes(), 1) for x in column], pa.binary()) for column in ([np.diff(f[0], prepend=np.int32(0)) for f in found], [f[1] for f in found])]
                yield pa.RecordBatch.from_arrays([part["key"], part["y"], *columns], names=["key", "y", "f", "c"])

    found = rows.select("key", "y", "text").mapInArrow(features, "key long, y int, f binary, c binary").orderBy("key", "f", "c", "y").limit(sample).collect()
    unpack = lambda raw, kind: np.frombuffer(zlib.decompress(raw), kind)
    return train([(np.cumsum(unpack(r["f"], np.int32), dtype=np.int32), unpack(r["c"], np.float32), r["y"]) for r in found])


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            s = [score(x or b"") for x in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    source = slot(docs, id_col, text_col).withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False)))
    kind = source.schema["doc_id"].dataType.simpleString()
    scored = source.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents, all columns, that the model does not reject. Only texts leave the JVM, one truth value comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    good = each_text(lambda raw: shared.value.score(raw or b"") >= 0.5, pa.bool_())
    return docs.where(good(F.col(text_col)))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    from glyphmill.llm._common import read

    docs = read(spark, sf_dir, "documents")
    return quality_scores(docs, fit(docs, read(spark, sf_dir, "labels")))
