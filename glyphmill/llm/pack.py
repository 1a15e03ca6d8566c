"""Best-fit packing of tokenized documents into sequences, by linear grouping.

A document is its token ids and one end id; a document longer than a sequence is cut into full pieces,
the first being the shorter one. What there is to pack is then fully described by the count of pieces of
each length, a table of at most ``capacity`` rows, on which the driver plans:

1. Large lengths, in descending order, fall into groups of equal cardinality; each length counts as the
   greatest of its group (with few lengths, nothing is rounded).
2. Over these few sizes, configurations of a sequence are optimised: a cutting-stock linear program by
   column generation, whose columns come from a knapsack recurrence. Whole parts of the solution are used.
3. Actual lengths are substituted into the configurations, largest first; the last slot takes the
   greatest length that fits what rounding left over. A configuration is used while actual lengths fill
   it; what then remains stays for step 4.
4. What remains, small lengths above all, goes best-fit in descending order into the fullest gap.

The plan consists of runs: so many pieces of one length, from a rank on, go to consecutive sequences at
one offset. Its size depends on the capacity and the number of groups, not on the corpus. Each piece
gets its rank among those of its length from pre-aggregated counts and a window within small buckets, and
looks its run up.

Defined cases: a null text is an empty document, one piece that holds the end id; repeated rows are packed
each; ids may be null; an empty table gives no pieces; ``<|endoftext|>`` in a text is that special id.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm._common import Workspace, slot

CAPACITY, END = 1024, 2
GROUPS, SMALL = 96, 128  # groups of large lengths; lengths up to SMALL aren't grouped
WASTE = 1  # a configuration is used while its actual lengths leave at most this gap
BUCKET_ROWS, MIN_BUCKETS = 20_000, 64

SPECIAL = "<|endoftext|>"
#: A space between other white space (or at the end): splitting there would change the tokens.
UNSAFE = re.compile(r"\s (?:\s|\Z)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a byte-level BPE file as packed little-endian 32-bit integers.

    The pattern of this family never joins text across a single space, so words are encoded once and
    their ids kept, up to a bounded number of words.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
        byte = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(plain))}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t != SPECIAL}
        self.bpe = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: vocab.get(SPECIAL, len(vocab))})
        encode = self.bpe.encode_ordinary

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) > 250_000:
                    self.clear()
                ids = encode(" " + word)
                out = struct.pack(f"<{len(ids)}I", *ids)
                if len(word) < 64:
                    self[word] = out
                return out

        self.words = Words()

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.array(self.bpe.encode(text, allowed_special={SPECIAL}), "<u4").tobytes()
        if UNSAFE.search(text):
            return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.bpe.encode_ordinary(first), "<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))


PIECE = [
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> a row for each piece, with its ids if asked for."""
    tail = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, text in enumerate(part["text"].to_pylist()):
                    raw = encode(text or "") + tail
                    n = len(raw) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    view = memoryview(raw)
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        row.append(k)
                        piece.append(i)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(view[4 * a : 4 * b]))
                        if keep_ids:
                            ids.append(np.frombuffer(raw, "<i4", b - a, 4 * a))
                columns = [part["doc_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *PIECE]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids
    return docs.mapInArrow(run, T.StructType(fields))


def group_lengths(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal cardinality, in descending order: (greatest length, [(length, count)])."""
    lengths = sorted(counts, reverse=True)
    if len(lengths) <= groups:
        return [(x, [(x, counts[x])]) for x in lengths]
    each = -(-sum(counts.values()) // groups)
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for x in lengths:
        left = counts[x]
        while left:
            if not room:
                out.append((x, []))
                room = each
            n = min(room, left)
            out[-1][1].append((x, n))
            room -= n
            left -= n
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Patterns (copies of each size) and how often each is used in full; some demand is left over."""
    k, s, d = len(sizes), np.array(sizes), np.array(demand, float)
    if not k:
        return []
    basis = np.diag(capacity // s).astype(float)
    x = d / np.diag(basis)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(k))
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(s.min()), capacity + 1):
            fit = s <= c
            gain = np.where(fit, best[np.where(fit, c - s, 0)] + dual, -1.0)
            g = int(gain.argmax())
            if gain[g] > best[c - 1] + 1e-12:
                best[c], pick[c] = gain[g], g
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0 and best[c] > 0:
            if pick[c] < 0:
                c -= 1
                continue
            column[pick[c]] += 1
            c -= int(s[pick[c]])
        step = np.linalg.solve(basis, column)
        able = step > 1e-9
        if not able.any():
            break
        ratio = np.where(able, x / np.where(able, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = column
    left, used = np.array(demand), []
    for j in np.argsort(-x):
        a = basis[:, j].astype(int)
        times = int(min(x[j] + 1e-6, *(left[a > 0] // a[a > 0])))
        if times:
            left -= a * times
            used.append((a, times))
    return used


class Plan:
    """Runs of pieces: (length, first rank, count, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> None:
        self.capacity, self.sequences = capacity, 0
        self.rank: dict[int, int] = defaultdict(int)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, count)]
        self.order: list[int] = []  # gaps with sequences, ascending
        rest = defaultdict(int, {x: n for x, n in counts.items() if x <= small})
        large = {x: n for x, n in counts.items() if small < x}
        grouped = group_lengths(large, groups)
        self.pool, self.lengths = dict(large), sorted(large)
        for copies, times in configurations([g for g, _ in grouped], [sum(n for _, n in v) for _, v in grouped], capacity):
            self._fill([grouped[g][0] for g in np.nonzero(copies)[0] for _ in range(copies[g])], times)
        for x in self.lengths:
            rest[x] += self.pool[x]
        for x in sorted(rest, reverse=True):
            self._best_fit(x, rest[x])

    def _place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], count, sequence, offset))
        self.rank[length] += count

    def _open(self, gap: int, sequence: int, count: int) -> None:
        if count and gap:
            if gap not in self.gaps:
                self.gaps[gap] = []
                bisect.insort(self.order, gap)
            self.gaps[gap].append((sequence, count))

    def _longest(self, most: int, used: list[int]) -> int:
        """The greatest length up to ``most`` of which the pool has more than ``used`` has; 0 if none."""
        at = bisect.bisect_right(self.lengths, most) - 1
        while at >= 0 and self.pool[self.lengths[at]] <= used.count(self.lengths[at]):
            at -= 1
        return self.lengths[at] if at >= 0 else 0

    def _fill(self, slots: list[int], times: int) -> None:
        """Substitute actual lengths, the greatest that each slot takes; the last slot takes all that is left."""
        while times:
            chosen: list[int] = []
            for s in slots[:-1]:
                chosen.append(self._longest(s, chosen))
            chosen.append(self._longest(self.capacity - sum(chosen), chosen))
            if not all(chosen) or self.capacity - sum(chosen) > WASTE:
                return
            n = min(times, *(self.pool[x] // chosen.count(x) for x in chosen))
            offset = 0
            for x in chosen:
                self._place(x, n, self.sequences, offset)
                self.pool[x] -= n
                offset += x
            self._open(self.capacity - offset, self.sequences, n)
            self.sequences += n
            times -= n
            self.lengths = [x for x in self.lengths if self.pool[x]]

    def _best_fit(self, x: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self.order, x)
            if at < len(self.order):
                gap = self.order[at]
                sequence, n = self.gaps[gap].pop()
                if not self.gaps[gap]:
                    del self.gaps[gap], self.order[at]
            else:
                gap = self.capacity
                sequence, n = self.sequences, -(-count // (gap // x))
                self.sequences += n
            each = min(gap // x, count)
            use = min(n, count // each)
            for i in range(each):
                self._place(x, use, sequence, self.capacity - gap + i * x)
            self._open(gap - each * x, sequence, use)
            count -= use * each
            if n > use:
                if gap == self.capacity:
                    self.sequences -= n - use  # new ones that were not needed yet
                else:
                    self._open(gap, sequence + use, n - use)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    keep_ids: bool = False,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 [, ids], sequence_id, offset."""
    spark = docs.sparkSession
    work = Workspace(spark)
    cut = work.cut(pieces(slot(docs, id_col, text_col), tokenizer or default_tokenizer(), capacity, end, keep_ids))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(counts, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((runs[:, 0] * (1 << 44) + runs[:, 1], runs[:, 1], runs[:, 3], runs[:, 4]))

    buckets = max(MIN_BUCKETS, sum(counts.values()) // BUCKET_ROWS)
    order = ["doc_id", "piece", "start", "ids_crc32"]
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy(*order)) - 1)
    ranked = ranked.join(firsts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("first")).select(*cut.columns, "rank")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, sequences, offsets = shared.value
        for batch in batches:
            rank = batch["rank"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, batch["length"].to_numpy(zero_copy_only=False) * (1 << 44) + rank, "right") - 1
            columns = batch.columns[:-1] + [pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(look_up, schema)


def op1_pack(spark, sf_dir: str) -> DataFrame:
    from glyphmill.llm._common import read

    return pack(read(spark, sf_dir, "documents"))
