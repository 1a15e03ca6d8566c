"""Removal of repeated passages: every byte covered by a string of ``width`` bytes that starts anywhere else.

1. Of all the ``GRAM``-byte grams within a window of ``width`` bytes, the least in a hash is its anchor, so
   equal windows have equal anchors at equal places. Neighbouring windows share anchors: about one gram in
   85 is one. A first scan counts the anchors' hashes; those seen twice go into a bit map.
2. A second scan yields, for each anchor in the map, its run of windows as one piece of text (the bytes that
   the run covers). Equal pieces are counted first: all windows of a piece with two places are repeated.
3. Distinct pieces of one anchor are joined, each with an end symbol of its own, and suffix sorted (see
   ``suffix_array``): equal windows are then neighbours, which a direct comparison confirms.
4. Anchors with more than ``PIECES`` distinct pieces are dealt into chunks, sorted each by itself. What is
   distinct within a chunk meets again under longer common cores (cells of the anchor's offset, finer in
   each round; the last are the windows themselves), so no group is ever gathered in one task.
5. Covered ranges go back to the texts by a join on the text's hash; equal texts have equal ranges.
Equal pieces are told by 128 bits of a digest, and equal texts likewise; windows are compared byte by byte.

Scale: shuffled are one number for each anchor and the pieces of repeated anchors, then the texts of ``width`` bytes
or more once to meet their ranges. Rows of a hot anchor, piece or text (see ``join_hot``) stay where they are and meet a
broadcast of its few rows. The bit map has 16 bits for each repeated anchor and at most ``2 ** MOST_BITS`` bits;
beyond that a shuffled semi-join with the repeated anchors drops what the map lets through.

Defined cases: a null text has no bytes; texts shorter than ``width`` keep all; every copy of a repeated row
is removed alike; touching ranges are one run; matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._common import Workspace, hot_keys, join_hot, slot, texts
from glyphmill.llm.suffix_array import suffix_array

WIDTH, GRAM = 200, 32
PIECES = 256  # distinct pieces that are sorted together
MOST_BITS = 30
CHUNK = 4 << 20  # bytes of text that are hashed at once; positions have 24 bits
CELLS = (43, 11, 3, 1)  # offsets that share a key in each further round

_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOW = np.uint64(0xFFFFFF)


def _grams(raw: bytes) -> np.ndarray:
    """The hash of every GRAM bytes."""
    n = len(raw) - GRAM + 1
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    h = words[:n] * _MUL[0]
    for k in range(1, GRAM // 8):
        h += words[8 * k : 8 * k + n] * _MUL[k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def runs(raw: bytes, ends: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end (ends: where each ends): each run's anchor hash, anchor, first and last window."""
    empty = (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    if len(raw) < width:
        return empty
    h, span = _grams(raw), width - GRAM + 1
    rank = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    short = -len(rank) % span
    rows = np.concatenate([rank, np.full(short, 2**64 - 1, np.uint64)]).reshape(-1, span)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(raw) - width + 1
    anchor = (np.minimum(tail[:n], head[span - 1 : span - 1 + n]) & _LOW).astype(np.int64)
    inside = np.ones(n + 1, np.int8)
    for end in ends:
        inside[max(0, end - width + 1) : end] = 0
    inside[n] = 0
    inside = inside.astype(bool)
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    change[1:n] = anchor[1:] != anchor[:-1]
    before = np.concatenate([[False], inside[:-1]])
    first = np.flatnonzero(inside[:n] & (change[:n] | ~before[:n]))
    last = np.flatnonzero(inside[:n] & (change[1:] | ~inside[1:]))
    p = anchor[first]
    return h[p], p, first, last


def _laid(raws: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Texts laid end to end up to CHUNK bytes: (number of the first text, bytes, ends). Longer ones come alone."""
    part, size, first = [], 0, 0
    for k, raw in enumerate(raws):
        if part and size + len(raw) > CHUNK:
            yield first, b"".join(part), np.cumsum([len(x) for x in part])
            part, size, first = [], 0, k
        part.append(raw)
        size += len(raw)
    if part:
        yield first, b"".join(part), np.cumsum([len(x) for x in part])


def _anchored(raws: list[bytes], width: int) -> Iterator[tuple[int, int, bytes, tuple]]:
    """(number of the first text, shift, bytes, runs and the text of each); very long texts in overlapping cuts."""
    most = 12 << 20
    for first, raw, ends in _laid(raws):
        if len(raw) <= most:
            h, p, lo, hi = runs(raw, ends, width)
            yield first, 0, raw, (h, p, lo, hi, np.searchsorted(ends, lo, "right"), ends)
            continue
        span = width - GRAM + 1
        step = most - 4 * width
        for at in range(0, len(raw) - width + 1, step):  # windows [at, at + step) belong to this cut
            a = max(0, at - span)
            cut = raw[a : at + step + width + span]
            h, p, lo, hi = runs(cut, np.array([len(cut)]), width)
            b, e = at - a, at - a + step
            keep = (hi >= b) & (lo < e)
            h, p, lo, hi = h[keep], p[keep], np.maximum(lo[keep], b), np.minimum(hi[keep], e - 1)
            yield first, a, cut, (h, p, lo, hi, np.zeros(len(h), np.int64), np.array([len(cut)]))


def _repeated(docs: DataFrame, width: int, work: Workspace) -> tuple[np.ndarray, DataFrame | None]:
    """A bit map of the hashes of anchors that occur twice or more; and h, n of these, where the map is too full to tell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, (h, *_) in _anchored(texts(batch["text"]), width):
                value, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

    seen = work.cut(docs.select("text").mapInArrow(count, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    wanted = max(20, (seen.count() * 16).bit_length())
    bits = min(MOST_BITS, wanted)
    words = seen.groupBy(F.expr(f"cast(shiftright(h & {2**bits - 1}L, 6) as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63L as int)))").alias("v"))
    found = words.toArrow()
    out = np.zeros(2 ** (bits - 6), np.int64)
    out[found["word"].to_numpy()] = found["v"].to_numpy()
    if bits < wanted:
        return out.view(np.uint64), seen
    work.drop(seen)
    return out.view(np.uint64), None


PIECE = "h long, d1 long, d2 long, k1 long, k2 long, lo int, a int, piece binary"


def _pieces(docs: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """docs (k1, k2, text) -> a row for each run of windows whose anchor is in the map; lo: its first window."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        mask = np.uint64(len(table) * 64 - 1)
        for batch in batches:
            k1, k2 = (batch[k].to_numpy(zero_copy_only=False) for k in ("k1", "k2"))
            for first, shift, raw, (h, p, lo, hi, doc, ends) in _anchored(texts(batch["text"]), width):
                keep = np.flatnonzero((table[(h & mask) >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1))
                if not len(keep):
                    continue
                h, p, lo, hi, doc = h[keep], p[keep], lo[keep], hi[keep], doc[keep]
                starts = np.concatenate([[0], ends])[doc] - shift
                pieces = [raw[i : j + width] for i, j in zip(lo.tolist(), hi.tolist())]
                a = (p - lo).tolist()
                digests = b"".join(xxhash.xxh3_128_digest(x, seed=s) for x, s in zip(pieces, a))
                d = np.frombuffer(digests, ">i8").reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h.view(np.int64)),
                        pa.array(d[:, 0]),
                        pa.array(d[:, 1]),
                        pa.array(k1[first + doc]),
                        pa.array(k2[first + doc]),
                        pa.array((lo - starts).astype(np.int32)),
                        pa.array(a, pa.int32()),
                        pa.array(pieces, pa.binary()),
                    ],
                    names=["h", "d1", "d2", "k1", "k2", "lo", "a", "piece"],
                )

    return docs.mapInArrow(find, PIECE)


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    d = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (d.bit_length() + 7) // 8


def _reach(sides: list[bytes]) -> list[int]:
    """For each side, the longest common prefix with any other."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out = [0] * len(sides)
    for i, j in zip(order, order[1:]):
        n = _common(sides[i], sides[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def equal_windows(rows: list[tuple], width: int) -> list[list[tuple[int, int]]]:
    """Classes of equal windows, of two or more, as (row, window).

    rows: (piece, anchor's place, first window, end of windows); windows of a row all hold its anchor.
    """
    left = _reach([p[r0:a][::-1] for p, a, r0, _ in rows])
    right = _reach([p[a : r1 - 1 + width] for p, a, _, r1 in rows])
    symbols: list[int] = []
    raw, owner = [], []
    at = 0
    for i, (p, a, r0, r1) in enumerate(rows):
        b, e = max(r0, a - left[i]), min(r1 - 1 + width, a + right[i])
        if e - b < width:
            continue
        part = p[b:e]
        raw.append(part)
        raw.append(b"\0")
        owner.append((at, i, b, e))
        symbols += [c + len(rows) for c in part]
        symbols.append(i)
        at += e - b + 1
    if len(owner) < 2:
        return []
    text, starts = b"".join(raw), np.array([o[0] for o in owner])
    row_of = np.searchsorted(starts, np.arange(len(symbols)), "right") - 1
    room = np.array([o[0] + o[3] - o[2] for o in owner])[row_of] - np.arange(len(symbols))
    order = np.array(suffix_array(symbols))
    order = order[room[order] >= width]
    out: list[list[tuple[int, int]]] = []
    last, run = None, []
    for s in order.tolist():
        w = text[s : s + width]
        if w != last:
            if len(run) > 1:
                out.append(run)
            last, run = w, []
        o = owner[row_of[s]]
        run.append((o[1], o[2] + s - o[0]))
    if len(run) > 1:
        out.append(run)
    return out


def _intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


ROUND = "kind int, key long, h long, d1 long, d2 long, r0 int, r1 int, a int, whole boolean, piece binary"
NAMES = ["kind", "key", "h", "d1", "d2", "r0", "r1", "a", "whole", "piece"]
TYPES = [pa.int32(), *[pa.int64()] * 4, *[pa.int32()] * 3, pa.bool_(), pa.binary()]


def _cells(h: int, piece: bytes, a: int, r0: int, r1: int, cell: int, width: int) -> Iterator[tuple[int, int, int]]:
    """Windows [r0, r1) by cells of the anchor's offset: (key, r0, r1); the key holds the cell's common core."""
    r = r0
    while r < r1:
        c = (a - r) // cell  # offset of the anchor in window r
        end = min(r1, a - c * cell + 1)
        core = piece[max(0, a - c * cell) : a - c * cell - cell + 1 + width]
        yield xxhash.xxh3_64_intdigest(core, seed=(h ^ c * 2654435761) & (2**64 - 1)) - 2**63, r, end
        r = end


def _sort_round(rows: DataFrame, cell: int | None, width: int) -> DataFrame:
    """rows (key, parts, salt, h, d1, d2, r0, r1, a, whole, piece), dealt and sorted by key and salt.

    Gives kind 0: windows [r0, r1) of a piece that are repeated; kind 1: distinct windows of a chunk, under
    their keys of the next round.
    """

    def solve(group: list[dict], emit) -> None:
        if len(group) < 2 and group[0]["parts"] == 1:
            return
        items = [(g["piece"], g["a"], g["r0"], g["r1"]) for g in group]
        repeated = [np.full(g["r1"] - g["r0"], g["whole"]) for g in group]
        mine = [np.ones(g["r1"] - g["r0"], bool) for g in group]
        for same in equal_windows(items, width) if len(group) > 1 else ():
            for k, (i, r) in enumerate(same):
                repeated[i][r - items[i][2]] = True
                mine[i][r - items[i][2]] = k == 0
        for g, rep, own in zip(group, repeated, mine):
            base, key = g["r0"], (g["h"], g["d1"], g["d2"])
            if not g["whole"]:
                for x, y in _intervals(rep):
                    emit((0, None, *key, base + x, base + y, None, None, None))
            if g["parts"] > 1:
                for whole in (False, True):
                    for x, y in _intervals(own & (rep == whole)):
                        for k, r0, r1 in _cells(g["h"], g["piece"], g["a"], base + x, base + y, cell, width):
                            emit((1, k, *key, r0, r1, g["a"], whole, g["piece"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(NAMES)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], names=NAMES)
            out.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                if group and (row["key"], row["salt"]) != (group[0]["key"], group[0]["salt"]):
                    solve(group, out.append)
                    group = []
                    if len(out) > 20_000:
                        yield flush()
                group.append(row)
        if group:
            solve(group, out.append)
        yield flush()

    return rows.mapInArrow(run, ROUND)


def _dealt(rows: DataFrame, work: Workspace) -> DataFrame:
    """rows (written), with parts and salt by the size of the key's group; keys of one row are left out; sorted by key
    and salt."""
    sizes = work.cut(rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    hot = hot_keys(sizes, ["key"], "m", rows.count())
    rows = join_hot(rows, sizes, ["key"], hot).withColumn("parts", F.ceil(F.col("m") / PIECES).cast("int"))
    rows = rows.withColumn("salt", F.pmod("d1", "parts").cast("int")).drop("m")
    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt")


def _covered(docs: DataFrame, width: int, work: Workspace) -> tuple[DataFrame, list[int]]:
    """docs (k1, k2, text) -> k1, k2, spans (start, end): ranges of repeated windows; and the hot texts."""
    bits, seen = _repeated(docs, width, work)
    pieces = _pieces(docs, bits, width)
    if seen is not None:
        often = hot_keys(seen, ["h"], "n", seen.agg(F.sum("n")).first()[0])
        pieces = join_hot(work.cut(pieces), seen.select("h"), ["h"], often, "left_semi")
    pieces = work.cut(pieces)
    kinds = work.cut(
        pieces.groupBy("h", "d1", "d2").agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("piece").alias("piece"))
        .select("h", "d1", "d2", "a", "piece", "n", (F.col("n") > 1).alias("whole"), F.lit(0).alias("r0"), (F.length("piece") - width + 1).alias("r1"))
    )
    found = [kinds.where("whole").select("d1", "d2", "r0", "r1")]
    rows, done = kinds.drop("n").withColumn("key", F.col("h")), []
    for cell in (*CELLS, None):
        if cell is None:  # single windows: equal ones are repeats
            one = rows.withColumn("window", F.substring("piece", F.col("r0") + 1, F.lit(width)))
            again = one.groupBy("key", "window").agg(F.count("*").alias("m")).where("m > 1").drop("m")
            found.append(one.where("not whole").join(again, ["key", "window"]).select("d1", "d2", "r0", "r1"))
            break
        done.append(work.cut(_sort_round(_dealt(rows, work), cell, width)))
        found.append(done[-1].where("kind = 0").select("d1", "d2", "r0", "r1"))
        rows = done[-1].where("kind = 1").select("key", "h", "d1", "d2", "a", "piece", "whole", "r0", "r1")
        if rows.isEmpty():
            break
    ranges = work.cut(reduce(DataFrame.union, found))
    hot = hot_keys(kinds.groupBy("d1", "d2").agg(F.sum("n").alias("n")), ["d1", "d2"], "n", pieces.count())
    places = join_hot(pieces.select("d1", "d2", "k1", "k2", "lo"), ranges, ["d1", "d2"], hot)
    spans = work.cut(
        places.groupBy("k1", "k2")
        .agg(F.collect_set(F.struct((F.col("lo") + F.col("r0")).alias("start"), (F.col("lo") + F.col("r1") - 1 + width).alias("end"))).alias("spans"))
    )
    copies = pieces.groupBy("k1", "k2", "lo").agg(F.count("*").alias("n")).groupBy("k1", "k2").agg(F.max("n").alias("n"))
    often = hot_keys(copies, ["k1", "k2"], "n", docs.count())
    work.drop(pieces, kinds, ranges, *done)
    return spans, often


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept binary]."""
    work = Workspace(docs.sparkSession)
    keyed = slot(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    spans, often = _covered(keyed.select("k1", "k2", "text"), width, work)
    kind = keyed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, count, digest, rest = [], [], [], [], []
            for raw, found in zip(texts(batch["text"]), batch["spans"].to_pylist(), strict=True):
                ranges = merged([(s["start"], s["end"]) for s in found or ()])
                kept, at = [], 0
                for a, b in ranges:
                    kept.append(raw[at:a])
                    at = b
                whole = b"".join(kept) + raw[at:]
                n.append(len(raw))
                removed.append(len(raw) - len(whole))
                count.append(len(ranges))
                digest.append(hashlib.sha256(whole).hexdigest())
                rest.append(whole)
            columns = [batch["doc_id"], *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(rest, pa.binary())] * keep_text, names=names + ["kept"] * keep_text)

    long = F.coalesce(F.octet_length("text"), F.lit(0)) >= width  # shorter texts keep all and are not shuffled
    met = join_hot(keyed.where(long), spans, ["k1", "k2"], often, "left").select("doc_id", "text", "spans")
    short = keyed.where(~long).select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return met.union(short).mapInArrow(cut, schema)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from glyphmill.llm._common import read

    return remove_repeats(read(spark, sf_dir, "documents"))
