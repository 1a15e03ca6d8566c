"""Exact top-k inner products by block-at-a-time pruning.

Vectors become whole numbers (floor of ``scale`` times each component). Rows are ordered by the pivot that they are most
similar to (``PIVOTS`` rows, the least in a hash of their id), then by id, so near rows share a range. Ranges of that order
form blocks; a block keeps its rows as a forward index (ids and a matrix) and each component's maximum and minimum.
For a query, the sum over components of the greatest product within a block's range bounds every score in the block.
Each query takes the blocks at hand in descending order of that bound and stops at the first block whose bound is below
its kth score so far; an equal bound is still scored, as ties go to smaller ids. Pivots decide only which rows share
a block, so the result is exact whatever they are. The best k of each partition are then ranked over all partitions.

Where vectors are spread evenly over all directions, as in the synthetic tables, no block's bound falls below a kth
score and every pair is scored; where they gather, most blocks are skipped.

Scale: blocks are written once; queries are taken in batches of at most ``QUERY_BATCH`` and broadcast, one pass over
the blocks for each batch, whose broadcast goes before the next one's. A task reads its blocks ``HELD`` at a time.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows
without an id; only vectors of the query's dimension are compared; a candidate with the query's own id is
the query's own row; a repeated row is a candidate each time, and a repeated query id is asked once for
each distinct vector; fewer candidates than k give fewer rows; very long vectors are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm._common import Workspace, partitions

BLOCK, QUERY_BATCH, PIVOTS, HELD = 64, 16_384, 256, 256
BLOCKS = "dim int, ids binary, matrix binary, top binary, low binary"
EXACT = float(2**53)


def _ordered(rows: DataFrame, pivots: int) -> DataFrame:
    """rows (vec_id, v) with the place of the pivot of the same dimension that each is most similar to."""
    by: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(pivots).collect():
        by.setdefault(len(r["v"]), []).append(r["v"])
    shared = rows.sparkSession.sparkContext.broadcast({d: np.array(v, float) for d, v in by.items()})

    def near(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column), np.int32)
        groups: dict[int, list[int]] = {}
        vectors = column.to_pylist()
        for i, v in enumerate(vectors):
            groups.setdefault(len(v), []).append(i)
        for d, at in groups.items():
            if d in shared.value:
                out[at] = (np.array([vectors[i] for i in at], float) @ shared.value[d].T).argmax(1)
        return pa.array(out)

    @F.arrow_udf("int")
    def pivot(column: pa.Array) -> pa.Array:
        return near(column)

    return rows.withColumn("pivot", pivot("v"))


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """rows (vec_id, v, pivot) in order -> blocks of one dimension and pivot; whole numbers in as few bytes as they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, tuple[int, list, list]] = {}

        def emit(dim: int) -> pa.RecordBatch:
            _, ids, vectors = by.pop(dim)
            m = np.array(vectors, np.int64)
            top, low = m.max(0), m.min(0)
            kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= low.min() and top.max() <= np.iinfo(k).max)
            raw = [np.array(ids, np.int64).tobytes(), m.astype(kind).tobytes(), top.tobytes(), low.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([x], pa.binary()) for x in raw)], names=["dim", "ids", "matrix", "top", "low"])

        for batch in batches:
            for i, v, pivot in zip(batch["vec_id"].to_pylist(), batch["v"].to_pylist(), batch["pivot"].to_pylist(), strict=True):
                d = len(v)
                if d in by and (by[d][0] != pivot or len(by[d][1]) == block):
                    yield emit(d)
                _, ids, vectors = by.setdefault(d, (pivot, [], []))
                ids.append(i)
                vectors.append(v)
        for dim in list(by):
            yield emit(dim)

    return rows.mapInArrow(run, BLOCKS)


def _read(row: dict) -> tuple[np.ndarray, ...]:
    """ids, matrix, top, low of a block."""
    top, low, ids = (np.frombuffer(row[c], np.int64) for c in ("top", "low", "ids"))
    kind = f"<i{len(row['matrix']) // (len(ids) * row['dim'])}"
    return ids, np.frombuffer(row["matrix"], kind).reshape(-1, row["dim"]).astype(np.int64), top, low


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer product; in doubles where all sums are exact there."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.count = np.zeros(n, np.int64)

    def kth(self, q: np.ndarray) -> np.ndarray:
        return np.where(self.count[q] >= self.k, self.score[q, self.k - 1], np.iinfo(np.int64).min)

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        use = ids[None, :] != own[:, None]
        if scores.shape[1] > self.k:
            ranked = np.where(use, scores, np.iinfo(np.int64).min)
            use &= scores >= np.partition(ranked, -self.k, axis=1)[:, -self.k][:, None]
        row, col = np.nonzero(use)
        old_row, old_col = np.nonzero(np.arange(self.k)[None, :] < self.count[q][:, None])
        r = np.concatenate([old_row, row])
        s = np.concatenate([self.score[q][old_row, old_col], scores[row, col]])
        i = np.concatenate([self.id[q][old_row, old_col], ids[col]])
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < self.k
        r, s, i, place = r[keep], s[keep], i[keep], place[keep]
        self.score[q[r], place], self.id[q[r], place] = s, i
        self.count[q] = np.bincount(r, minlength=len(q))


def search(best: _Best, ids: np.ndarray, queries: np.ndarray, blocks: list) -> int:
    """blocks: (ids, matrix, top, low); each query takes them in the order of its bounds. The number of pairs scored."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = np.stack([_product(up, t[None])[:, 0] + _product(down, w[None])[:, 0] for _, _, t, w in blocks], 1)
    order = np.argsort(-bound, axis=1, kind="stable")
    live, scored = np.arange(len(ids)), 0
    for r in range(len(blocks)):
        at = order[live, r]
        go = bound[live, at] >= best.kth(live)
        live, at = live[go], at[go]
        if not len(live):
            break
        by = np.argsort(at, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
            q, b = live[part], at[part[0]]
            scored += len(q) * len(blocks[b][0])
            best.add(q, _product(queries[q], blocks[b][1]), blocks[b][0], ids[q])
    return scored


def top_k(
    vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``, against all rows."""
    spark = vectors.sparkSession
    work = Workspace(spark)
    v = F.col(vector_col)
    rows = (
        vectors.where(F.col(id_col).isNotNull() & (F.size(v) > 0))
        .where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    )
    ordered = _ordered(rows, PIVOTS).repartitionByRange(partitions(spark), "pivot", "vec_id").sortWithinPartitions("pivot", "vec_id")
    index = work.cut(_blocks(ordered, block))
    asked = rows.where(F.col("vec_id") % every == 0).distinct()

    def batches_of_queries() -> Iterator[list]:
        batch = []
        for row in asked.toLocalIterator():
            batch.append((row["vec_id"], row["v"]))
            if len(batch) == QUERY_BATCH:
                yield batch
                batch = []
        yield batch

    out = None
    for batch in batches_of_queries():
        by: dict[int, tuple[list, list]] = {}
        for i, x in batch:
            ids, vs = by.setdefault(len(x), ([], []))
            ids.append(i)
            vs.append(x)
        shared = spark.sparkContext.broadcast({d: (np.array(i, np.int64), np.array(x, np.int64)) for d, (i, x) in by.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {d: _Best(len(ids), k) for d, (ids, _) in shared.value.items()}
            for part in batches:
                for at in range(0, part.num_rows, HELD):
                    held: dict[int, list] = {}
                    for row in part.slice(at, HELD).to_pylist():
                        if row["dim"] in best:
                            held.setdefault(row["dim"], []).append(_read(row))
                    for d, blocks in held.items():
                        search(best[d], *shared.value[d], blocks)
            for d, b in best.items():
                r, c = np.nonzero(np.arange(k)[None, :] < b.count[:, None])
                ids = shared.value[d][0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.astype(np.int64)), pa.array(ids[r]), pa.array(b.id[r, c]), pa.array(b.score[r, c])], names=["q", "query_id", "vec_id", "score"]
                )

        found = index.mapInArrow(run, "q long, query_id long, vec_id long, score long")
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")))
        ranked = ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        if len(batch) == QUERY_BATCH:  # more may come: only one batch is held at a time
            ranked = work.cut(ranked)
            shared.destroy()
        out = ranked if out is None else out.union(ranked)
    return out


def op9_topk(spark, sf_dir: str) -> DataFrame:
    from glyphmill.llm._common import read

    return top_k(read(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH t AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM t q JOIN t c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
