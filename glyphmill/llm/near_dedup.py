"""Near-duplicate documents by a signature-coordinate inverted join over MinHash signatures.

1. One scan gives each document the size and digest of its shingle set and a signature of ``COORDINATES``
   minima. Documents with equal sets form a class, and only one signature per class goes on.
2. Each class is posted under its (coordinate, value) pairs. A pair of classes counts as a candidate if it
   agrees on at least ``MATCHES`` coordinates. Two such signatures agree on at least one of the first
   ``COORDINATES - MATCHES + 1`` pairs of each under any common order, so only that prefix is posted, in
   order of rarity: pairs that one class alone has are skipped, and very frequent values (a passage that
   many documents share) fall behind the prefix.
3. A posting list is merged against its leader, the member whose values are the most frequent, instead of
   member with member. Links found so give components. Members of lists that still span several components
   go through an exact prefix filter on their full sets, which yields pairs across components only.
4. Candidates are confirmed on the full shingle sets, then components give the result.

For a similarity of exactly 0.8 the chance that a pair agrees on fewer than 36 of 64 coordinates is 4.2e-6.

Scale: text is scanned twice and never shuffled (the second scan keeps only documents in a candidate pair,
by a broadcast of their ids up to ``BROADCAST_IDS``, by a shuffled semi-join beyond). Posting lists are
never collected; counts are pre-aggregated, and rows of a hot digest or value (see ``join_hot``) stay where they
are and meet a broadcast of its few rows. Ids may be of any ordered type.

Defined cases: no words or null text: no shingles, linked with nothing; fewer words than a shingle: the
whole sequence is one shingle; very long texts are read whole; repeated rows are equal sets; rows with one doc_id
are one node; a null
doc_id never is a representative, and its row gets the least doc_id of its equal sets, if any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from glyphmill.llm._common import Workspace, hot_keys, join_hot, join_salted, slot, texts
from glyphmill.llm._graph import components

COORDINATES, MATCHES = 64, 36
BROADCAST_IDS = 2_000_000  # 16 MB of ids

_RNG = np.random.Generator(np.random.PCG64(20240229))
_MUL = (_RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_XOR = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)[:, None]
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Word -> 64-bit hash; forgets everything when large, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, size: int, hashes: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the white space \x20 \x09-\x0d
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mix(h * _STEP + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least value of each coordinate's hash."""
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 4096):
        x = s[None, i : i + 4096] ^ _XOR
        np.multiply(x, _MUL, out=x)
        np.minimum(least, x.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


SKETCH = "doc_id {}, n_shingles long, digest binary, sig array<int>"


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def sketches(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, digests, sigs = [], [], []
                for text in texts(part["text"]):
                    s = shingles(text, size, hashes)
                    n.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sigs.append(signature(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))],
                    names=["doc_id", "n_shingles", "digest", "sig"],
                )

    return docs.mapInArrow(run, SKETCH.format(_kind(docs)))


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, s: the full shingle set as an array of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                s = [shingles(t, size, hashes).view(np.int64) for t in texts(part["text"])]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(s, pa.list_(pa.int64()))], names=["doc_id", "s"])

    return docs.mapInArrow(run, f"doc_id {_kind(docs)}, s array<long>")


def _tokens(reps: DataFrame) -> DataFrame:
    """rep, token: each class under all its (coordinate, value) pairs."""
    return reps.select("rep", F.posexplode("sig").alias("k", "v")).select(
        "rep", (F.col("k").cast("long") * F.lit(2**32) + F.col("v").cast("long")).alias("token")
    )


def _posts(reps: DataFrame, shared: DataFrame, hot: list[int]) -> DataFrame:
    """rep, pop, token: each class under the rarest shared pairs of its prefix. shared: token, df."""
    prefix = COORDINATES - MATCHES + 1
    ranked = (
        join_hot(_tokens(reps), shared, ["token"], hot)
        .groupBy("rep")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"), F.sum("df").alias("pop"))
        .where(F.size("t") > COORDINATES - prefix)  # else all of the prefix is its own
        .select("rep", "pop", F.explode(F.slice("t", F.lit(1), F.size("t") - (COORDINATES - prefix))).alias("t"))
    )
    return ranked.select("rep", "pop", F.col("t.token").alias("token"))


def _both_sides(pairs: DataFrame, side) -> DataFrame:
    """pairs (a, b), written, with the columns of side(name) for each; a leader of many pairs is dealt to several tasks."""
    total = pairs.count()
    hot = lambda x: hot_keys(pairs.groupBy(x).agg(F.count("*").alias("m")), [x], "m", total)
    return join_salted(join_salted(pairs, side("a"), ["a"], hot("a"), "b"), side("b"), ["b"], hot("b"), "a")


def _agree(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose sizes allow the similarity and whose signatures agree often enough."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("sig").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    size = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return _both_sides(pairs, side).where(size).where(same >= MATCHES).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets (doc_id, s) have the similarity."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("s").alias(f"s{x}"))
    both = F.size(F.array_intersect("sa", "sb"))
    return _both_sides(pairs, side).where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b").distinct()


def _confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int, work: Workspace) -> DataFrame:
    """Of the candidate pairs (cut), those whose full sets have the similarity."""
    ids = work.cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())
    few = ids.count() <= BROADCAST_IDS
    sets = work.cut(sets_of(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), size))
    links = work.cut(_similar(pairs, sets, percent))
    work.drop(ids, sets)
    return links


def _across(lists: DataFrame, docs: DataFrame, tested: DataFrame, size: int, percent: int, work: Workspace) -> DataFrame:
    """Links between members of different components (token, rep, c) that share a list, but for tested pairs.

    Among these documents an exact prefix filter on the full sets stands in for member-with-member merging:
    with shingles in order of rarity, a pair of the similarity shares one within the first n - ceil(n * percent) + 1
    of each, at places that leave room for the overlap that their sizes require. Shingles of one document
    alone come first, so copies with edits of their own seldom meet under a shingle that all copies have.
    """
    members = work.cut(lists.select(F.col("rep").alias("doc_id"), "c").distinct())
    few = members.count() <= BROADCAST_IDS
    ids = members.select("doc_id")
    sets = work.cut(sets_of(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), size).join(members, "doc_id"))
    rows = sets.select("doc_id", F.size("s").alias("n"), "c", F.explode("s").alias("h"))
    shared = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    own = F.col("n") - F.size("t")  # shingles of this document alone, at the front
    posts = work.cut(
        rows.join(shared, "h")
        .groupBy("doc_id", "n", "c")
        .agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("t"))
        .withColumn("own", own)
        .withColumn("room", F.expr(f"n - cast(ceil(n * {percent} / 100) as int) + 1") - F.col("own"))
        .where("room > 0")
        .select("doc_id", "n", "c", "own", F.posexplode(F.slice("t", F.lit(1), F.col("room"))).alias("k", "t"))
        .select("doc_id", "n", "c", (F.col("own") + F.col("k")).alias("i"), F.col("t.h").alias("h"))
    )
    x, y = posts.alias("x"), posts.alias("y")
    room = f"(1 + least(x.n - x.i - 1, y.n - y.i - 1)) * {100 + percent} >= {percent} * (x.n + y.n)"
    pairs = work.cut(
        x.join(y, F.expr(f"x.h = y.h and x.doc_id > y.doc_id and x.c != y.c and {room}"))
        .select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
        .distinct()
        .join(tested, ["a", "b"], "left_anti")
    )
    links = work.cut(_similar(pairs, sets, percent))
    work.drop(members, sets, posts, pairs)
    return links


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """Per document row: doc_id, n_shingles, digest (of its set), component_id, kept."""
    work = Workspace(docs.sparkSession)
    docs = slot(docs, id_col, text_col)
    sketch = work.cut(sketches(docs, shingle))
    classes = work.cut(
        sketch.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("m"))
    )
    often = hot_keys(classes, ["digest"], "m", sketch.count())
    classes = classes.drop("m")
    own = ["digest", "doc_id"]  # a key that copies do not share
    reps = work.cut(
        sketch.join(classes.withColumnRenamed("class_id", "doc_id"), own, "left_semi")
        .dropDuplicates(own)
        .select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sig")
    )
    shared = work.cut(_tokens(reps).groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    hot = hot_keys(shared, ["token"], "df", reps.count() * COORDINATES)
    posts = work.cut(_posts(reps, shared, hot))
    pair = lambda a, b: [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]

    # each list against its leader
    lead = posts.groupBy("token").agg(F.max(F.struct("pop", "rep")).alias("l"), F.count("*").alias("m")).where("m > 1")
    stars = work.cut(join_hot(posts, lead.select("token", F.col("l.rep").alias("leader")), ["token"], hot).where("rep != leader").select(*pair("rep", "leader")).distinct())
    near = work.cut(_agree(stars, reps, percent))
    links = _confirm(near, docs, shingle, percent, work)
    found = work.cut(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), work))

    # lists that still span components: pairs across components
    at = posts.join(found, F.col("rep") == F.col("node"), "left").select("token", "rep", F.coalesce("component", "rep").alias("c"))
    split = at.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("token")
    open_lists = work.cut(join_hot(at, split, ["token"], hot))
    rest = _across(open_lists, docs, near, shingle, percent, work)
    links = links.union(rest).select(F.col("a").alias("u"), F.col("b").alias("v"))
    # rows with one id are one node, whatever their texts
    several = sketch.where("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo != hi")
    split_ids = work.cut(several.select("doc_id"))
    if not split_ids.isEmpty():
        of = sketch.join(split_ids, "doc_id", "left_semi").where("digest is not null").join(classes, "digest").where("doc_id != class_id")
        links = links.union(of.select(F.greatest("doc_id", "class_id").alias("u"), F.least("doc_id", "class_id").alias("v")))
    groups = components(links, work)
    classes = work.cut(
        classes.join(groups, F.col("class_id") == F.col("node"), "left").select("digest", F.coalesce("component", "class_id").alias("group_id"))
    )
    component = F.coalesce("group_id", "doc_id")
    out = join_hot(sketch.drop("sig"), classes, ["digest"], often, "left").select(
        "doc_id", "n_shingles", "digest", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
    work.drop(reps, shared, posts, stars, near, found, open_lists)
    return out


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    from glyphmill.llm._common import read

    return near_groups(read(spark, sf_dir, "documents"), shingle=4).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, without all but one of each group of near copies.

    Rows without an id cannot be named as copies and stay; of rows equal in id and text one stays. Texts are
    shuffled only where an id is repeated, or where the ids to drop are too many to broadcast.
    """
    work = Workspace(docs.sparkSession)
    found = near_groups(docs, id_col, text_col, shingle, percent).where("doc_id is not null")
    ids = found.groupBy(F.col("doc_id").alias("_gm_id")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    odd = work.cut(ids.where("not kept or n > 1"))
    few = odd.count() <= BROADCAST_IDS
    side = lambda rows: F.broadcast(rows.select("_gm_id")) if few else rows.select("_gm_id")
    same = F.col(id_col) == F.col("_gm_id")
    again = odd.where("kept and n > 1")
    if again.isEmpty():
        return docs.join(side(odd), same, "left_anti")
    first = W.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.col(id_col))
    repeated = docs.join(side(again), same, "left_semi").withColumn("_gm_row", F.row_number().over(first)).where("_gm_row = 1").drop("_gm_row")
    return docs.join(side(odd), same, "left_anti").unionByName(repeated)
