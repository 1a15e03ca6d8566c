"""Language-model scores: a gated recurrent network with a class-factored softmax, in numpy.

Words are those of the lower-cased text, then one end token. Training counts of all words come from one
aggregation. The ``VOCAB`` most frequent are the network's words, in classes by frequency; all others form
one class more, within which a word has (count + 1) / (sum of count + 1 over the class, and 1 for words not
seen). So the model is a proper distribution over every word:
P(word) = P(class | state) * P(word | class, state), or P(rest | state) * P(word | rest).

Training is truncated backpropagation over every token of every training document, in windows of ``WINDOW``;
the state is carried from window to window to the document's end. Shards of about ``SHARD`` tokens in whole
documents are trained side by side and averaged by their tokens, ``ROUNDS`` times. Scoring runs every document to its
end, many side by side, state carried across windows and reset at each document's start.

Scale: texts are read twice, to count words within tasks and to encode; training and scoring read the encoded
rows. Counts of the most frequent words, at most ``HEAVY``, are broadcast; the remaining words of each document
meet their counts in a shuffled join. The number of shards follows the corpus, and parameters are summed in two
steps, not on the driver. A task holds a shard's numbers (2 bytes a token), a group of ``SCORE_TOKENS`` or one
text's, and a window's states, however long a text is.

Defined cases: a null text is empty and has the end token alone; a null id is not held out; repeated rows
are trained on and scored each; without training rows every count is 0 and the model is the start model. Documents
are dealt to shards evenly, so trained scores depend a little on how the rows are laid out; counts do not.
Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._common import Workspace, slot, texts

CLASSES, SLOTS, HIDDEN = 32, 32, 24
VOCAB = CLASSES * SLOTS
HEAVY = 200_000
WINDOW, ROUNDS = 24, 1
LANES, RATE, SHARD = 256, 0.12, 4_000_000  # a shard's tokens
SCORE_LANES, SCORE_WINDOW, SCORE_TOKENS = 512, 32, 2_000_000
END = xxhash.xxh3_64_intdigest(b"\n") - 2**63  # no word holds white space


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


class Network:
    """Gates: update, reset, new. Words: 0 .. VOCAB - 1 by frequency, VOCAB for all others."""

    SHAPES = {
        "e": (VOCAB + 1, 3 * HIDDEN),
        "u": (HIDDEN, 3 * HIDDEN),
        "c": (HIDDEN, CLASSES + 1),
        "cb": (CLASSES + 1,),
        "w": (CLASSES, HIDDEN, SLOTS),
        "wb": (CLASSES, SLOTS),
    }

    def __init__(self, vector: np.ndarray) -> None:
        self.vector, at = vector, 0
        for name, shape in self.SHAPES.items():
            n = math.prod(shape)
            setattr(self, name, vector[at : at + n].reshape(shape))
            at += n

    @classmethod
    def size(cls) -> int:
        return sum(math.prod(s) for s in cls.SHAPES.values())

    @classmethod
    def start(cls, counts: np.ndarray, rest: float) -> Network:
        """counts of the words in order, fewer than VOCAB perhaps; rest: tokens of all other words."""
        rng = np.random.default_rng(11)
        net = cls(np.zeros(cls.size(), np.float32))
        net.e[:] = rng.normal(0, 0.3, net.e.shape)
        net.u[:] = rng.normal(0, HIDDEN**-0.5, net.u.shape)
        c = np.zeros(VOCAB)
        c[: len(counts)] = counts
        c = c.reshape(CLASSES, SLOTS)
        with np.errstate(divide="ignore"):
            net.wb[:] = np.where(c > 0, np.log(c), -1e9) - np.log(np.maximum(c.sum(1), 1))[:, None]
            share = np.append(c.sum(1), rest + 1.0)
            net.cb[:] = np.where(share > 0, np.log(np.maximum(share, 1e-9)) - np.log(share.sum()), -1e9)
        return net

    def states(self, xs: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None, keep: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Over words [time, lane] from h [unit, lane]: the state before each word [time, unit, lane], and the last one.

        fresh: where a document's first word stands, so the state before it is that of a start. keep: arrays
        that take the gates, the new values and the state's part in them. Units come before lanes, so gates are contiguous.
        """
        steps, lanes = xs.shape
        kind, two = self.vector.dtype, 2 * HIDDEN
        begins = np.zeros(steps, bool) if fresh is None else fresh.any(1)
        a = np.ascontiguousarray(self.e[xs].transpose(0, 2, 1))
        ut = np.ascontiguousarray(self.u.T)
        hs = np.empty((steps, HIDDEN, lanes), kind)
        zr, n, g = np.empty((two, lanes), kind), np.empty((HIDDEN, lanes), kind), np.empty((3 * HIDDEN, lanes), kind)
        for t in range(steps):
            if begins[t]:
                h = np.where(fresh[t], kind.type(0), h)
            hs[t] = h
            np.matmul(ut, h, out=g)
            if keep is not None:
                zr, n = keep[0][t], keep[1][t]
                keep[2][t] = g[two:]
            np.add(a[t, :two], g[:two], out=zr)
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.multiply(zr[HIDDEN:], g[two:], out=n)
            n += a[t, two:]
            np.tanh(n, out=n)
            h = h - n
            h *= zr[:HIDDEN]
            h += n
        return hs, h

    def log_probs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability after its state [word, unit]; the rest's class alone for other words."""
        order = np.argsort((y // SLOTS).astype(np.int8), kind="stable")
        ft, y = np.ascontiguousarray(h[order].T), y[order]
        cls = y // SLOTS
        p = self.c.T @ ft
        p += self.cb[:, None]
        found = _log_choice(p, cls)
        edges = np.searchsorted(cls, np.arange(CLASSES + 1))
        q = np.empty((SLOTS, edges[CLASSES]), ft.dtype)
        for k in range(CLASSES):
            i = slice(edges[k], edges[k + 1])
            if edges[k] < edges[k + 1]:
                np.matmul(self.w[k].T, ft[:, i], out=q[:, i])
                q[:, i] += self.wb[k][:, None]
        found[: edges[CLASSES]] += _log_choice(q, y[: edges[CLASSES]] % SLOTS)
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradient(self, xs: np.ndarray, ys: np.ndarray, h: np.ndarray, mask: np.ndarray, fresh: np.ndarray | None = None) -> tuple[Network, np.ndarray]:
        """Over a window [time, lane]: the gradient of the mean negative log-likelihood, and the last state.

        fresh: where a document's first word is the target, so the state before it is that of a start.
        """
        grad = Network(np.zeros_like(self.vector))
        steps, lanes = xs.shape
        kind, two = self.vector.dtype, 2 * HIDDEN
        begins = np.zeros(steps, bool) if fresh is None else fresh.any(1)
        zrs, ns, gs = np.empty((steps, two, lanes), kind), np.empty((steps, HIDDEN, lanes), kind), np.empty((steps, HIDDEN, lanes), kind)
        hs, h = self.states(xs, np.ascontiguousarray(h.T), fresh, (zrs, ns, gs))
        total = max(1, int(mask.sum()))
        y = ys.ravel()
        order = np.argsort((y // SLOTS).astype(np.int8), kind="stable")  # targets by class
        flat = hs.transpose(0, 2, 1).reshape(-1, HIDDEN)
        f, y = flat[order], y[order]
        m = mask.ravel()[order].astype(kind) / kind.type(total)
        cls = y // SLOTS
        ft = np.ascontiguousarray(f.T)
        p = self.c.T @ ft
        p += self.cb[:, None]
        _softmax_slope(p, cls, m)
        grad.c += (p @ f).T
        grad.cb += p.sum(1)
        back = self.c @ p
        edges = np.searchsorted(cls, np.arange(CLASSES + 1))
        end = edges[CLASSES]
        q = np.empty((SLOTS, end), kind)
        for k in range(CLASSES):
            i = slice(edges[k], edges[k + 1])
            if edges[k] < edges[k + 1]:
                q[:, i] = self.w[k].T @ ft[:, i]
                q[:, i] += self.wb[k][:, None]
        _softmax_slope(q, y[:end] % SLOTS, m[:end])
        for k in range(CLASSES):
            i = slice(edges[k], edges[k + 1])
            if edges[k] < edges[k + 1]:
                grad.w[k] += (q[:, i] @ f[i]).T
                grad.wb[k] += q[:, i].sum(1)
                back[:, i] += self.w[k] @ q[:, i]
        placed = np.empty_like(flat)
        placed[order] = back.T
        back = placed.reshape(steps, lanes, HIDDEN).transpose(0, 2, 1)
        z, r = zrs[:, :HIDDEN], zrs[:, HIDDEN:]
        # what each step's gates take of the gradient that comes back to the state after it
        to_n = (1 - z) * (1 - ns * ns)
        to_z = (hs - ns) * z * (1 - z)
        to_r = gs * r * (1 - r)
        dh = np.zeros_like(h)
        da = np.empty((steps, 3 * HIDDEN, lanes), kind)
        dg = np.empty((3 * HIDDEN, lanes), kind)
        for t in range(steps - 1, -1, -1):
            x = da[t]
            dn = x[two:]
            np.multiply(dh, to_n[t], out=dn)
            np.multiply(dh, to_z[t], out=x[:HIDDEN])
            np.multiply(dn, to_r[t], out=x[HIDDEN:two])
            dg[:two] = x[:two]
            np.multiply(dn, r[t], out=dg[two:])
            grad.u += hs[t] @ dg.T
            dh *= z[t]
            dh += self.u @ dg
            dh += back[t]
            if begins[t]:
                dh[:, fresh[t]] = 0
        words = xs.ravel()
        order = np.argsort(words.astype(np.int16), kind="stable")
        words = words[order]
        first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        grad.e[words[first]] = np.add.reduceat(da.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)[order], first, axis=0)
        return grad, np.ascontiguousarray(h.T)


def _log_choice(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For logits [choice, target], which are used up: the log of the softmax at y."""
    if not logits.size:
        return np.zeros(len(y), logits.dtype)
    logits -= logits.max(0)
    chosen = logits[y, np.arange(len(y))]
    np.exp(logits, out=logits)
    return chosen - np.log(logits.sum(0))


def _softmax_slope(logits: np.ndarray, y: np.ndarray, m: np.ndarray) -> None:
    """In place: the gradient of m * (negative log-likelihood of y) for logits [choice, target]."""
    if logits.size:
        logits -= logits.max(0)
        np.exp(logits, out=logits)
        logits *= m / logits.sum(0)
        logits[y, np.arange(len(y))] -= m


def _lanes(sizes: list[int], lanes: int) -> list[list[int]]:
    """Items dealt to lanes, the longest first, each to the lane that is shortest so far; the longest lane first."""
    loads = [(0, k) for k in range(min(lanes, len(sizes)))]
    queue: list[list[int]] = [[] for _ in loads]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n, k = heapq.heappop(loads)
        queue[k].append(i)
        heapq.heappush(loads, (n + sizes[i], k))
    return [queue[k] for _, k in sorted(loads, key=lambda x: (-x[0], x[1]))]


def train_shard(net: Network, documents: list[np.ndarray], rate: float = RATE) -> Network:
    """One pass of truncated backpropagation with per-parameter step sizes over whole documents of word numbers.

    Documents follow each other in their lanes, every token is in one window, and the state is carried over
    windows to the document's end.
    """
    net = Network(net.vector.copy())
    documents = [d for d in documents if len(d)]
    if not documents:
        return net
    square = np.full_like(net.vector, 1e-8)
    read = _Windows(documents, LANES)
    h = np.zeros((len(read.sizes), HIDDEN), np.float32)
    for t in range(0, int(read.sizes[0]), WINDOW):
        x, mask, fresh, _ = read(t, WINDOW)
        grad, h = net.gradient(x, x, h[: x.shape[1]], mask, fresh)
        step = np.multiply(grad.vector, grad.vector)
        square += step
        np.sqrt(square, out=step)
        np.divide(grad.vector, step, out=step)
        step *= rate
        net.vector -= step
    return net


class _Windows:
    """Documents laid end to end in lanes, the longest lane first, and read window by window: numbers [time, lane],
    which of them count, where a document begins, and whose they are. Beside the documents, memory is a window's."""

    def __init__(self, documents: list[np.ndarray], lanes: int) -> None:
        queue = _lanes([len(d) for d in documents], lanes)
        self.words = [np.concatenate([documents[i] for i in q]) for q in queue]
        self.owner = [np.repeat(np.array(q, np.int32), [len(documents[i]) for i in q]) for q in queue]
        self.sizes = np.array([len(w) for w in self.words])

    def __call__(self, t: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = int(np.searchsorted(-self.sizes, -t, "left"))  # lanes with more than t words
        length = min(length, int(self.sizes[0]) - t)
        x = np.full((n, length), VOCAB, np.int64)
        who, last = np.full((n, length), -1, np.int32), np.full((n, 1), -1, np.int32)
        for i in range(n):
            part = self.words[i][t : t + length]
            x[i, : len(part)] = part
            who[i, : len(part)] = self.owner[i][t : t + length]
            if t:
                last[i] = self.owner[i][t - 1]
        fresh = (who != np.concatenate([last, who[:, :-1]], 1)) & (who >= 0)
        return tuple(np.ascontiguousarray(a.T) for a in (x, who >= 0, fresh, who))


def score_documents(net: Network, documents: list[np.ndarray], lanes: int = SCORE_LANES, window: int = SCORE_WINDOW) -> np.ndarray:
    """Each document's natural log-likelihood under the network, to its end, from a fresh state."""
    out = np.zeros(len(documents))
    if not documents:
        return out
    read = _Windows(documents, lanes)
    h = np.zeros((HIDDEN, len(read.sizes)), np.float32)
    for t in range(0, int(read.sizes[0]), window):
        x, mask, fresh, who = read(t, window)
        hs, h = net.states(x, h[:, : x.shape[1]], fresh)
        p = net.log_probs(hs.transpose(0, 2, 1).reshape(-1, HIDDEN), x.ravel())
        use = mask.ravel()
        out += np.bincount(who.ravel()[use], p[use], len(out))
    return out


class _Codes(dict):
    """Word -> its place among the heavy words, -1 for others; bounded."""

    def __init__(self, places: dict[int, int]) -> None:
        super().__init__()
        self.places = places

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = c = self.places.get(word_hash(word), -1)
        return c


def _counted(docs: DataFrame) -> DataFrame:
    """Training counts: h, c."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in seen), np.uint64, len(seen)) - np.uint64(2**63)
            batch = pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(list(seen.values()), pa.int64())], names=["h", "c"])
            seen.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for text in texts(batch["text"].slice(at, 512)):
                    seen.update(text.lower().split())
                    seen[b"\n"] += 1
                if len(seen) > 700_000:
                    yield flush()
        yield flush()

    return docs.where("not held_out").select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Counts:
    """N, V, and the most frequent words in order; ``rest``: sum of (count + 1) over words beyond VOCAB, and 1."""

    def __init__(self, counts: DataFrame, heavy: int) -> None:
        exponent = F.floor(F.log2(F.col("c"))).cast("int")
        rows = counts.groupBy(exponent.alias("e")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()
        self.n, self.v = sum(r["n"] for r in rows), sum(r["v"] for r in rows)
        most, self.least = 0, 1
        for r in sorted(rows, key=lambda r: -r["e"]):
            most += r["v"]
            if most > heavy:
                self.least = 2 ** (r["e"] + 1)
                break
        top = counts.where(F.col("c") >= self.least).toArrow()
        h, c = top["h"].to_numpy(), top["c"].to_numpy()
        order = np.lexsort((h, -c))
        self.h, self.c = h[order], c[order]
        self.vocab = min(VOCAB, len(self.h))
        self.rest = float(self.n - self.c[: self.vocab].sum() + self.v - self.vocab + 1)


ENCODED = "uid long, doc_id {}, held_out boolean, n_tokens long, known long, common double, other double, n_other long, words binary, h array<long>, times array<int>"
ENCODED_TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]


def _encoded(source: DataFrame, counts: Counts) -> DataFrame:
    """Per row (uid, doc_id, held_out, text): the whole text as the network's numbers of its words and the end token
    (words, 16 bits each), sums over words whose counts are at hand, and the other words by hash.

    common, other: log10(count + 1) over all heavy words, and over those beyond VOCAB.
    """
    shared = source.sparkSession.sparkContext.broadcast((counts.h, np.append(np.log10(counts.c + 1.0), 0.0)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, log_c = shared.value  # log_c ends with that of place -1: words whose count is looked up later
        codes = _Codes({int(x): i for i, x in enumerate(h)})
        end = codes.places.get(END, -1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for text in texts(part["text"]):
                    words = text.lower().split()
                    c = np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
                    rare = Counter(words[i] for i in np.flatnonzero(c < 0).tolist())
                    hashes, times = [word_hash(w) for w in rare], list(rare.values())
                    if end < 0:
                        hashes.append(END)
                        times.append(1)
                    c = np.append(c, np.int32(end))
                    beyond = c >= VOCAB
                    inside = (c >= 0) & ~beyond
                    numbers = np.where(inside, c, VOCAB).astype("<i2").tobytes()
                    rows.append((len(c), int((c >= 0).sum()), float(log_c[c].sum()), float(log_c[c[beyond]].sum()), int((~inside).sum()), numbers, hashes, times))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), ENCODED_TYPES, strict=True)]
                names = ["uid", "doc_id", "held_out", "n_tokens", "known", "common", "other", "n_other", "words", "h", "times"]
                yield pa.RecordBatch.from_arrays([part["uid"], part["doc_id"], part["held_out"], *columns], names=names)

    return source.mapInArrow(encode, ENCODED.format(source.schema["doc_id"].dataType.simpleString()))


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, weight = np.zeros(Network.size()), 0.0
    for batch in batches:
        for v, w in zip(batch["v"].to_pylist(), batch["weight"].to_pylist(), strict=True):
            total += np.frombuffer(v, np.float64)
            weight += w
    if weight:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([weight])], names=["v", "weight"])


def fit(encoded: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Network:
    """encoded (held_out, words), a written table."""
    spark = encoded.sparkSession
    net = Network.start(counts.c[: counts.vocab], counts.rest)
    shards = max(1, -(-counts.n // SHARD))
    dealt = encoded.where("not held_out").select("words").repartition(shards)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(net.vector)
        rate = RATE / (k + 1)

        def train(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            start, part = Network(shared.value), []
            for batch in batches:
                part += [np.frombuffer(x, "<i2") for x in batch["words"].to_pylist()]
            if part:
                weight = float(sum(map(len, part)))
                out = train_shard(start, part, rate).vector.astype(np.float64) * weight
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([weight])], names=["v", "weight"])

        schema = "v binary, weight double"
        some = dealt.mapInArrow(train, schema).repartition(max(1, math.isqrt(shards))).mapInArrow(_sum, schema)
        rows = some.coalesce(1).mapInArrow(_sum, schema).collect()
        if rows:
            net = Network((np.frombuffer(rows[0]["v"], np.float64) / rows[0]["weight"]).astype(np.float32))
    return net


def _network_scores(encoded: DataFrame, net: Network) -> DataFrame:
    """uid, net: log10 of the network's probability of each row's words, the rest's class alone for words beyond it."""
    shared = encoded.sparkSession.sparkContext.broadcast(net.vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(shared.value)
        ids: list[int] = []
        documents: list[np.ndarray] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(score_documents(model, documents) / math.log(10))], names=["uid", "net"])
            ids.clear()
            documents.clear()
            return batch

        for batch in batches:
            for uid, words in zip(batch["uid"].to_pylist(), batch["words"].to_pylist(), strict=True):
                ids.append(uid)
                documents.append(np.frombuffer(words, "<i2"))
                waiting += len(documents[-1])
                if waiting >= SCORE_TOKENS:
                    yield flush()
                    waiting = 0
        if ids:
            yield flush()

    return encoded.select("uid", "words").mapInArrow(run, "uid long, net double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, modulus: int = 7, left_out: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    work = Workspace(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == left_out, F.lit(False))
    source = slot(docs, id_col, text_col).withColumn("held_out", held)
    table = work.cut(_counted(source))
    counts = Counts(table, heavy)
    # a written table fixes the row numbers that the joins below rely on
    encoded = work.cut(_encoded(source.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text"), counts))
    net = fit(encoded, counts)
    scored = work.cut(_network_scores(encoded, net))
    rare = encoded.select("uid", F.explode(F.arrays_zip("h", "times")).alias("x")).select("uid", F.col("x.h").alias("h"), F.col("x.times").alias("times"))
    looked_up = rare.join(table.where(F.col("c") < counts.least), "h").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare"), F.sum("times").alias("met")
    )
    met, lost = F.coalesce("met", F.lit(0)), F.coalesce("rare", F.lit(0.0))
    return encoded.drop("words", "h", "times").join(scored, "uid").join(looked_up, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + met).alias("n_known"),
        F.lit(counts.n).cast("long").alias("train_tokens"),
        (F.col("common") + lost - F.col("n_tokens") * F.lit(math.log10(counts.n + counts.v + 1))).alias("base_score"),
        (F.col("net") + F.col("other") + lost - F.col("n_other") * F.lit(math.log10(counts.rest))).alias("score"),
    )


def op8_lm(spark, sf_dir: str) -> DataFrame:
    from glyphmill.llm._common import read

    return score(read(spark, sf_dir, "documents"))
