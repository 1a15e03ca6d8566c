"""Secret scans: fixed patterns, and a randomness test battery over long tokens.

Base spans come from three patterns. Beyond them, every maximal run of ``SHORTEST`` or more characters of
[A-Za-z0-9+/_-], with its padding, that mixes digits and letters or cases, or is of capitals, is read in the
encoding inferred from its characters (hex, base32, base64) and tested twice:

* If it is encoded random data, its symbols are uniform and independent; three tests give p-values for that:
  chi-squared of the alphabet in equal cells, Wald-Wolfowitz runs about the alphabet's middle, and lag-one serial
  correlation, joined by Fisher's method. Within each stratum of length, the Benjamini-Hochberg rule over all
  documents' tokens decides which are rejected as not random.
* If it is ordinary text, words run together or joined by a sign, its characters follow each other as in the corpus:
  the sum of their surprise under the character pairs of all texts gives a p-value, which allows for its length. The Benjamini-Hochberg rule over
  the tokens of a stratum that the battery did not reject holds the expected share of ordinary tokens among the reported
  ones below ``LEVEL``.

Tokens that pass the first and fail the second are added as spans of kind ``random``, where no base span overlaps them.
Tokens of fewer than ``SHORTEST`` characters are not tested: that few symbols cannot tell random data from a word.

Scale: three scans without a shuffle of text: character pairs (a fixed table for each task), counts of p-values in
fixed cells by stratum (at most 4 x 401 x 401 rows reach the driver whatever the input), and the spans.

Defined cases: a null text is empty; an empty text has no spans; very long texts are read whole; a span is (kind,
start, end) in code points; repeated rows give repeated results; without any candidate nothing is added.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._common import each_text, slot

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # leftmost and greedy: the maximal runs that are long enough
KINDS = ("assign", "access", "hex", "random")
SHORTEST = 20
TOKEN = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}=*")  # "=" only as padding: a value after an inner one stands by itself
#: Every byte that cannot be part of a token becomes a space.
TOKENS = bytes(c if chr(c) in "+/_=-" or (c < 128 and chr(c).isalnum()) else 32 for c in range(256))
HINTS = ("passw", "secret", "token", "api")

HEX_LOWER, HEX_UPPER, BASE32 = "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
ALPHABETS = [{c: i for i, c in enumerate(a)} for a in (HEX_LOWER, HEX_UPPER, BASE32, BASE64)]
ALPHABETS[3] |= {"-": 62, "_": 63}

STRATA = (32, 48, 80)  # lengths at which the next stratum begins
CELLS, FINEST = 400, 40.0  # cells of -log10(p)
LEVEL = 0.05  # of tokens wrongly rejected as not random, and of ordinary tokens among the reported ones

#: Characters of tokens, by kind of byte: 0 for all others.
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/-_"
_PLACES = np.zeros(256, np.uint8)
_PLACES[[ord(c) for c in SYMBOLS]] = np.arange(1, len(SYMBOLS) + 1)
_SIZE = len(SYMBOLS) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end), in order."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found


def _tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared, by the cube-root normal approximation."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str) -> float | None:
    """The joint p-value that the token is uniform random data in its inferred encoding; None if it cannot be."""
    body = token.rstrip("=")
    symbols = set(body)
    size, index = next(((len(set(a.values())), a) for a in ALPHABETS if symbols <= a.keys()), (0, None))
    n = len(body)
    if index is None or n < SHORTEST or not any(c.isalpha() for c in symbols):
        return None
    if not any(c.isdigit() for c in symbols) and not (symbols <= ALPHABETS[2].keys() or any(map(str.islower, body)) and any(map(str.isupper, body))):
        return None  # letters of one case are no base64; capitals may be base32
    x = [index[c] for c in body]
    cells = 2
    while cells * 2 <= size and n >= cells * 2 * 4:
        cells *= 2
    counts = Counter(v * cells // size for v in x)
    chi = sum((counts[c] - n / cells) ** 2 for c in range(cells)) / (n / cells)
    p = [_chi_tail(chi, cells - 1)]
    high = [v * 2 >= size for v in x]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(u != v for u, v in zip(high, high[1:]))
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p.append(_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    mu = sum(x) / n
    spread = sum((v - mu) ** 2 for v in x)
    if spread:
        r = sum((u - mu) * (v - mu) for u, v in zip(x, x[1:])) / spread
        p.append(_tail((r + 1 / n) * math.sqrt(n)))
    else:
        p.append(2.0 ** (1 - n))
    fisher = -2 * sum(math.log(max(v, 1e-300)) for v in p)
    half = fisher / 2  # an even chi-squared has a closed tail
    return min(1.0, math.exp(-half) * sum(half**k / math.factorial(k) for k in range(len(p)))) if half < 700 else 0.0


def stratum(length: int) -> int:
    return sum(length >= s for s in STRATA)


def cell(p: float) -> int:
    return min(CELLS, int(-math.log10(max(p, 1e-300)) * CELLS / FINEST))


def symbol_pairs(raw: bytes) -> np.ndarray:
    """How often each symbol is the next after each: within words, and from a word to the next. Runs that are long
    enough to be tested themselves are left out. Two tables in one: all pairs, and those from word to word."""
    x = _PLACES[np.frombuffer(raw, np.uint8)].astype(np.int32)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], x > 0, [0]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    long = last - first >= SHORTEST
    for a, b in zip(first[long].tolist(), last[long].tolist()):
        x[a:b] = 0
    at = np.flatnonzero(x)
    pair = x[at[:-1]] * _SIZE + x[at[1:]]
    return np.concatenate([np.bincount(p, minlength=_SIZE * _SIZE) for p in (pair, pair[np.diff(at) > 1])])


class Ordinary:
    """How surprising a token is as words run together, or joined by a sign, from pairs of symbols in all texts."""

    def __init__(self, pairs: np.ndarray) -> None:
        every, between = pairs.reshape(2, _SIZE, _SIZE)[:, 1:, 1:]
        n = every + 0.05  # also where a corpus is small, every pair is possible
        for sign in "-_/":
            k = SYMBOLS.index(sign)
            n[:, k] += between.sum(1) / 4
            n[k] += between.sum(0) / 4
        self.surprise = -np.log(n / n.sum(1, keepdims=True))
        share = n / n.sum()
        self.mean = float((share * self.surprise).sum())
        self.spread = float((share * (self.surprise - self.mean) ** 2).sum()) ** 0.5

    def p(self, token: str) -> float:
        """The p-value of the token's mean surprise; that of a sum of as many pairs is about normal."""
        x = _PLACES[np.frombuffer(token.rstrip("=").encode(), np.uint8)].astype(np.int64) - 1
        n = len(x) - 1
        z = (float(self.surprise[x[:-1], x[1:]].sum()) - n * self.mean) / (self.spread * math.sqrt(n))
        return 0.5 * math.erfc(z / math.sqrt(2))


def scan(raw: bytes, ordinary: Ordinary) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, int]]]:
    """Base spans as (start, kind's place, end), and candidates as (start, end, stratum, cells of both p-values)."""
    text = raw.decode()
    base = base_spans(text)
    tokens = []
    if max(map(len, raw.translate(TOKENS).split()), default=0) >= SHORTEST:
        base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        for m in TOKEN.finditer(text):
            if (p := randomness(m.group())) is not None:
                tokens.append((m.start(), m.end(), stratum(m.end() - m.start()), cell(p), cell(ordinary.p(m.group()))))
    base.sort()
    free = [t for t in tokens if not any(a < t[1] and t[0] < b for a, _, b in base)]
    return base, free


def _raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [x or b"" for x in batch[column].cast(pa.binary()).to_pylist()]


def rejected(cells: dict[int, int], level: float) -> int:
    """By the Benjamini-Hochberg rule, the least cell whose p-values are rejected. cells: how many p-values each has;
    a cell's p-values count as its greatest."""
    total, below, out = sum(cells.values()), 0, CELLS + 1
    for c in sorted(cells, reverse=True):  # smallest p first
        below += cells[c]
        if 10 ** (-c * FINEST / CELLS) <= level * below / total:
            out = c
    return out


class Rule:
    """ordinary: the text model; random, odd: by stratum, the least cells rejected as random and as ordinary."""

    def __init__(self, ordinary: Ordinary, counts: dict[tuple[int, int, int], int], level: float) -> None:
        self.ordinary, self.random, self.odd = ordinary, {}, {}
        for s in {k[0] for k in counts}:
            of = {k[1:]: n for k, n in counts.items() if k[0] == s}
            cells: Counter = Counter()
            for (c, _), n in of.items():
                cells[c] += n
            self.random[s] = rejected(cells, level)
            cells = Counter()
            for (c, odd), n in of.items():
                if c < self.random[s]:
                    cells[odd] += n
            self.odd[s] = rejected(cells, level)

    def spans(self, raw: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans, each in order of start, then kind."""
        base, tokens = scan(raw, self.ordinary)
        added = [(a, 3, b) for a, b, s, c, odd in tokens if c < self.random.get(s, 0) and odd >= self.odd[s]]
        return base, sorted(base + added)


def fit(docs: DataFrame, text_col: str = "text", level: float = LEVEL) -> Rule:
    """The rule that all documents' tokens give."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2 * _SIZE * _SIZE, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # texts apart: a line break belongs to no token
                seen += symbol_pairs(b"\n".join(_raw(batch.slice(at, 512), "text")))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["pair", "cnt"])

    texts = docs.select(F.col(text_col).alias("text"))
    table = np.zeros(2 * _SIZE * _SIZE, np.int64)
    for r in texts.mapInArrow(pairs, "pair int, cnt long").groupBy("pair").agg(F.sum("cnt").alias("cnt")).collect():
        table[r["pair"]] = r["cnt"]
    ordinary = Ordinary(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for raw in _raw(batch, "text"):
                seen.update(t[2:] for t in scan(raw, ordinary)[1])
        columns = [pa.array([k[i] for k in seen], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(seen.values()), pa.int64())], names=["stratum", "cell", "odd", "cnt"])

    rows = texts.mapInArrow(count, "stratum int, cell int, odd int, cnt long").groupBy("stratum", "cell", "odd").agg(F.sum("cnt").alias("cnt")).collect()
    return Rule(ordinary, {(r["stratum"], r["cell"], r["odd"]): r["cnt"] for r in rows}, level)


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = LEVEL) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    rule = fit(docs, text_col, level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for raw in _raw(batch, "text"):
                base, every = rule.spans(raw)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in every))
                digests.append(hashlib.sha256(_join(base).encode()).hexdigest())
                spans.append(_join(every))
            n = [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *n[:3], pa.array(digests, pa.string()), pa.array(spans, pa.string()), n[3]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
            )

    source = slot(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", level: float = LEVEL) -> DataFrame:
    """The documents, all columns, with each secret's characters replaced by [kind]; the length follows the text."""
    rule = fit(docs, text_col, level)

    def clean(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        text, out, to = raw.decode(), [], 0
        for a, k, b in rule.spans(raw)[1]:
            if a >= to:
                out += [text[to:a], f"[{KINDS[k]}]"]
            to = max(to, b)
        return "".join(out) + text[to:] if out else text

    new = each_text(clean, pa.string())(F.col(text_col))
    found = docs.select("*", new.alias("_gm_new"))
    if length_col in docs.columns:
        length = F.when(F.col("_gm_new").eqNullSafe(F.col(text_col)), F.col(length_col)).otherwise(F.length("_gm_new").cast(docs.schema[length_col].dataType))
        found = found.withColumn(length_col, length)
    return found.withColumn(text_col, F.col("_gm_new")).drop("_gm_new")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    from glyphmill.llm._common import read

    return find_secrets(read(spark, sf_dir, "documents"))
