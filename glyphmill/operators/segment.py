"""Segmentation of text into vocabulary tokens: bytes, greedy, and cost-optimal.

``bytes`` and ``greedy`` are built-in expressions. ``optimal`` is dynamic programming over an automaton of
all tokens, in Arrow batches: the automaton is built on the driver (its size is the vocabulary's, not the
corpus's) and shipped with the function. It runs as a table of states over many places at once (``transducer``),
or text by text where the states are too many.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.filters import byte_string, compose
from glyphmill.operators.transducer import SLICE, Transducer, cuts, slices
from glyphmill.operators.vocabulary import BITS_BASE, HEX_BASE, Vocabulary


class Automaton:
    """States are the prefixes of tokens and all single bytes; each knows the tokens that end in it.

    ``step[state][byte]`` is the next state; ``ends[state]`` lists (length, cost, id), longest first. Ids from
    the vocabulary's size on are literals, one for each byte.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.strings = [t.string for t in vocabulary]
        self.size = len(self.strings)
        self.literal_cost = vocabulary.literal_cost
        self.fallback = [[vocabulary.id_of(s) for s in vocabulary.fallback_of(b)] for b in range(256)]
        self.longest = max(map(len, self.strings))
        children: list[dict[int, int]] = [{}]
        own: list[tuple[int, int, int] | None] = [None]
        marked = [(s, 1, i) for i, s in enumerate(self.strings)]
        marked += [(bytes([b]), self.literal_cost, self.size + b) for b in range(256) if bytes([b]) not in vocabulary]
        for string, cost, i in marked:
            at = 0
            for b in string:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    own.append(None)
                at = children[at][b]
            own[at] = (len(string), cost, i)
        self.step: list[list[int]] = [[0] * 256 for _ in children]
        self.ends: list[list[tuple[int, int, int]]] = [[] for _ in children]
        back = [0] * len(children)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            # the state of the longest proper suffix is complete, as it is shorter
            self.ends[at] = ([own[at]] if own[at] else []) + (self.ends[back[at]] if at else [])
            for b in range(256):
                shorter = self.step[back[at]][b] if at else 0
                if (down := children[at].get(b)) is None:
                    self.step[at][b] = shorter
                else:
                    self.step[at][b] = down
                    back[down] = shorter
                    queue.append(down)

    def ids(self, data: bytes) -> list[int]:
        """Least cost: 1 for a token, the literal cost for a literal. Of equal costs, the longest last token."""
        step, ends = self.step, self.ends
        cost, last, state = [0], [0], 0
        lengths = [0]
        for n, b in enumerate(data, 1):
            state = step[state][b]
            found = ends[state]
            best_length, price, best = found[0]
            least = cost[n - best_length] + price
            for length, price, i in found[1:]:
                if (c := cost[n - length] + price) < least:
                    least, best, best_length = c, i, length
            cost.append(least)
            last.append(best)
            lengths.append(best_length)
        out, n = [], len(data)
        while n:
            out.append(last[n])
            n -= lengths[n]
        out.reverse()
        return out

    def cost(self, data: bytes) -> int:
        return sum(1 if i < self.size else self.literal_cost for i in self.ids(data))

    def expand(self, ids: Iterable[int]) -> list[int]:
        """With literals written by the fallback's tokens."""
        out: list[int] = []
        for i in ids:
            if i < self.size:
                out.append(i)
            else:
                out += self.fallback[i - self.size]
        return out

    def string(self, i: int) -> bytes:
        return self.strings[i] if i < self.size else bytes([i - self.size])


class Segmenter:
    """Optimal segmentation of many texts, equal to that of ``Automaton``."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.size = len(vocabulary)
        self.strings = [t.string for t in vocabulary] + [bytes([b]) for b in range(256)]
        written = [[vocabulary.id_of(s) for s in vocabulary.fallback_of(b)] for b in range(256)]
        self.written = [*([i] for i in range(self.size)), *written]
        table = Transducer(vocabulary)
        self.table, self.plain = (table, None) if table.step is not None else (None, Automaton(vocabulary))

    def ids(self, raws: list[bytes]) -> np.ndarray:
        """The token ids of all texts, one after the other, with -1 before each text."""
        if self.table:
            return self.table.ids(raws)
        return np.array([i for x in raws for i in (-1, *self.plain.ids(x))], np.int32)

    def counts(self, raws: list[bytes]) -> np.ndarray:
        """The number of each id in all texts."""
        if self.table:
            return self.table.counts(raws)
        ids = self.ids(raws)
        return np.bincount(ids[ids >= 0], minlength=len(self.strings))

    def pairs(self, raws: list[bytes]) -> np.ndarray:
        """The number of each id before each other one: ``[left, right]``, with the end of a text as one more on the right."""
        if self.table:
            return self.table.pairs(raws)
        ids, n = np.append(self.ids(raws), -1), len(self.strings) + 1
        left = np.flatnonzero(ids >= 0)
        return np.bincount(ids[left].astype(np.int64) * n + ids[left + 1] % n, minlength=n * (n - 1)).reshape(n - 1, n)

    def costs(self, raws: list[bytes]) -> np.ndarray:
        return self.table.costs(raws) if self.table else np.array([self.plain.cost(x) for x in raws], np.int64)

    def tokens(self, raws: list[bytes | None], expand_literals: bool = True) -> pa.ListArray:
        """The tokens of each text; literals as one byte each if not expanded."""
        ids = self.ids([x or b"" for x in raws])
        starts = np.flatnonzero(ids < 0)
        ids = ids[ids >= 0]
        ends = np.append(starts[1:] - np.arange(1, len(starts)), len(ids))
        if expand_literals:
            counts = np.array([len(w) for w in self.written])
            begins, n = (np.cumsum(counts) - counts)[ids], counts[ids]
            after = np.cumsum(n)
            ids = np.concatenate(self.written)[np.repeat(begins - after + n, n) + np.arange(n.sum())]
            ends = np.append(0, after)[ends]
        offsets = pa.array(np.append(0, ends).astype(np.int32), mask=np.array([*(x is None for x in raws), False]))
        return pa.ListArray.from_arrays(offsets, pa.array(self.strings, pa.binary()).take(pa.array(ids)))


#: Text whose tokens are held at once where they are written out.
WRITTEN = SLICE >> 4


def optimal(text: Column, vocabulary: Vocabulary, expand_literals: bool = True) -> Column:
    """array<binary>: the tokens of the cheapest segmentation; literals as one byte each if not expanded."""
    machine = Segmenter(vocabulary)

    @F.arrow_udf("array<binary>")
    def run(column: pa.Array) -> pa.Array:
        parts = [machine.tokens(raws, expand_literals) for _, raws in slices(column, WRITTEN)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.binary()))

    return run(text)


def decoded(tokens: Iterable[bytes]) -> bytes:
    """The bytes that tokens write: a mark and two hex digits, or eight bits, are one byte. So texts must hold no reserved
    character, as the filter of that name sees to."""
    out, rest = bytearray(), iter(tokens)
    for t in rest:
        if t == HEX_BASE[0]:
            out += bytes.fromhex((next(rest) + next(rest)).decode())
        elif t in BITS_BASE:
            bits = [t, *(next(rest) for _ in range(7))]
            out.append(int("".join(str(BITS_BASE.index(b)) for b in bits), 2))
        else:
            out += t
    return bytes(out)


def decode(tokens: Column) -> Column:
    """The text of an array of tokens (binary)."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        parts = [_decoded(column.slice(at, to - at)) for at, to in cuts(sizes, WRITTEN)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run(tokens)


def _decoded(tokens: pa.ListArray) -> pa.Array:
    return pa.array([None if x is None else decoded(x).decode(errors="replace") for x in tokens.to_pylist()], pa.string())


def _kept(docs: DataFrame, keys: Iterable[str]) -> str:
    return ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, keys: Iterable[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keys, text: each text segmented and put together again from its tokens, which are never held for more than a slice."""
    machine, names = Segmenter(vocabulary), list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raws in slices(batch["text"], WRITTEN):
                kept = [batch[k].slice(at, len(raws)) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, _decoded(machine.tokens(raws))], names=[*names, "text"])

    return docs.select(*names, F.col(text_col).alias("text")).mapInArrow(run, f"{_kept(docs, names)}, text string")


def optimal_cost(text: Column, vocabulary: Vocabulary) -> Column:
    """The number of tokens of the cheapest segmentation, fallback tokens counted each."""
    machine = Segmenter(vocabulary)

    @F.arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        parts = [pa.array(machine.costs([x or b"" for x in raws]), mask=np.array([x is None for x in raws])) for _, raws in slices(column)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.int64())

    return run(text)


def _quoted(string: bytes) -> str:
    return "".join(f"\\x{{{c:x}}}" for c in string)


def _fallback(char: Column, vocabulary: Vocabulary) -> Column:
    """The fallback's tokens for one byte, as byte strings."""
    if vocabulary.fallback == "hex":
        digits = F.lower(F.hex(F.encode(char, "ISO-8859-1")))
        return F.array(F.lit("\x10"), F.substring(digits, 1, 1), F.substring(digits, 2, 1))
    bits = F.lpad(F.bin(F.conv(F.hex(F.encode(char, "ISO-8859-1")), 16, 10).cast("int")), 8, "0")
    return F.split(F.translate(bits, "01", "\x11\x12"), "")


def _with_fallback(parts: Column, vocabulary: Vocabulary) -> Column:
    known = F.array(*[F.lit(t.string.decode("latin-1")) for t in vocabulary])
    return F.flatten(F.transform(parts, lambda p: F.when(F.array_contains(known, p), F.array(p)).otherwise(_fallback(p, vocabulary))))


def by_bytes(text: Column, vocabulary: Vocabulary) -> Column:
    """array<string> of byte strings: each byte's own token, or its fallback's."""
    return _with_fallback(F.regexp_extract_all(byte_string(text), F.lit("(?s)(.)"), F.lit(1)), vocabulary)


def greedy(text: Column, vocabulary: Vocabulary) -> Column:
    """array<string> of byte strings: the longest token at each place, else the byte's fallback."""
    longest_first = sorted((t.string for t in vocabulary), key=lambda s: (-len(s), s))
    pattern = "(?s)(" + "|".join(map(_quoted, longest_first)) + "|.)"
    return _with_fallback(F.regexp_extract_all(byte_string(text), F.lit(pattern), F.lit(1)), vocabulary)


def _greedy_find(vocabulary: Vocabulary) -> Callable[[bytes], list[bytes]]:
    """The longest token at each place; a byte where there is none."""
    by: dict[bytes, list[bytes]] = {}
    for t in vocabulary:
        by.setdefault(t.string[:1], []).append(t.string[1:])
    # one branch for each first byte, so a place that starts no long token is settled at once
    ways = [re.escape(first) + b"(?:" + b"|".join(map(re.escape, sorted(rest, key=lambda s: (-len(s), s)))) + b")" for first, rest in by.items()]
    # where a first byte is no token by itself, the fallback's single byte follows
    return re.compile(b"|".join([*ways, b"."]), re.S).findall


def _spelled(vocabulary: Vocabulary) -> dict[bytes, str]:
    """The tokens, and the fallback's for other bytes, in hex."""
    out = {t.string: t.string.hex().upper() for t in vocabulary}
    for b in range(256):
        out.setdefault(bytes([b]), " ".join(s.hex().upper() for s in vocabulary.fallback_of(b)))
    return out


def _bytes_written(vocabulary: Vocabulary) -> Callable[[list[bytes]], tuple[pa.Array, pa.Array]]:
    """The numbers of tokens and the tokens of texts, byte by byte: cut from what is written for all bytes of all texts."""
    spelled = _spelled(vocabulary)
    of_byte = [spelled[bytes([b])] for b in range(256)]
    joined = pa.array([*(f" {x}" for x in of_byte), *of_byte])  # after another byte, and at the beginning of a text
    n_of_byte = np.array([x.count(" ") + 1 for x in of_byte])

    def run(raws: list[bytes]) -> tuple[pa.Array, pa.Array]:
        data, sizes = np.frombuffer(b"".join(raws), np.uint8), np.array([len(x) for x in raws], np.int64)
        which, bounds = data.astype(np.int32), np.append(0, np.cumsum(sizes))
        which[bounds[:-1][sizes > 0]] += 256
        _, offsets, values = joined.take(pa.array(which)).buffers()
        offsets = np.frombuffer(offsets, np.int32, len(data) + 1)[bounds]
        counts = np.diff(np.append(0, np.cumsum(n_of_byte[data]))[bounds])
        return pa.array(counts), pa.StringArray.from_buffers(len(raws), pa.py_buffer(offsets), values)

    return run


def _greedy_written(vocabulary: Vocabulary) -> Callable[[list[bytes]], tuple[pa.Array, pa.Array]]:
    """The numbers of tokens and the tokens of texts, the longest at each place."""
    find, of_token = _greedy_find(vocabulary), _spelled(vocabulary).__getitem__

    def run(raws: list[bytes]) -> tuple[pa.Array, pa.Array]:
        tokens = [" ".join(map(of_token, find(x))) for x in raws]
        return pa.array([x.count(" ") + 1 if x else 0 for x in tokens], pa.int64()), pa.array(tokens, pa.string())

    return run


def written(docs: DataFrame, vocabulary: Vocabulary, longest: bool, keys: Iterable[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keys, n_tokens, tokens (in hex, parted by spaces): of the greedy segmentation, or of that into bytes. A null text
    is an empty one. Tokens are many times as long as their text, so they are written a slice at a time."""
    names = list(keys)
    write = _greedy_written(vocabulary) if longest else _bytes_written(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raws in slices(batch["text"], WRITTEN):
                kept = [batch[k].slice(at, len(raws)) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, *write([x or b"" for x in raws])], names=[*names, "n_tokens", "tokens"])

    return docs.select(*names, F.col(text_col).alias("text")).mapInArrow(run, f"{_kept(docs, names)}, n_tokens long, tokens string")


def greedy_counts(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """token (in hex), cnt of the greedy segmentation; each task counts its own rows before the shuffle."""
    find = _greedy_find(vocabulary)
    known = {t.string for t in vocabulary}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for raw in batch["text"].cast(pa.binary()).to_pylist():
                seen.update(find(raw or b""))
        for byte in [s for s in seen if s not in known]:
            n = seen.pop(byte)
            for s in vocabulary.fallback_of(byte[0]):
                seen[s] += n
        tokens = [s.hex().upper() for s in seen]
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "cnt"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token string, cnt long").groupBy("token").agg(F.sum("cnt").alias("cnt"))


COUNTS = "kind string, left string, right string, cnt long"


def optimal_counts(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", filters: Iterable[str] = (), pairs: bool = False) -> DataFrame:
    """kind, left, right, cnt over all rows; strings in hex. Kinds: token (a token used), literal (a byte without
    a token), pair (a token and the next, literals among them), bytes (before filters), filtered (after them).

    Each task sums its own rows before the shuffle; pairs never cross rows.
    """
    machine = Segmenter(vocabulary)
    names = [x.hex() for x in machine.strings]
    kinds = len(names)
    # a condition on the filtered text would run the filters twice
    filtered = docs.where(F.col(text_col).isNotNull()).select(F.octet_length(text_col).cast("long").alias("n"), compose(filters)(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(kinds, np.int64)
        after: Counter = Counter()
        dense = np.zeros((kinds, kinds), np.int64) if pairs and kinds <= 1024 else None
        before = scanned = 0
        for batch in batches:
            before += pc.sum(batch["n"]).as_py() or 0
            for _, raws in slices(batch["text"]):
                scanned += sum(map(len, raws))
                if dense is not None:
                    found = machine.pairs(raws)
                    dense += found[:, :-1]
                    seen += found.sum(axis=1)
                elif not pairs:
                    seen += machine.counts(raws)
                else:
                    ids = machine.ids(raws)
                    seen += np.bincount(ids[ids >= 0], minlength=kinds)
                    within = (ids[:-1] >= 0) & (ids[1:] >= 0)
                    both, n = np.unique(ids[:-1][within].astype(np.int64) * kinds + ids[1:][within], return_counts=True)
                    after.update(dict(zip(both.tolist(), n.tolist(), strict=True)))
        rows = [("token" if i < machine.size else "literal", names[i], None, int(seen[i])) for i in np.flatnonzero(seen).tolist()]
        if dense is not None:
            after.update({k: int(dense.flat[k]) for k in np.flatnonzero(dense).tolist()})
        rows += [("pair", names[k // kinds], names[k % kinds], n) for k, n in after.items()]
        rows += [("bytes", None, None, before), ("filtered", None, None, scanned)]
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], names=["kind", "left", "right", "cnt"])

    return filtered.mapInArrow(run, COUNTS).groupBy("kind", "left", "right").agg(F.sum("cnt").alias("cnt"))


def optimal_costs(docs: DataFrame, vocabularies: list[Vocabulary], text_col: str = "text", filters: Iterable[str] = ()) -> list[int]:
    """The cost of all rows under each of the vocabularies, in one pass."""
    machines = [Segmenter(v) for v in vocabularies]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * len(machines)
        for batch in batches:
            for _, raws in slices(batch["text"].drop_null()):
                for k, m in enumerate(machines):
                    total[k] += int(m.costs(raws).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.int64())], names=["k", "cost"])

    found = docs.select(compose(filters)(F.col(text_col)).alias("text")).mapInArrow(run, "k int, cost long").groupBy("k").agg(F.sum("cost").alias("cost"))
    by = {r["k"]: r["cost"] for r in found.collect()}
    return [by.get(k, 0) for k in range(len(vocabularies))]


def _around(strings: list[bytes], vocabulary: Vocabulary) -> Callable[[list[bytes]], list[list[bytes]]]:
    """For each string, the parts of texts whose tokens may change as it is taken out of the vocabulary: the runs of bytes of
    long tokens and of the strings in which it occurs. Between the runs each byte is a token or a literal by itself whatever
    comes before and after; one such byte stands before each run, and the runs of a string are put together."""
    inner = np.zeros(256, bool)
    for s in [*strings, *(t.string for t in vocabulary if len(t.string) > 1)]:
        inner[list(s)] = True
    mark = next((bytes([b]) for b in range(255, -1, -1) if not inner[b]), None)
    finds = [re.compile(re.escape(s)).finditer for s in strings]

    def run(raws: list[bytes]) -> list[list[bytes]]:
        if mark is None:
            return [[x for x in raws if s in x] for s in strings]
        joined = mark + mark.join(raws) + mark
        data = np.frombuffer(joined, np.uint8)
        bounds, out = np.flatnonzero(~inner[data]), []
        for find in finds:
            after = np.unique(np.searchsorted(bounds, np.array([m.start() for m in find(joined)], np.int64)))
            begins, sizes = bounds[after - 1], bounds[after] - bounds[after - 1]
            parts = data[np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            out.append([parts.tobytes()] if len(parts) else [])
        return out

    return run


def optimal_changes(docs: DataFrame, vocabulary: Vocabulary, strings: list[bytes], text_col: str = "text", filters: Iterable[str] = ()) -> list[dict[bytes, int]]:
    """By how much the counts of tokens change, literals written by the fallback, as each of the strings is taken out of the
    vocabulary after those before it. One pass for all of them, in which only the parts of texts around a string are segmented."""
    left, machines, places = vocabulary, [], []
    place = {t.string: i for i, t in enumerate(vocabulary)}
    for s in [None, *strings]:
        left = left if s is None else left.without(s)
        machines.append(Segmenter(left))
        places.append(np.array([*(place[t.string] for t in left), *range(len(vocabulary), len(vocabulary) + 256)]))
    around, kinds = _around(strings, vocabulary), len(vocabulary) + 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(strings), kinds), np.int64)
        for batch in batches:
            for _, raws in slices(batch["text"].drop_null()):
                for k, parts in enumerate(around(raws)):
                    total[k, places[k]] -= machines[k].counts(parts)
                    total[k, places[k + 1]] += machines[k + 1].counts(parts)
        k, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(total[k, i])], names=["k", "i", "cnt"])

    changed = docs.select(compose(filters)(F.col(text_col)).alias("text")).mapInArrow(run, "k int, i int, cnt long").groupBy("k", "i").agg(F.sum("cnt").alias("cnt"))
    out: list[dict[bytes, int]] = [{} for _ in strings]
    written = [[t.string] for t in vocabulary] + [vocabulary.fallback_of(b) for b in range(256)]
    for r in changed.collect():
        for s in written[r["i"]]:
            out[r["k"]][s] = out[r["k"]].get(s, 0) + r["cnt"]
    return out


def optimal_report(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", filters: Iterable[str] = ()) -> DataFrame:
    """token (in hex), cnt of the optimal segmentation, with literals written by the fallback's tokens."""
    literal = F.create_map(*[x for b in range(256) for x in (F.lit(f"{b:02x}"), F.array(*[F.lit(s.hex()) for s in vocabulary.fallback_of(b)]))])
    counts = optimal_counts(docs, vocabulary, text_col, filters).where("kind in ('token', 'literal')")
    written = F.when(F.col("kind") == "token", F.array("left")).otherwise(literal[F.col("left")])
    return counts.select(F.explode(written).alias("token"), "cnt").groupBy(F.upper("token").alias("token")).agg(F.sum("cnt").alias("cnt"))


def suffix_tokens(vocabulary: DataFrame) -> DataFrame:
    """vocabulary (token_id, token, length) -> token and its longest proper suffix among the tokens, in hex."""
    long, short = vocabulary.alias("l"), vocabulary.alias("s")
    ends = F.expr("l.length > s.length and right(hex(l.token), 2 * s.length) = hex(s.token)")
    best = F.max_by(F.hex("s.token"), F.col("s.length"))
    return long.join(F.broadcast(short), ends).groupBy(F.hex("l.token").alias("token")).agg(best.alias("suffix"))


