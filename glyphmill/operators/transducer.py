"""Optimal segmentation as a finite machine, run over many places of the texts at once.

What the dynamic program of ``segment.Automaton`` does at a byte depends on the token prefixes that end there and on
the costs of their beginnings relative to the cost so far. Both take finitely many values, so the program is a table
of states. Texts are put into one buffer, cut into columns of equal height, and all columns step down together. A
column first begins in a state of its own; it is then run again from the end of the column before until both runs
agree, so the result is that of a single run from the first byte to the last.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from glyphmill.operators.vocabulary import Vocabulary

MOST_STATES = 4000  # a state takes 2 KB; beyond that, the plain program serves
HEIGHT = 1024
SLICE = 4 << 20  # bytes of text in one buffer, but for longer texts
ROWS = 32  # of all columns, counted at once


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``most`` at most, a row at least."""
    ends, at, before = np.cumsum(sizes), 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, to
        at, before = to, int(ends[to - 1])


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, list[bytes | None]]]:
    """Parts of a text column, as the place of their first row and their rows: ``size`` bytes, a row at least."""
    raw = column.cast(pa.binary())
    lengths = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    for at, to in cuts(lengths, size):
        yield at, raw.slice(at, to - at).to_pylist()


class Transducer:
    """``step[256 * state + byte]`` is 256 times the next state, ``emits`` the last token of the best way to it (its id and
    1), ``adds`` what the byte adds to the cost."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.size = len(vocabulary)
        self.kinds = self.size + 256
        price = [1 if bytes([b]) in vocabulary else vocabulary.literal_cost for b in range(256)]
        self.single = np.array([vocabulary.id_of(bytes([b])) if bytes([b]) in vocabulary else self.size + b for b in range(256)], np.int32)
        long = [(t.string, i) for i, t in enumerate(vocabulary) if len(t.string) > 1]
        used = sorted({b for s, _ in long for b in s})
        self.longest = max([1, *(len(s) for s, _ in long)])
        #: A byte of no long token begins anew after any text, so it parts the texts of a buffer.
        self.mark = next((b for b in range(255, -1, -1) if b not in used), None)
        self.step = None
        if self.mark is not None:
            self._build(long, used, price)

    def _build(self, long: list[tuple[bytes, int]], used: list[int], price: list[int]) -> None:
        children: list[dict[int, int]] = [{}]
        depth, own = [0], [None]
        for string, i in long:
            at = 0
            for b in string:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    depth.append(depth[at] + 1)
                    own.append(None)
                at = children[at][b]
            own[at] = (len(string), i)
        back, go = [0] * len(children), [{} for _ in children]
        ends: list[list[tuple[int, int]]] = [[] for _ in children]
        # the lengths of the ends of a state's text that a token may begin with, longest first
        open_: list[tuple[int, ...]] = [() for _ in children]
        live = [0] * len(children)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            if at:
                ends[at] = ([own[at]] if own[at] else []) + ends[back[at]]
                open_[at] = ((depth[at],) if children[at] else ()) + open_[back[at]]
                live[at] = at if children[at] else live[back[at]]
            for b in used:
                shorter = go[back[at]][b] if at else 0
                if (down := children[at].get(b)) is None:
                    go[at][b] = shorter
                else:
                    go[at][b] = down
                    back[down] = shorter
                    queue.append(down)
        others = sorted({price[b] for b in range(256) if b not in go[0]})
        names: dict[tuple, int] = {(0, (), 1, -1, 0): 0}
        todo, rows = deque(names), []
        while todo:
            node, costs, *_ = todo.popleft()
            known = dict(zip(open_[node], costs, strict=True)) | {0: 0}
            row = {}
            for b in used:
                to = go[node][b]
                least, length, token = None, 1, -1
                for n, i in ends[to]:  # of equal costs, the longest
                    if least is None or known[n - 1] + 1 < least:
                        least, length, token = known[n - 1] + 1, n, i
                if least is None or price[b] < least:
                    least, length, token = price[b], 1, -1
                to = live[to]
                row[b] = (to, tuple(known[n - 1] - least for n in open_[to]), length, token, least)
            row |= {-p: (0, (), 1, -1, p) for p in others}
            for key in row.values():
                if key not in names:
                    names[key] = len(names)
                    todo.append(key)
            if len(names) > MOST_STATES:
                return
            rows.append([names[key] for key in row.values()])
        column = {key: k for k, key in enumerate([*used, *(-p for p in others)])}
        of = [column[b] if b in column else column[-price[b]] for b in range(256)]
        self.step = (np.array(rows, np.intp)[:, of] << 8).ravel()
        after = self.step >> 8
        token = np.array([k[3] for k in names])[after]
        self.adds = np.array([k[4] for k in names], np.int32)[after]
        self.emits = (np.where(token < 0, np.tile(self.single, len(names)), token) + 1).astype(np.uint16)
        self.lengths = np.ones(self.kinds + 1, np.min_scalar_type(self.longest))
        self.lengths[[i + 1 for _, i in long]] = [len(s) for s, _ in long]

    def _states(self, down: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """down: bytes, a column in each ``down[:, w]``; what the table has of each step, and the states after the last ones."""
        height, width = down.shape
        step, out, states = self.step, np.empty(down.shape, table.dtype), np.empty(down.shape, np.uint16)
        at, place = np.zeros(width, np.intp), np.empty(width, np.intp)
        for k in range(height):
            np.add(at, down[k], out=place)
            np.take(step, place, out=at, mode="clip")
            np.take(table, place, out=out[k], mode="clip")
            np.right_shift(at, 8, out=states[k], casting="unsafe")
        began = np.zeros(width, np.uint16)
        began[1:] = states[-1, :-1]
        columns = np.flatnonzero(began)
        at = began[columns].astype(np.intp) << 8
        for k in range(height):
            if not len(columns):
                break
            place = at + down[k, columns]
            at = step[place]
            new = (at >> 8).astype(np.uint16)
            changed = new != states[k, columns]
            states[k, columns], out[k, columns] = new, table[place]
            columns, at = columns[changed], at[changed]
        if len(columns):  # columns that hang on their beginning to their end: one after the other
            last = states[-1].tolist()
            for w in range(1, width):
                if last[w - 1] != began[w]:
                    s = last[w - 1]
                    for k, b in enumerate(down[:, w].tolist()):
                        out[k, w] = table[s << 8 | b]
                        s = int(step[s << 8 | b]) >> 8
                        if s == states[k, w]:
                            break
                        states[k, w] = s
                    else:
                        last[w] = s
        return out

    def _ends(self, lengths: np.ndarray) -> np.ndarray:
        """Where the tokens of the best way end, found from the last byte to the first."""
        height, width = lengths.shape
        path = np.empty(lengths.shape, bool)
        rest, taken = np.zeros(width, lengths.dtype), np.empty(width, lengths.dtype)  # rest: bytes that the token to the right still takes
        for k in range(height - 1, -1, -1):
            np.equal(rest, 0, out=path[k])
            np.multiply(lengths[k], path[k], out=taken)
            rest += taken
            rest -= 1
        began = np.zeros(width, lengths.dtype)
        began[:-1] = rest[1:]
        columns = np.flatnonzero(began)
        at = began[columns]
        for k in range(height - 1, -1, -1):
            if not len(columns):
                break
            new, old = at == 0, path[k, columns]
            path[k, columns] = new
            at = np.where(new, lengths[k, columns], at) - lengths.dtype.type(1)
            changed = ~(new & old)
            if k == 0:
                rest[columns[changed]] = at[changed]
            columns, at = columns[changed], at[changed]
        if len(columns):
            first = rest.tolist()
            for w in range(width - 2, -1, -1):
                if first[w + 1] != began[w]:
                    r = first[w + 1]
                    for k in range(height - 1, -1, -1):
                        new = r == 0
                        r = (int(lengths[k, w]) if new else r) - 1
                        if new and path[k, w]:
                            break
                        path[k, w] = new
                    else:
                        first[w] = r
        return path

    def _buffer(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes with a mark before each text, the same in columns, and the places of the marks."""
        mark = bytes([self.mark])
        n = sum(map(len, raws)) + len(raws)
        height = max(16, min(HEIGHT, int(n**0.5 / 2)))
        data = np.frombuffer(mark + mark.join(raws) + mark * (-n % height), np.uint8)
        marks = np.cumsum([0, *(len(x) + 1 for x in raws[:-1])])
        return data, np.ascontiguousarray(data.reshape(-1, height).T), marks

    def _found(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """In columns: the last token of the best way to each byte, as its id and 1, or 0 for a mark between texts; where the
        tokens of the best way of all end. And how many marks follow the last text."""
        data, down, marks = self._buffer(raws)
        last = self._states(down, self.emits)
        lengths = np.empty(last.shape, self.lengths.dtype)
        for k in range(0, len(last), ROWS):
            np.take(self.lengths, last[k : k + ROWS], out=lengths[k : k + ROWS], mode="clip")
        path = self._ends(lengths)
        after = np.arange(marks[-1] + len(raws[-1]) + 1, len(data))
        for at in (marks, after):
            last[at % len(down), at // len(down)] = 0
        return last, path, len(after)

    def ids(self, raws: list[bytes]) -> np.ndarray:
        """The token ids of all texts, one after the other, with -1 before each text."""
        if not raws:
            return np.zeros(0, np.int32)
        last, path, after = self._found(raws)
        found = np.ascontiguousarray(last.T).ravel()[np.ascontiguousarray(path.T).ravel()]
        return found[: len(found) - after].astype(np.int32) - 1

    def counts(self, raws: list[bytes]) -> np.ndarray:
        """The number of each id in all texts."""
        seen = np.zeros(self.kinds + 1, np.int64)
        if raws:
            last, path, _ = self._found(raws)
            for k in range(0, len(path), ROWS):
                seen += np.bincount((last[k : k + ROWS] * path[k : k + ROWS]).ravel(), minlength=len(seen))
        return seen[1:]

    def pairs(self, raws: list[bytes]) -> np.ndarray:
        """The number of each id before each other one: ``[left, right]``, with the end of a text as one more on the right."""
        n = self.kinds + 1
        seen = np.zeros(n * n, np.int64)
        if raws:
            last, path, _ = self._found(raws)
            # what follows a column: the first token that ends in the next one that has any
            first = last[path.argmax(axis=0), np.arange(path.shape[1])]
            filled = np.where(path.any(axis=0), np.arange(path.shape[1]), path.shape[1])
            filled = np.append(np.minimum.accumulate(filled[::-1])[::-1][1:], path.shape[1])
            after = np.append(first, first.dtype.type(0))[filled]
            for to in range(len(path), 0, -ROWS):
                own, ends = last[max(0, to - ROWS) : to], path[max(0, to - ROWS) : to]
                mask = np.negative(ends.astype(own.dtype))
                right, change = np.empty(own.shape, own.dtype), np.empty(own.shape[1], own.dtype)
                for k in range(len(own) - 1, -1, -1):
                    right[k] = after
                    np.bitwise_xor(after, own[k], out=change)
                    change &= mask[k]
                    after ^= change
                # of two marks, which is what is counted where no token ends, nothing is told
                both = own.astype(np.intp)
                both *= n
                both += right
                both *= ends
                seen += np.bincount(both.ravel(), minlength=len(seen))
        seen = seen.reshape(n, n)[1:]
        return np.concatenate([seen[:, 1:], seen[:, :1]], axis=1)

    def costs(self, raws: list[bytes]) -> np.ndarray:
        """The cost of each text."""
        if not raws:
            return np.zeros(0, np.int64)
        _, down, marks = self._buffer(raws)
        adds = np.ascontiguousarray(self._states(down, self.adds).T).ravel()
        adds[marks] = 0
        adds[marks[-1] + len(raws[-1]) + 1 :] = 0
        return np.add.reduceat(adds, marks, dtype=np.int64)
