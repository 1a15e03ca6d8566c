"""Optimal segmentation of streams: tokens are emitted as soon as no later byte can change them.

State for each key: the automaton's state, the costs of the last few places, the choices not yet fixed, and pieces that
came before their turn.
A token reaches back at most the longest token's length, so what all open places agree on is final.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from glyphmill.operators.segment import Automaton
from glyphmill.operators.vocabulary import Vocabulary

OUTPUT = "key string, pos long, token binary"


class Incremental:
    """The same segmentation as ``Automaton.ids``, piece by piece."""

    def __init__(self, machine: Automaton) -> None:
        self.machine = machine
        self.state, self.base = 0, 0  # base: the place up to which tokens are final
        self.cost: list[int] = [0]  # of the places from base on
        self.back: list[tuple[int, int]] = [(0, 0)]  # (length, id) of the best last token there

    def feed(self, data: bytes) -> list[int]:
        m, cost, back = self.machine, self.cost, self.back
        for b in data:
            self.state = m.step[self.state][b]
            n, best = len(cost), None
            for length, price, i in m.ends[self.state]:
                if length <= n and (best is None or cost[n - length] + price < best[0]):
                    best = (cost[n - length] + price, length, i)
            cost.append(best[0])
            back.append((best[1], best[2]))
        return self._settle()

    def _path(self, place: int) -> list[int]:
        """Places at which tokens end, from the first after the base to ``place``."""
        out = []
        while place:
            out.append(place)
            place -= self.back[place][0]
        return out[::-1]

    def _settle(self) -> list[int]:
        """Tokens that the best ways to all of the last places (as many as the longest token) share."""
        end = len(self.cost) - 1
        open_places = range(max(0, end - self.machine.longest + 1), end + 1)
        if open_places[0] == 0:
            return []
        shared = None
        for p in open_places:
            way = self._path(p)
            if shared is None:
                shared = way
            else:
                k = 0
                while k < min(len(shared), len(way)) and shared[k] == way[k]:
                    k += 1
                shared = shared[:k]
            if not shared:
                return []
        out = [self.back[p][1] for p in shared]
        cut = shared[-1]
        del self.cost[:cut], self.back[:cut]
        self.back[0] = (0, 0)
        self.base += cut
        return out

    def finish(self) -> list[int]:
        return [self.back[p][1] for p in self._path(len(self.cost) - 1)]


class Key:
    """What a key has so far: the open segmentation, the next piece's number, and pieces that came before their turn."""

    def __init__(self, machine: Automaton, saved: bytes | None = None) -> None:
        self.work, self.due, self.pos, self.early = Incremental(machine), 0, 0, {}
        if saved is not None:
            way, self.due, self.pos, self.early = pickle.loads(saved)
            self.work.state, self.work.base, self.work.cost, self.work.back = way

    def dumps(self) -> bytes:
        w = self.work
        return pickle.dumps(((w.state, w.base, w.cost, w.back), self.due, self.pos, self.early))

    def take(self, pieces: Iterable[tuple[int, str | None, bool]]) -> list[bytes]:
        """Pieces (number, text, last) in any order -> the tokens that are final now. A number seen before is a repeat."""
        machine = self.work.machine
        for seq, text, last in pieces:
            if seq >= self.due:
                self.early.setdefault(int(seq), ((text or "").encode(), bool(last)))
        out: list[int] = []
        while self.due in self.early:
            data, last = self.early.pop(self.due)
            self.due += 1
            out += self.work.feed(data)
            if last:  # the next piece begins a new text
                out += self.work.finish()
                self.work = Incremental(machine)
        tokens = [machine.string(i) for i in machine.expand(out)]
        self.pos += len(tokens)
        return tokens


class _Segmenter(StatefulProcessor):
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.machine = Automaton(self.vocabulary)
        self.saved = handle.getValueState("key", "key binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = Key(self.machine, bytes(self.saved.get()[0]) if self.saved.exists() else None)
        first, tokens = state.pos, []
        for part in rows:
            tokens += state.take(zip(part["seq"], part["text"], part["last"]))
        self.saved.update((state.dumps(),))
        yield pd.DataFrame({
            "key": pd.Series([key[0]] * len(tokens), dtype=object),
            "pos": pd.Series(range(first, first + len(tokens)), dtype="int64"),
            "token": pd.Series(tokens, dtype=object),
        })

    def close(self) -> None:
        pass


def segment_stream(stream: DataFrame, vocabulary: Vocabulary, key_col: str = "key", seq_col: str = "seq", text_col: str = "text", last_col: str = "last") -> DataFrame:
    """A stream of pieces (key, seq, text, last) -> key, pos, token.

    A key's pieces are numbered from 0 without gaps; ``last`` ends a text, and the next number begins the key's next one.
    Pieces may come in any order and more than once: an early one waits in the state for its turn.
    """
    rows = stream.select(F.col(key_col).cast("string").alias("key"), F.col(seq_col).cast("long").alias("seq"), F.col(text_col).alias("text"), F.col(last_col).alias("last"))
    return rows.groupBy("key").transformWithStateInPandas(_Segmenter(vocabulary), OUTPUT, "append", "none")
