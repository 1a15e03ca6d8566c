"""Sub-word vocabularies: an ordered set of byte strings with a byte fallback, and its JSON form."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

HEX_BASE = [b"\x10", *(bytes([c]) for c in b"0123456789abcdef")]
BITS_BASE = [b"\x11", b"\x12"]
LITERAL_COST = {"hex": 3, "bits": 8}


@dataclass(frozen=True)
class Token:
    string: bytes
    mandatory: bool = False

    def __repr__(self) -> str:
        return f"Token({as_json_entry(self.string)!r})"


def as_json_entry(string: bytes) -> str | list[int]:
    """Text where the bytes are valid UTF-8, else their values."""
    try:
        return string.decode()
    except UnicodeDecodeError:
        return list(string)


class Vocabulary:
    """Tokens in order. Bytes without a token of their own are literals, written by the fallback."""

    def __init__(self, tokens: Iterable[Token] = ()) -> None:
        self.tokens: list[Token] = []
        self._place: dict[bytes, int] = {}
        for t in tokens:
            self.add_token(t)

    @classmethod
    def hex(cls, strings: Iterable[bytes] = ()) -> Vocabulary:
        return cls(Token(t, True) for t in HEX_BASE)._with(strings)

    @classmethod
    def bits(cls, strings: Iterable[bytes] = ()) -> Vocabulary:
        return cls(Token(t, True) for t in BITS_BASE)._with(strings)

    def _with(self, strings: Iterable[bytes]) -> Vocabulary:
        for s in strings:
            self.add(s)
        return self

    def __len__(self) -> int:
        return len(self.tokens)

    def __contains__(self, string: bytes) -> bool:
        return string in self._place

    def __iter__(self) -> Iterator[Token]:
        return iter(self.tokens)

    def id_of(self, string: bytes) -> int:
        return self._place[string]

    def add_token(self, token: Token) -> None:
        if not token.string or token.string in self._place:
            raise ValueError(f"empty or known already: {token}")
        self._place[token.string] = len(self.tokens)
        self.tokens.append(token)

    def add(self, string: bytes) -> None:
        """No effect if known already."""
        if string not in self._place:
            self.add_token(Token(string))

    def add_ranked(self, ranked: Iterable[bytes], most: int | None = None, added: int | None = None) -> None:
        """The first ``added`` of the ranked strings, until there are ``most`` tokens."""
        for k, s in enumerate(ranked):
            if (added is not None and k >= added) or (most is not None and len(self) >= most):
                return
            self.add(s)

    def remove(self, string: bytes) -> None:
        del self.tokens[self._place[string]]
        self._place = {t.string: i for i, t in enumerate(self.tokens)}

    def without(self, string: bytes) -> Vocabulary:
        return Vocabulary(t for t in self.tokens if t.string != string)

    def copy(self) -> Vocabulary:
        return Vocabulary(self.tokens)

    def sorted(self) -> Vocabulary:
        """In the order of bytes."""
        return Vocabulary(sorted(self.tokens, key=lambda t: t.string))

    @property
    def has_hex(self) -> bool:
        return all(s in self._place for s in HEX_BASE)

    @property
    def has_bits(self) -> bool:
        return all(s in self._place for s in BITS_BASE)

    @property
    def has_bytes(self) -> bool:
        return all(bytes([b]) in self._place for b in range(256))

    @property
    def fallback(self) -> str:
        if self.has_hex:
            return "hex"
        if self.has_bits:
            return "bits"
        raise ValueError("a vocabulary needs the hex digits or the two bits")

    @property
    def literal_cost(self) -> int:
        return LITERAL_COST[self.fallback]

    def fallback_of(self, byte: int) -> list[bytes]:
        """The tokens that write a byte which has none of its own."""
        if self.fallback == "hex":
            return [b"\x10", *(bytes([c]) for c in b"%02x" % byte)]
        return [BITS_BASE[byte >> k & 1] for k in range(7, -1, -1)]

    def suffix_of(self, string: bytes) -> bytes | None:
        """The longest proper suffix that is a token; else the last byte; None for a single byte."""
        if len(string) == 1:
            return None
        return next((string[i:] for i in range(1, len(string)) if string[i:] in self._place), string[-1:])

    def to_json(self, stats: dict | None = None, optimizer: dict | None = None) -> dict:
        out: dict = {"tokens": [as_json_entry(t.string) for t in self.sorted()], "config": {"fallback16": self.fallback == "hex"}}
        return out | ({"stats": stats} if stats else {}) | ({"optimizer": optimizer} if optimizer else {})

    @classmethod
    def from_json(cls, saved: dict) -> Vocabulary:
        """Without a recorded fallback: bits if both bits are there without the hex mark, else hex."""
        strings = [s.encode() if isinstance(s, str) else bytes(s) for s in saved["tokens"]]
        bits = b"\x11" in strings and b"\x12" in strings and b"\x10" not in strings
        hexadecimal = saved.get("config", {}).get("fallback16", not bits)
        return (cls.hex if hexadecimal else cls.bits)(strings)

    def frame(self, spark: SparkSession) -> DataFrame:
        """token_id, token, length, mandatory, suffix (the longest proper suffix that is a token, or a byte)."""
        rows = [(i, bytearray(t.string), len(t.string), t.mandatory, bytearray(s) if (s := self.suffix_of(t.string)) else None) for i, t in enumerate(self)]
        return spark.createDataFrame(rows, "token_id int, token binary, length int, mandatory boolean, suffix binary")


def pretty_lines(data, width: int = 80) -> Iterator[str]:
    """JSON with a value on one line where it fits the width, which shrinks by two with each level."""
    line = json.dumps(data, ensure_ascii=False)
    if len(line) <= width or not isinstance(data, list | dict) or not data:
        yield line
        return
    named = isinstance(data, dict)
    yield "{" if named else "["
    items = list(data.items()) if named else [(None, x) for x in data]
    for k, (name, value) in enumerate(items):
        head = json.dumps(name, ensure_ascii=False) + ": " if named else ""
        flat = json.dumps(value, ensure_ascii=False)
        body = [flat] if named and len(head) + len(flat) + 2 <= width + 1 else list(pretty_lines(value, width - 2))
        body[0] = head + body[0]
        body[-1] += "," if k < len(items) - 1 else ""
        yield from ("  " + x for x in body)
    yield "}" if named else "]"


def pretty_json(data) -> str:
    return "\n".join(pretty_lines(data))


def save_json(data, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in pretty_lines(data))


def load_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
