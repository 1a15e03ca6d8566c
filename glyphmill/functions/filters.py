"""Character filters as Column functions, and byte-string helpers.

Two dialects exist. In the chunk dialect a whole text is one unit; in the line dialect each line is, and
every line ends with a newline in the result. All of it stays in built-in expressions.

A byte string is text with one character (U+0000 to U+00FF) for each byte, so that string functions work on
bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reserved characters.
UNKNOWN = "\ue000"
HEX_MARK, BIT_0, BIT_1 = "\x10", "\x11", "\x12"
END_OF_FRAGMENT = "\ue013"
CAPITALIZE, ALL_CAPS, END_OF_WORD = "\x14", "\x15", "\x16"

Filter = Callable[[Column], Column]


def byte_string(text: Column) -> Column:
    """The UTF-8 bytes of a text, one character each."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def hex_bytes(text: Column) -> Column:
    """Upper-case pairs of hex digits, one for each UTF-8 byte."""
    return F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))


def _runs(text: Column, letter: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"({letter}+|{letter.replace('p{', 'P{')}+)"), F.lit(1))


def _lower_each(word: Column) -> Column:
    """Lower case character by character, so no character's case depends on its place."""
    return F.array_join(F.transform(F.split(word, ""), F.lower), "")


def reserved(text: Column) -> Column:
    """Reserved control characters become U+E000; all else stays."""
    return F.regexp_replace(text, "[\x10-\x17]", UNKNOWN)


def caps(text: Column) -> Column:
    """Chunk dialect: capitalized and all-capital words become a mark and lower case."""
    runs = _runs(text, r"\p{L}")

    def one(w: Column, k: Column) -> Column:
        tail_is_lower = w.rlike(r"^.[\p{L}&&[^\p{Lu}\p{Lt}]]*$") & w.rlike(r"^.*[\p{IsLowercase}]")
        single_inside = (F.length(w) == 1) & (k < F.size(runs) - 1)
        return (
            F.when(~w.rlike(r"^\p{L}"), w)
            .when(w.rlike(r"^\p{Lu}") & (tail_is_lower | single_inside), F.concat(F.lit(CAPITALIZE), _lower_each(w)))
            .when(w.rlike(r"^[\p{L}&&[^\p{IsLowercase}\p{Lt}]]*$") & w.rlike(r"\p{Lu}"), F.concat(F.lit(ALL_CAPS), _lower_each(w)))
            .otherwise(w)
        )

    return F.array_join(F.transform(runs, one), "")


def words(text: Column) -> Column:
    """Chunk dialect: a mark after each word; one space before a word, a case mark or the end goes."""
    marked = F.regexp_replace(text, r"(\p{L}+)", f"$1{END_OF_WORD}")
    return F.regexp_replace(marked, rf"{END_OF_WORD} ([\p{{L}}{CAPITALIZE}{ALL_CAPS}]|\z)", f"{END_OF_WORD}$1")


def _line_caps(line: Column) -> Column:
    def one(w: Column) -> Column:
        first = F.substring(w, 1, 1)
        lowered = F.array_join(F.transform(F.split(w, ""), lambda c: F.substring(F.lower(c), 1, 1)), "")
        return (
            F.when(w.rlike(r"^\p{IsUppercase}\p{IsLowercase}*$"), F.concat(F.lit(CAPITALIZE), F.substring(F.lower(first), 1, 1), F.substr(w, F.lit(2))))
            .when(w.rlike(r"^\p{IsUppercase}+$"), F.concat(F.lit(ALL_CAPS), lowered))
            .otherwise(w)
        )

    return F.array_join(F.transform(_runs(line, r"\p{IsAlphabetic}"), one), "")


def _line_words(line: Column) -> Column:
    marked = F.regexp_replace(line, r"(\p{IsAlphabetic}+)", f"$1{END_OF_WORD}")
    return F.regexp_replace(marked, rf"{END_OF_WORD} (\p{{IsAlphabetic}})", f"{END_OF_WORD}$1")


def filter_lines(text: Column, with_caps: bool = False, with_words: bool = False) -> Column:
    """Line dialect. Words are marked on the line as it is, then case; CRLF and a missing last newline become LF."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"\n\z", ""), "\n")

    def one(line: Column) -> Column:
        line = _line_words(line) if with_words else line
        return _line_caps(line) if with_caps else line

    joined = F.concat(F.array_join(F.transform(lines, one), "\n"), F.lit("\n"))
    return F.when(text == "", F.lit("")).otherwise(joined)


BY_NAME: dict[str, Filter] = {"reserved": reserved, "caps": caps, "words": words}


def compose(names: Iterable[str]) -> Filter:
    """Filters applied from left to right."""
    return lambda text: reduce(lambda t, name: BY_NAME[name](t), names, text)
