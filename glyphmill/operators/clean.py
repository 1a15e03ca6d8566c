"""Clean-up of book texts: header and footer removal, paragraph unwrapping, merging."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.filters import END_OF_FRAGMENT

# Prefixes of lines that end a header.
START_MARKERS = [
    "*END*THE SMALL PRINT",
    "*** START OF THE PROJECT GUTENBERG",
    "*** START OF THIS PROJECT GUTENBERG",
    "This etext was prepared by",
    "E-text prepared by",
    "Produced by",
    "Distributed Proofreading Team",
    "Proofreading Team at http://www.pgdp.net",
    "http://gallica.bnf.fr)",
    "      http://archive.org/details/",
    "http://www.pgdp.net",
    "by The Internet Archive)",
    "by The Internet Archive/Canadian Libraries",
    "by The Internet Archive/American Libraries",
    "public domain material from the Internet Archive",
    "Internet Archive)",
    "Internet Archive/Canadian Libraries",
    "Internet Archive/American Libraries",
    "material from the Google Print project",
    "*END THE SMALL PRINT",
    "***START OF THE PROJECT GUTENBERG",
    "This etext was produced by",
    "*** START OF THE COPYRIGHTED",
    "The Project Gutenberg",
    "http://gutenberg.spiegel.de/ erreichbar.",
    "Project Runeberg publishes",
    "Beginning of this Project Gutenberg",
    "Project Gutenberg Online Distributed",
    "Gutenberg Online Distributed",
    "the Project Gutenberg Online Distributed",
    "Project Gutenberg TEI",
    "This eBook was prepared by",
    "http://gutenberg2000.de erreichbar.",
    "This Etext was prepared by",
    "This Project Gutenberg Etext was prepared by",
    "Gutenberg Distributed Proofreaders",
    "Project Gutenberg Distributed Proofreaders",
    "the Project Gutenberg Online Distributed Proofreading Team",
    "**The Project Gutenberg",
    "*SMALL PRINT!",
    "More information about this book is at the top of this file.",
    "tells you about restrictions in how the file may be used.",
    "l'authorization à les utilizer pour preparer ce texte.",
    "of the etext through OCR.",
    "*****These eBooks Were Prepared By Thousands of Volunteers!*****",
    "We need your donations more than ever!",
    " *** START OF THIS PROJECT GUTENBERG",
    "****     SMALL PRINT!",
    '["Small Print" V.',
    "      (http://www.ibiblio.org/gutenberg/",
    "and the Project Gutenberg Online Distributed Proofreading Team",
    "Mary Meehan, and the Project Gutenberg Online Distributed Proofreading",
    "                this Project Gutenberg edition.",
]

# Prefixes of lines that begin a footer.
END_MARKERS = [
    "*** END OF THE PROJECT GUTENBERG",
    "*** END OF THIS PROJECT GUTENBERG",
    "***END OF THE PROJECT GUTENBERG",
    "End of the Project Gutenberg",
    "End of The Project Gutenberg",
    "Ende dieses Project Gutenberg",
    "by Project Gutenberg",
    "End of Project Gutenberg",
    "End of this Project Gutenberg",
    "Ende dieses Projekt Gutenberg",
    "        ***END OF THE PROJECT GUTENBERG",
    "*** END OF THE COPYRIGHTED",
    "End of this is COPYRIGHTED",
    "Ende dieses Etextes ",
    "Ende dieses Project Gutenber",
    "Ende diese Project Gutenberg",
    "**This is a COPYRIGHTED Project Gutenberg Etext, Details Above**",
    "Fin de Project Gutenberg",
    "The Project Gutenberg Etext of ",
    "Ce document fut presente en lecture",
    "Ce document fut présenté en lecture",
    "More information about this book is at the top of this file.",
    "We need your donations more than ever!",
    "END OF PROJECT GUTENBERG",
    " End of the Project Gutenberg",
    " *** END OF THIS PROJECT GUTENBERG",
]

# Prefixes of lines around legal notices.
LEGAL_START, LEGAL_END = ["<<THIS ELECTRONIC VERSION OF"], ["SERVICE THAT CHARGES FOR DOWNLOAD"]

# Prefixes of first paragraphs that are left out.
SKIPPED = [
    "***",
    "All of the original Project Gutenberg Etexts",
    "These original Project Gutenberg Etexts will be compiled into a file",
    "This is a retranscription of one of the first Project",
]

HEADER_LINES, FOOTER_LINES = 600, 100  # kept lines up to which a header may end, and from which a footer may begin


_MARKERS = tuple(START_MARKERS + END_MARKERS + LEGAL_START + LEGAL_END)
_BREAK = re.compile(r"\r\n|\n|\r")


def stripped(text: str, header: int = HEADER_LINES, footer: int = FOOTER_LINES) -> str:
    """One text without header, footer and legal notices: only lines that begin with a marker are looked at."""
    lines = _BREAK.split(text)
    if lines[-1] == "":
        lines.pop()  # a final line break makes no line of its own
    drop: list[tuple[int, int]] = []  # ranges of lines left out
    gone, legal, end = 0, None, len(lines)  # lines left out so far; where an open notice begins
    for k in (k for k, line in enumerate(lines) if line.startswith(_MARKERS)):
        kept = (k if legal is None else legal) - gone
        if kept <= header and lines[k].startswith(tuple(START_MARKERS)):
            drop.append((0, k + 1))
        elif kept >= footer and lines[k].startswith(tuple(END_MARKERS)):
            end = k
            break
        elif lines[k].startswith(tuple(LEGAL_START)):
            if legal is None:
                legal = k
            continue
        elif lines[k].startswith(tuple(LEGAL_END)):
            drop.append((k if legal is None else legal, k + 1))
            gone += k + 1 - drop[-1][0]
            legal = None
            continue
        else:
            continue
        if legal is None:
            gone += 1
    if legal is not None:
        drop.append((legal, end))
    out, at = [], max((b for a, b in drop if a == 0), default=0)
    for a, b in sorted(drop):
        if b > at:
            out += lines[at : max(a, at)]
            at = b
    return "\n".join(out + lines[at:end])


def _paragraph(lines: list[str]) -> list[str]:
    """Prose as one line, verse and lists as they are."""
    bare = [x.strip() for x in lines]
    upper = [x[0].isupper() for x in bare]
    breaks = any(up and before[-1] not in ".!?" for before, up in zip(bare, upper[1:]))
    if breaks and all(up or not x[0].isalpha() for x, up in zip(bare, upper)):
        return lines
    return [" ".join([lines[0].rstrip(), *bare[1:]])]


def unwrapped(text: str) -> str:
    """One text with its paragraphs unwrapped, from the first retained one on."""
    out: list[str] | None = None
    lines = text.split("\n")
    for blank, run in itertools.groupby(enumerate(lines), key=lambda x: not x[1].strip()):
        places, part = zip(*run)
        if out is None:
            final = places[-1] == len(lines) - 1
            if blank or (not final and part[0].startswith(tuple(SKIPPED))):
                continue
            out = [] if final else ["", ""]
        out += [""] * len(part) if blank else _paragraph(list(part))
    return "\n".join(out or [])


def _each(function: Callable[[str], str]) -> Callable[[Column], Column]:
    """Row by row; a null text is an empty one."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([function(x) if x else "" for x in column.to_pylist()], pa.string())

    return run


def strip_headers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", header: int = HEADER_LINES, footer: int = FOOTER_LINES) -> DataFrame:
    """id, text without header, footer and legal notices. A text of which nothing is left is empty.

    Up to ``header`` kept lines, a start marker drops all before it and itself; from ``footer`` kept lines on,
    an end marker stops the text. A map of rows: nothing is shuffled, and ids may be null or repeated.
    """
    return docs.select(id_col, _each(lambda x: stripped(x, header, footer))(F.col(text_col)).alias("text"))


def clean_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text with paragraphs unwrapped, and without the first paragraphs that are notices. A map of rows.

    A blank line is empty in the result. All before the first retained paragraph goes; if a blank line ended
    that paragraph, two empty lines stand before it. A paragraph that the text's end ends is always retained.
    """
    return docs.select(id_col, _each(unwrapped)(F.col(text_col)).alias("text"))


def merge_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the merged corpus: the fragments in the order of ids, as text files whose names are in that order."""
    found = fragments(docs, id_col, text_col)  # each ends with the mark, which the writer puts after each row
    found.repartitionByRange(id_col).sortWithinPartitions(id_col).select(F.rtrim("fragment", F.lit(END_OF_FRAGMENT)).alias("value")).write.option("lineSep", END_OF_FRAGMENT).text(path)


def fragments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fragment: the text to the end of its last line that is not blank, a newline and the end mark.

    Blank texts have no row. Written in the order of ids, the fragments are the merged corpus.
    """
    body = F.regexp_extract(F.col(text_col), r"(?sU)\A(.*\S[^\n]*\n?)", 1)
    return docs.select(id_col, body.alias("body")).where("body != ''").select(id_col, F.concat("body", F.lit("\n" + END_OF_FRAGMENT)).alias("fragment"))
