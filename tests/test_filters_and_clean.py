import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import filters as X
from glyphmill.operators import clean
from glyphmill.sources import text as sources

C, A, W = X.CAPITALIZE, X.ALL_CAPS, X.END_OF_WORD
CHUNK = [
    ("Hello World.", ["caps"], f"{C}hello {C}world."),
    ("Hello World.", ["caps", "words"], f"{C}hello{W}{C}world{W}."),
    ("NASA says", ["caps"], f"{A}nasa says"),
    ("iPhone", ["caps"], "iPhone"),
    ("I am", ["caps"], f"{C}i am"),
    ("am I", ["caps"], f"am {A}i"),
    ("ab ", ["words"], f"ab{W}"),
    ("ab  cd", ["words"], f"ab{W}  cd{W}"),
    ("ab 1", ["words"], f"ab{W} 1"),
    ("don't", ["words"], f"don{W}'t{W}"),
    ("", ["caps", "words"], ""),
    ("a\x14b", ["reserved"], "a\ue000b"),
]
LINES = [
    ("am I", True, False, f"am {C}i\n"),
    ("ab ", False, True, f"ab{W} \n"),
    ("Hello World.\r\nNASA", True, True, f"{C}hello{W}{C}world{W}.\n{A}nasa{W}\n"),
    ("a\n", False, False, "a\n"),
]


@pytest.mark.parametrize("text, names, want", CHUNK)
def test_chunk_filters(spark, text, names, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.compose(names)(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("text, caps, words, want", LINES)
def test_line_filters(spark, text, caps, words, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.filter_lines(F.col("t"), caps, words)).first()[0] == want


CLEAN = [
    ("One\ntwo.\n", "\n\nOne two.\n"),
    ("One\ntwo.", "One two."),
    ("*** junk\n\nText here.\n", "\n\nText here.\n"),
    ("Roses are red\nViolets are blue\n", "\n\nRoses are red\nViolets are blue\n"),
    ("", ""),
]


def test_clean_vectors(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEAN)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in clean.clean_text(df).collect()}
    assert [got[i] for i in range(len(CLEAN))] == [w for _, w in CLEAN]


def plain_clean(text):
    """The paragraphs' rules as a list of paragraphs, then their texts."""
    runs, now = [], []
    for line in text.split("\n"):
        if line.strip():
            now.append(line)
        else:
            runs += [(now, False)] * bool(now) + [None]
            now = []
    if now:
        runs.append((now, True))

    def unwrapped(lines):
        bare = [x.strip() for x in lines]
        breaks = any(a[-1] not in ".!?" and b[0].isupper() for a, b in zip(bare, bare[1:]))
        if breaks and all(x[0].isupper() or not x[0].isalpha() for x in bare):
            return lines
        return [" ".join([lines[0].rstrip(), *bare[1:]])]

    first = next((k for k, r in enumerate(runs) if r and (r[1] or not unwrapped(r[0])[0].startswith(tuple(clean.SKIPPED)))), None)
    if first is None:
        return ""
    out = [] if runs[first][1] else ["", ""]
    for r in runs[first:]:
        out += unwrapped(r[0]) if r else [""]
    return "\n".join(out)


def plain_strip(text, header, footer):
    out, kept, legal = [], 0, False
    lines = text.splitlines()
    for line in lines:
        if kept <= header and line.startswith(tuple(clean.START_MARKERS)):
            out = []
        elif kept >= footer and line.startswith(tuple(clean.END_MARKERS)):
            break
        elif line.startswith(tuple(clean.LEGAL_START + clean.LEGAL_END)):
            legal = line.startswith(clean.LEGAL_START[0])
        elif not legal:
            out.append(line)
            kept += 1
    return "\n".join(out)


def test_clean_and_strip_against_loops(spark):
    rng = random.Random(6)
    pieces = ["One two", "  three.", "Four", "five!", "", " ", "*** x", "é", "1. a", "Émile"]
    marks = ["Produced by me", "End of Project Gutenberg", "We need your donations more than ever!", clean.LEGAL_START[0] + " x", clean.LEGAL_END[0], "a", "b", "c", ""]
    rows = [(i, "\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    got = {r.doc_id: r.text for r in clean.clean_text(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: plain_clean(t) for i, t in rows}
    rows = [(i, "\n".join(rng.choice(marks) for _ in range(rng.randint(0, 20)))) for i in range(200)]
    got = {r.doc_id: r.text for r in clean.strip_headers(spark.createDataFrame(rows, "doc_id long, text string"), header=6, footer=3).collect()}
    assert got == {i: plain_strip(t, 6, 3) for i, t in rows}


def test_clean_is_a_map_of_rows(spark, tmp_path):
    rows = [(1, "First\ndoc."), (1, "Other\ndoc."), (None, "No id\nhere."), (2, None), (2, ""), (1, "First\ndoc."), (3, "A\n" * 50_000 + "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS line", "1 AS pos").repartition(3)
    key = lambda frame: sorted((str(r.doc_id), r.text) for r in frame.collect())
    assert key(clean.clean_text(df)) == sorted((str(i), plain_clean(t or "")) for i, t in rows)
    assert key(clean.strip_headers(df)) == sorted((str(i), "\n".join((t or "").splitlines())) for i, t in rows)
    assert key(sources.prepare(df)) == key(clean.clean_text(df))
    assert clean.clean_text(df.limit(0)).collect() == [] and clean.strip_headers(df.limit(0)).collect() == []
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    assert not any("Exchange" in f(plain)._jdf.queryExecution().executedPlan().toString() for f in (clean.clean_text, clean.strip_headers))
    clean.merge_texts(spark.createDataFrame([(i, f"text {i}\n\n") for i in range(30)], "doc_id long, text string").repartition(4), str(tmp_path / "merged"))
    merged = "".join(x.read_text() for x in sorted((tmp_path / "merged").glob("part-*")))
    assert merged == "".join(f"text {i}\n\n\ue013" for i in range(30))


def test_fragments_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\n\n\n"), (2, " \n"), (3, "b c"), (4, None), (5, "x \n y\n \n")], "doc_id long, text string")
    assert {r.doc_id: r.fragment for r in clean.fragments(df).collect()} == {1: "a\n\n\ue013", 3: "b c\n\ue013", 5: "x \n y\n\n\ue013"}
    ids = spark.createDataFrame([(7,), (12345,), (10,)], "i int").select(sources.directory_of(F.col("i")), sources.candidate_addresses(F.col("i"), "http://x/")[1]).collect()
    assert [r[0] for r in ids] == ["0/7", "1/2/3/4/12345", "1/10"] and ids[1][1] == "http://x/1/2/3/4/12345/12345-8.txt"
    (tmp_path / "a.txt").write_bytes(b"Hello You\n\nnow\n")
    (tmp_path / "b.txt").write_bytes(b"caf\xe9")
    assert {r.text for r in sources.read_bytes(spark, str(tmp_path)).collect()} == {"Hello You\n\nnow\n", "café"}
    assert sources.read_files(spark, str(tmp_path / "a.txt")).first().text == "Hello You\n\nnow\n"
    sources.write_filtered(spark, str(tmp_path / "a.txt"), str(tmp_path / "out"), caps=True, words=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == [f"{C}hello{W}{C}you{W}", "", f"now{W}"]
    text = "".join(f"line {i}\n" for i in range(200))
    r = sources.sample_pieces(spark.createDataFrame([(5, text), (6, "short")], "doc_id long, text string"), 50).collect()
    piece = {x.doc_id: x.piece for x in r}
    assert piece[6] == "short" and piece[5] in text and piece[5].endswith("\n") and piece[5].startswith("line") and 50 <= len(piece[5]) < 70


def test_slices_make_up_the_file(spark, tmp_path):
    rng = random.Random(3)
    for name in ("a", "b"):
        (tmp_path / name).write_text("".join(rng.choice("aé語𝄞") for _ in range(rng.randint(900, 1000))), encoding="utf-8")
    (tmp_path / "c").write_bytes(b"")
    for size in (7, 64, 100_000):
        got = {}
        for r in sorted(sources.read_slices(spark, str(tmp_path), size).collect(), key=lambda r: (r.path, r.start)):
            got[r.path[-1]] = got.get(r.path[-1], "") + r.text
        assert got == {name: (tmp_path / name).read_text(encoding="utf-8") for name in "ab"}


def test_packed_files(spark, tmp_path):
    import gzip

    (tmp_path / "x.txt.gz").write_bytes(gzip.compress("é one\ntwo".encode()))
    assert sources.read_files(spark, str(tmp_path / "x.txt.gz")).first().text == "é one\ntwo"
    assert [r.text for r in sources.read_chunks(spark, str(tmp_path / "x.txt.gz")).collect()] == ["é one", "two"]
