import html
import random

import numpy as np

from glyphmill.llm import extract as E
from glyphmill.llm import quality as Q
from glyphmill.llm import topk as K


def test_quality(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "nation", "of", "thing", "on"]) for _ in range(rng.randint(5, 60)))
    bad = lambda: " ".join(w + rng.choice(["***", "&&&"]) for w in good().split())
    rows = [(i, good() if i % 3 else bad()) for i in range(400)] + [(500, None), (501, ""), (None, "x"), (1, "the of")]
    labels = [(i, int(i % 3 > 0)) for i in range(400)] + [(None, 1), (7, None), (500, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS y").repartition(3)
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    model = Q.fit(d, y)
    out = Q.quality_scores(d, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held if r.doc_id < 400]) > 0.95
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    kept = Q.keep_good(d, model)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted for r in out)
    assert {r.score for r in Q.quality_scores(d, Q.fit(d, y.limit(0))).collect()} == {0.5}
    assert Q.quality_scores(d.limit(0), model).collect() == []


def test_quality_scores_are_those_of_a_plain_forward_pass(monkeypatch):
    """Each feature by itself: words, their n-grams, pairs of neighbours; averaged; a softmax of two labels."""
    import zlib

    rng = np.random.default_rng(2)
    model = Q.Model(rng.normal(0, 1, Q.BUCKETS).astype(np.float32), 0.3)

    def gram(g):
        return (int.from_bytes(g, "little") + (len(g) << 56)) * 0x9E3779B97F4A7C15 % 2**64 >> 64 - Q.BITS

    def plain(text):
        words, f = text.split(), []
        for w in words:
            f.append(zlib.crc32(w) % Q.BUCKETS)
            b = b"<" + w + b">"
            f += [gram(b[i : i + k]) for k in (3, 4, 5) for i in range(len(b) - k + 1) if k < len(b)]
        f += [((zlib.crc32(a) ^ zlib.crc32(b)) * 0x9E3779B1 % 2**64 >> 9) % Q.BUCKETS for a, b in zip(words, words[1:])]
        z = 0.3 + (np.mean([float(model.weight[x]) for x in f]) if f else 0)
        return f, 1 / (1 + np.exp(-z))

    texts = [b"", b"a", b"one two two  three", "né à".encode(), b"x " * 50, b" ".join(b"w%d" % i for i in range(300)), b"one two"]
    for most in (Q.WORDS, 40, 301):  # few words remembered: forgotten and learned again, texts in parts
        monkeypatch.setattr(Q, "WORDS", most)
        model._forget()
        for t in texts * 2:
            f, want = plain(t)
            assert abs(model.score(t) - want) < 1e-6
            ids, counts = Q.document_features(t)
            assert dict(zip(ids.tolist(), counts.tolist())) == {x: f.count(x) for x in f}


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(300)]
    rows += [(300, None), (350, [float("nan")] * 6), (400, []), (None, [1.0] * 6), (301, [None] + [1.0] * 5), (302, [float("inf")] * 6), (450, [0.5, 0.25]), (451, [0.1, 0.2]), (10, rows[10][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS v").repartition(4)
    use = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    use = [(i, np.array([int(np.floor(256 * float(np.float32(x)))) for x in v])) for (i, _), v in zip(use, [v for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)])]
    want = []
    for q, x in use:
        if q % 50 == 0:
            found = sorted((-int(x @ y), i) for i, y in use if i != q and len(y) == len(x))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    got = [tuple(r) for r in K.top_k(df, block=16).collect()]
    assert sorted(got) == sorted(want) and len([w for w in want if w[0] == 450]) == 1
    assert K.top_k(df.limit(0)).collect() == []
    monkeypatch.setattr(K, "QUERY_BATCH", 3)  # many batches
    monkeypatch.setattr(K, "HELD", 2)
    assert sorted(tuple(r) for r in K.top_k(df, block=16).collect()) == sorted(want)


def test_blocks_are_skipped_where_vectors_gather():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 200, (40, 16))
    rows = np.floor(np.repeat(centres, 100, 0) + rng.normal(0, 8, (4000, 16))).astype(np.int64)
    blocks = [(np.arange(a, a + 50), rows[a : a + 50], rows[a : a + 50].max(0), rows[a : a + 50].min(0)) for a in range(0, 4000, 50)]
    ids = np.arange(0, 4000, 50)
    best = K._Best(len(ids), 5)
    scored = sum(K.search(best, ids, rows[ids], blocks[at : at + 20]) for at in range(0, len(blocks), 20))
    assert scored < 0.2 * len(ids) * len(rows)
    for n, i in enumerate(ids):
        want = sorted((-int(rows[i] @ rows[j]), j) for j in range(4000) if j != i)[:5]
        assert [(-s, j) for s, j in zip(best.score[n], best.id[n])] == want


ARTICLE = "<article><h1>T &amp; {i}</h1><p>one <b>two\n three</b><p>same line<br><ul><li>x<li>y</ul><div class='comments'>bad</div></article>"
PAGE = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home {i}</a></ul></nav><div class=cookie-notice>c</div>{body}<aside>s</aside><form><p>f</p></form><footer>&copy; x</footer><script>if (a<b) '<p>no'</script></body></html>"
PLAIN = "<div class=wrap><p>Read this site</p><div class=text><p>own words {i}</p><p>more &lt;{i}&gt;</p></div></div>"


def test_extraction(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i=i, body=ARTICLE.format(i=i))) for i in range(6)]
    rows += [(10 + i, f"https://u@b.example:80/{i}", PAGE.format(i=i, body=PLAIN.format(i=i))) for i in range(6)]
    rows += [(20, None, None), (21, "http://a.example/", ""), (22, "http://c/", "<p>cut <b>off &am"), (23, "x", "a < b <p>c <i"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS text").repartition(3)
    got = {}
    out = E.extract(df).collect()
    for r in out:
        got[r.page_id] = r.text
        assert r.n_chars == len(r.text)
    assert len(out) == len(rows)
    for i in range(6):
        assert got[i] == f"T & {i}\none two three\nsame line\nx\ny"
        assert got[10 + i] == f"own words {i}\nmore <{i}>"
    assert got[20] == got[21] == "" and got[22] == "cut off &am" and got[23] == "a < b\nc"
    assert html.unescape("&am") == "&am"
    assert E.extract(df.limit(0)).collect() == []


def test_inline_first_and_copies(spark):
    body = "<div class=text><p><a href=/s>Smith {i}</a> said so</p><p><span class=share>Now {i}</span> go on</p><ul><li><a href=/q>Link {i}</a></ul></div>"
    rows = [(i, f"http://a/{i}", PAGE.format(i=i, body=body.format(i=i))) for i in range(4)]
    rows += [(10 + i, f"http://b/{i}", PAGE.format(i=0, body=PLAIN.format(i=0))) for i in range(5)]
    got = {r.page_id: r.text for r in E.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(4):
        assert got[i] == f"Smith {i} said so\nNow {i} go on"
    assert {got[10 + i] for i in range(5)} == {"Read this site\nown words 0\nmore <0>"}


def plain_match(a, b):
    """Simple tree matching as it is defined."""
    if a.label != b.label:
        return 0
    t = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, u in enumerate(a.kids, 1):
        for j, v in enumerate(b.kids, 1):
            t[i][j] = max(t[i - 1][j], t[i][j - 1], t[i - 1][j - 1] + plain_match(u, v))
    return 1 + t[-1][-1]


def test_tree_matching():
    rng = random.Random(4)

    def grown(depth):
        node = E.Node(rng.choice("ab") if depth < 4 else "")
        if depth:
            node.kids = [grown(depth - 1) for _ in range(rng.randint(0, 3))]
        return node

    for _ in range(200):
        a, b = grown(4), grown(4)
        assert E.weights(a, b)[id(a), id(b)] == plain_match(a, b)
    for _ in range(100):
        pairs = [(i, rng.randint(0, 9)) for i in range(rng.randint(0, 8))]
        best = 0
        for mask in range(1 << len(pairs)):
            js = [p[1] for k, p in enumerate(pairs) if mask >> k & 1]
            best = max(best, len(js)) if all(x < y for x, y in zip(js, js[1:])) else best
        got = E._increasing(pairs)
        assert len(got) == best and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_wrappers_find_constant_nodes_among_unlabelled_siblings():
    def page(i, site=True):
        first, last = ("<p>Site name", "<p>All rights reserved") if site else ("", "")
        return f"<body>{first}<p>own {i} text that is long enough to be most of the page<p>more {i} text of the page, also long</p>{last}"

    pages = [page(i) for i in range(12)] + [page(50, site=False)]  # absent from one page
    whole = E.Tree()
    for x in pages:
        root = E.Page(x, with_tree=True).tree()
        whole.add(root, [root.sig])
    again = E.Tree()
    again.add(*E.Tree.loads(whole.dumps()))
    assert whole.template() == again.template() != []
    for i, x in enumerate(pages):
        got = E.main_text(x, {*whole.template()})
        k = i if i < 12 else 50
        assert got == f"own {k} text that is long enough to be most of the page\nmore {k} text of the page, also long"


def test_wrappers_inside_marked_articles():
    note = "<article><p>Story {i} of the day, as long as it may be</p><div>Sign up for our letters</div></article>"
    for n, left_out in ((9, False), (10, True)):  # ten distinct pages are proof enough inside the mark
        whole = E.Tree()
        for i in range(n):
            root = E.Page(note.format(i=i), with_tree=True).tree()
            whole.add(root, [root.sig])
        got = E.main_text(note.format(i=3), {*whole.template()})
        assert got == "Story 3 of the day, as long as it may be" + ("" if left_out else "\nSign up for our letters")


def test_deep_wide_and_long_pages(spark):
    deep = [f"{'<div>' * 6000}text {i}{'</div>' * 6000}" for i in range(3)]
    inline = "<b>" * 6000 + "x<i>y</i>" * 50
    wide = ["".join(f"<p>{i} {k}<div>{k} {i}</div>" for k in range(3000)) for i in range(3)]
    long = "<article><p>" + "word " * 250_000 + "</article>"
    rows = [(i, "http://d/", x) for i, x in enumerate([*deep, inline, *wide, long])]
    out = {r.page_id: r.text for r in E.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()}
    assert [out[i] for i in range(3)] == ["text 0", "text 1", "text 2"]
    assert out[3] == "x" + "yx" * 49 + "y" and len(out[7]) == 250_000 * 5 - 1
    assert out[4].count("\n") == 5999
