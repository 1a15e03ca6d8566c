import math
import random
import re
from collections import Counter

from glyphmill.llm import langid as L


def buckets(text):
    """The buckets of the trigrams of bytes of the text between two spaces."""
    b = b" " + text.lower().encode() + b" "
    return [int.from_bytes(b[i : i + 3], "big") * 2654435761 % 2**32 >> 18 for i in range(len(b) - 2)]


def brute_force(pages, counts):
    """By loops over (page_id, url, html): page_id -> (language, confidence). counts: trigrams of each language's texts."""
    languages, m = sorted(counts), L.STRENGTH
    size, rows = len(languages), []
    for i, url, page in pages:
        d = re.search(r"<html lang=\"(\w+)\"", page or "")
        inner = re.search(r"<p>(.*)</article>", page or "")
        text = " ".join(inner.group(1).split()) if inner else ""
        ll = [0.0] * size
        if text:
            for k, language in enumerate(languages):
                total = sum(counts[language].values()) + L.BUCKETS
                ll[k] = L.TEMPER * sum(math.log((counts[language][b] + 1) / total) for b in buckets(text))
        name = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        name = name.group(1).lower() if name else ""
        tail, domain = re.search(r"\.([a-z]{2,})$", name), re.search(r"([^.]+\.[^.]+)$", name)
        declared = languages.index(d.group(1).lower()) if d and d.group(1).lower() in languages else None
        rows.append((i, name, domain.group(1) if domain else "", tail.group(1) if tail else "", declared, ll.index(max(ll)) if text else None, ll))
    n = [Counter((r[c], r[5]) for r in rows if r[5] is not None) for c in (1, 2, 3, 4)]
    every = Counter(r[5] for r in rows if r[5] is not None)
    out = {}
    for i, name, domain, tail, declared, best, ll in rows:
        less, scores = int(best is not None), []
        for k in range(size):
            one = int(best == k)
            share = (every[k] - one + 1) / (sum(every.values()) - less + size)
            for c, key in ((1, domain), (0, name)):
                share = (n[c][key, k] - one + m * share) / (sum(n[c][key, j] for j in range(size)) - less + m)
            s = ll[k] + math.log(share)
            if declared is not None:
                s += math.log((n[3][declared, k] - one + m / size) / (every[k] - one + m))
            if tail:
                s += math.log((n[2][tail, k] - one + m / size) / (every[k] - one + m))
            scores.append(s)
        top = max(scores)
        out[i] = (languages[scores.index(top)], 1 / sum(math.exp(s - top) for s in scores))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = {"en": "the and of with that this", "de": "der und nicht schon ist ein", "fr": "le et dans avec une est"}
    text = lambda x, n: " ".join(rng.choice(vocabulary[x].split()) for _ in range(n))
    docs = [(text(x, 80), x) for x in vocabulary for _ in range(8)] + [(None, "en"), ("the", None)]
    pages = []
    for i in range(80):
        x = rng.choice(list(vocabulary))
        said = rng.choice([x, x, "en", "xx", None])
        tag = f'<html lang="{said}">' if said else "<html>"
        url = rng.choice([f"http://a.site.{x}/p", f"https://u@b.site.{x}:80/", "http://mixed.example.com/x", None, "nonsense"])
        pages.append((i, url, f"{tag}<nav>{text('de', 9)}</nav><article><p>{text(x, rng.choice([0, 1, 2, 40]))}</article>"))
    pages += [(90, "http://a.site.de/p", None), (91, None, None)]
    d = spark.createDataFrame(docs, "text string, lang string")
    p = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS lang", "1 AS host").repartition(3)
    got = {r.page_id: (r.lang, r.confidence) for r in L.identify(p, d).collect()}
    counts = {x: Counter(b for t, y in docs if y == x for b in buckets(t or "")) for x in vocabulary}
    want = brute_force(pages, counts)
    assert got.keys() == want.keys()
    for i, (lang, share) in want.items():
        assert got[i][0] == lang and abs(got[i][1] - share) < 1e-9


def test_empty(spark):
    none = spark.createDataFrame([], "text string, lang string")
    page = spark.createDataFrame([(1, "http://a.de/", "<p>x")], "page_id long, url string, html string")
    assert [tuple(r) for r in L.identify(page, none).collect()] == [(1, "http://a.de/", None, None, None, None)]
    assert L.identify(page.limit(0), spark.createDataFrame([("a", "en")], "text string, lang string")).collect() == []
