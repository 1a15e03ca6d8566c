"""Language of web pages by Bayesian fusion of text, markup, address and host evidence.

1. Character trigrams of documents of known language, counted per language over all documents, give the
   likelihood of a page's main text under each language; it is tempered, as trigrams are not independent.
2. What the page declares (the html element's lang) and the suffix of its address are evidence as far as
   they go with the text's language over all pages: P(declared | language) and P(suffix | language) come
   from grouped counts, smoothed.
3. The prior is that of the host, smoothed towards its domain's, that towards all pages'. A page's own text
   is taken out of the counts that it meets.
The posterior is proportional to the product; the best language and its share are returned.

Scale: the model has a fixed number of buckets for each language; pages are parsed once into rows of a few
numbers, and only those are aggregated and joined (by suffix, host and domain, pre-aggregated).

Defined cases: a page without text has no text evidence, the rest decides; unknown or missing declarations
and suffixes are no evidence; without any document of known language the result is null; ties go to the
language first in order; repeated rows count as pages each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._common import Workspace, texts
from glyphmill.llm.extract import host, main_text

BUCKETS = 1 << 14
TEMPER, STRENGTH = 0.2, 5.0  # exponent of the text likelihood; weight of a parent's shares in smoothing
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})", re.I)


def trigrams(raw: bytes) -> np.ndarray:
    """How often each bucket's trigrams of bytes occur in the lower-cased text."""
    b = np.frombuffer(b" " + raw.lower() + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(18), minlength=BUCKETS)


class TextModel:
    """weight: log-probability of each bucket under each language."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        n = np.array([counts[x] for x in self.languages], float).reshape(-1, BUCKETS)
        self.weight = np.log((n + 1) / (n.sum(1, keepdims=True) + BUCKETS))

    def likelihoods(self, raw: bytes) -> list[float]:
        return (self.weight @ trigrams(raw)).tolist()


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> TextModel:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(batch["lang"].to_pylist(), texts(batch["text"]), strict=True):
                if lang not in seen:
                    seen[lang] = np.zeros(BUCKETS, np.int64)
                seen[lang] += trigrams(raw)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    rows = (
        docs.where(F.col(lang_col).isNotNull())
        .select(F.lower(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts: dict[str, np.ndarray] = {}
    for lang in rows["lang"].unique().to_pylist():
        part = rows.filter(pc.equal(rows["lang"], lang))
        counts[lang] = np.zeros(BUCKETS)
        counts[lang][part["bucket"].to_numpy()] = part["n"].to_numpy()
    return TextModel(counts)


def evidence(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, host, declared (place of a known language or null), best (likewise), ll (tempered)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        places = {x: i for i, x in enumerate(m.languages)}
        for batch in batches:
            declared, best, ll = [], [], []
            for page in batch["html"].to_pylist():
                page = page or ""
                d = DECLARED.search(page)
                declared.append(places.get(d.group(1).lower()) if d else None)
                text = main_text(page, set())
                x = [TEMPER * v for v in m.likelihoods(text.encode())] if text else [0.0] * len(places)
                ll.append(x)
                best.append(int(np.argmax(x)) if text and x else None)
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], batch["host"], pa.array(declared, pa.int32()), pa.array(best, pa.int32()), pa.array(ll, pa.list_(pa.float64()))],
                names=["page_id", "url", "host", "declared", "best", "ll"],
            )

    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    kind = source.schema["page_id"].dataType.simpleString()
    return source.mapInArrow(run, f"page_id {kind}, url string, host string, declared int, best int, ll array<double>")


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per page: page_id, url, lang, confidence, text_lang, declared_lang."""
    work = Workspace(pages.sparkSession)
    model = train(docs, text_col, lang_col)
    names = model.languages
    size = len(names)
    found = work.cut(evidence(pages, model, id_col, url_col, html_col))
    if not size:
        none = F.lit(None).cast("string")
        return found.select("page_id", "url", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), none.alias("declared_lang"))
    found = found.withColumn("suffix", F.regexp_extract("host", r"\.([a-z]{2,})$", 1)).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    of_language = F.array(*[F.count_if(F.col("best") == k) for k in range(size)])
    counts = lambda key: found.groupBy(key).agg(of_language.alias(f"n_{key}"))
    pairs = {(r["declared"], r["best"]): r["n"] for r in found.where("best is not null").groupBy("declared", "best").agg(F.count("*").alias("n")).collect()}
    every = [sum(n for (_, b), n in pairs.items() if b == k) for k in range(size)]
    stated = F.array(*[F.lit(pairs.get((d, k), 0)) for d in range(size) for k in range(size)])
    total = F.array(*map(F.lit, every))
    own = lambda k: F.coalesce((F.col("best") == k).cast("int"), F.lit(0))
    less = F.when(F.col("best").isNotNull(), 1).otherwise(0)
    m = STRENGTH
    whole = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)

    def log_score(k):
        one = own(k)
        share = (F.get(total, k) - one + 1.0) / (sum(every) - less + float(size))
        share = (F.get("n_domain", k) - one + m * share) / (whole("n_domain") - less + m)
        share = (F.get("n_host", k) - one + m * share) / (whole("n_host") - less + m)
        n = F.get(total, k) - one
        said = F.when(F.col("declared").isNull(), 0.0).otherwise(F.log((F.get(stated, F.col("declared") * size + k) - one + m / size) / (n + m)))
        tail = F.when(F.col("suffix") == "", 0.0).otherwise(F.log((F.get("n_suffix", k) - one + m / size) / (n + m)))
        return F.get("ll", k) + F.log(share) + said + tail

    # only the keys' counts are wide; a hot host's rows are a few numbers each and can be split
    joined = found.join(counts("suffix"), "suffix").join(counts("domain"), "domain").join(counts("host"), "host")
    scored = joined.withColumn("s", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), log_score))
    top = F.array_max("s")
    mass = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    label = F.array(*map(F.lit, names))
    return scored.select(
        "page_id",
        "url",
        F.get(label, (F.array_position("s", top) - 1).cast("int")).alias("lang"),
        (1.0 / mass).alias("confidence"),
        F.get(label, F.col("best")).alias("text_lang"),
        F.get(label, F.col("declared")).alias("declared_lang"),
    )


def op6_langid(spark, sf_dir: str) -> DataFrame:
    from glyphmill.llm._common import read

    return identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))
