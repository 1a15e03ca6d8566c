"""A training-data pipeline over ``documents``: the stages in order, each over all that the one before kept.

Every stage but the last returns the columns of ``documents``; the last returns packed pieces. A stage
takes (spark, docs, sf_dir), and its result is written as Parquet and reread as the next one's docs.

Defined cases: a null text is an empty one in every stage and stays null; rows without an id stay but for what
their texts decide; of rows equal in id and text one stays; extra columns, of any name, are kept; an empty table
gives empty results with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import decontaminate as decontamination
from glyphmill.llm import near_dedup, pack, quality, secrets
from glyphmill.llm._common import Workspace, read


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return near_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by their kinds."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their token ids, packed into sequences."""
    return pack.pack(docs, keep_ids=True)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_benchmark),
    ("secrets", without_secrets),
    ("pack", packed),
]

#: Trained scores, full-set similarity and token ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = read(spark, sf_dir, "documents"), Workspace(spark)
    before = None
    for _, stage in STAGES[:-1]:
        after = work.cut(stage(spark, docs, sf_dir))
        if before is not None:
            work.drop(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
