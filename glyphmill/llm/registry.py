"""Queries of the training-data operators, one for each, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm.decontaminate import op2_decontaminate
from glyphmill.llm.exact_dedup import op3_exact_dedup
from glyphmill.llm.extract import op5_extract
from glyphmill.llm.langid import op6_langid
from glyphmill.llm.lm import op8_lm
from glyphmill.llm.near_dedup import op4_minhash
from glyphmill.llm.oracle import OP2_SQL, OP3_SQL, OP4_SQL
from glyphmill.llm.pack import op1_pack
from glyphmill.llm.quality import op10_quality
from glyphmill.llm.secrets import op7_secrets
from glyphmill.llm.topk import OP9_SQL, op9_topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pack": op1_pack,
        "op2_decontaminate": op2_decontaminate,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_minhash": op4_minhash,
        "op5_extract": op5_extract,
        "op6_langid": op6_langid,
        "op7_secrets": op7_secrets,
        "op8_lm": op8_lm,
        "op9_topk": op9_topk,
        "op10_quality": op10_quality,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op4_minhash": OP4_SQL, "op9_topk": OP9_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
