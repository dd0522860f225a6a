"""The corpus pipeline: each stage works on all documents which the one before it kept."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from briefloom.llm import stages  # noqa: E402
from briefloom.llm.common import stored, table  # noqa: E402

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.toxicity_filter),
    ("language_id", stages.language_filter),
    ("ngram_jaccard_join", stages.one_of_each_class),
    ("benchmark_decontamination", stages.decontaminated),
    ("byte_level_bpe", stages.tokenised),
]

# Trained models, components of links and ranked merges are not SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
