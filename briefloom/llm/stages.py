"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return its columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from briefloom.llm import bpe, decontam, jaccard, langid, toxicity
from briefloom.llm.common import stored, table

RANK_FILE = "byte_bpe_50k.tiktoken"
# doc_ids of dropped rows are broadcast up to so many; beyond, the join is shuffled
BROADCAST_IDS = 2_000_000


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], condition: Column) -> DataFrame:
    """Rows of docs for which the condition holds on what `judge` adds; columns of docs keep their names and values, also where an
    operator adds one of the same name: all but those which are judged travel under other names."""
    own = [n if n in ("doc_id", "text", "lang") else f"_column_{i}" for i, n in enumerate(docs.columns)]
    rows = judge(docs.toDF(*own)).filter(condition)
    return rows.select(*(F.col(x).alias(n) for x, n in zip(own, docs.columns)))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from all labelled rows of docs, reject those at or over the threshold of their language."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda rows: toxicity.score(rows, model), ~F.col("toxic_flag"))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject rows in which no language is found: no letters, or no language with half of the posterior."""
    model = langid.train(docs)
    return _kept(docs, lambda rows: langid.predict(rows, model), ~langid.rejects(F.col("score"), F.col("lang_pred")))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest doc_id stays. Rows with a null doc_id stay."""
    classes = jaccard.classes(docs)
    dropped = stored(classes.filter("component_id <> doc_id").select("doc_id").distinct())
    few = dropped.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(*(F.col(f"`{n}`") for n in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated rows go; rows below the limit stay as they are."""
    benchmark = table(spark, sf_dir, "benchmark")
    return _kept(docs, lambda rows: decontam.contamination(rows, benchmark), ~F.col("contaminated"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row's whole text: doc_id, lang, source, n_tokens, ids. Null texts have none."""
    ranks = bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    tokens = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    return tokens.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")
