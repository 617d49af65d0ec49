"""Corpus pipeline: judge, thin out and pack the documents of a folder of tables.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of ``docs``.  Models are fitted on the labelled rows of the
folder's own ``documents``, so a stage does not depend on what earlier stages threw out.

Defined cases: a row without an id is judged like any other and is not grouped; rows that
repeat id and text are judged alike, and one of them stays.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rentlake.llm import ngram_join, packing, quality_knn, quality_rules
from rentlake.session import cut_lineage, tune


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose labelled neighbours vote for them."""
    return quality_knn.keep(docs, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the count rules and the calibrated regression."""
    return quality_rules.keep(docs, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return ngram_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_rules),
    ("n-gram Jaccard join", drop_near_copies),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    tune(spark)
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
