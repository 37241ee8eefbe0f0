"""From raw documents to packed training sequences, stage by stage; each stage's rows are stored before the next one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from odweave.llm import decontaminate, jaccard, language, packing, quality
from odweave.llm.tables import table
from odweave.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def passing_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep(docs)


def in_a_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with half of their letters or more in learned scripts and three tenths in one learned language."""
    return language.keep(docs, spark.sparkContext.broadcast(language.fit(docs)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: five-word shingles, a Jaccard similarity of 0.8 or more."""
    return jaccard.keep_one(docs, words=5, percent=80)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, decontaminate.item_blocks(table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 4096 tokens."""
    return packing.pack(packing.cut(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, end_id=1), 4096)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", passing_quality),
    ("language_id", in_a_known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmarks),
    ("best_fit_packing", packed),
]
#: Language models, fingerprints and packing are beyond SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
