"""A training corpus from ``documents``, in five stages, each an operator of ``barloom.llm``.

1. The quality classifier rejects documents whose perplexity under trusted text is too high.
2. Language identification rejects documents in no learned language.
3. The n-gram Jaccard join keeps the first document of each group of near copies.
4. Line deduplication removes lines that an earlier document has.
5. Best-fit packing places the tokens of what is left into sequences.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import langid, linededup, ngramjoin, packing, quality
from barloom.llm._common import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.keep_one_of_each(spark, docs)


def repeated_lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.keep_first_lines(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("substring dedup", repeated_lines_stage),
    ("best-fit packing", packing_stage),
]

#: Perplexities, rank-order profiles and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
