"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

All stages but the last return the columns of documents. There is no SQL for the rows of run(), as token ids are not
expressible; tests hold the pipeline against a plain version. An empty table gives an empty one at every stage, columns
of other names pass through all stages but the last, and rows without an id are rows like others unless said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontaminate, jaccard, lines, packing, quality
from lodestar.llm.common import cut, table

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then the documents that fail the base rules or lost too much. Null and empty texts have too few
    words and go; repeated rows are judged alike."""
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go; every document stays, though it may be left without text. A null source is no site, a null
    text stays null, and each of repeated rows loses the same lines."""
    return lines.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, and of rows that repeat both id and text one.
    Rows without an id and documents without words are linked with nothing and stay."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none and stay, and repeated rows go together.
    Items without a word are held by nothing."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents left, with their places in sequences. A null text is empty and gives one piece; repeated
    rows give repeated pieces, and pieces of equal length are told apart by id, number and content."""
    return packing.pack(cut(packing.pieces(docs)))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each returns is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
