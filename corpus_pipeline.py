"""A corpus pipeline of five stages, each one operator of ``lexiweave.llm``.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last
return the columns of ``documents``, extra ones and their names untouched.
:func:`run` writes each stage's result as Parquet and reads it again as the next
stage's documents.  An empty table passes every stage as an empty table.  The
operators' own docstrings say more about odd input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiweave.llm import decontaminate, language, lines, packing, simhash
from lexiweave.llm.common import Scratch
from lexiweave.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; text that is null or has no
    letter goes, rows that repeat fare alike, a null lang teaches nothing."""
    return language.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat or nearly repeat an earlier line; null text
    stays null, no document goes, and rows with one id and text keep the same lines."""
    return lines.dedup(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by the query's own parameters
    (four words, 4 bits): that with the smallest doc_id, a null id after all others,
    one row of a tie; texts without words, null ones included, are one group."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that benchmark items hold; a document that is
    mostly such passages goes, null and empty texts and repeated rows stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed-length token sequences; null text counts as empty, repeated
    rows are packed each."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", packed),
]

#: No SQL: tokenisation and fingerprints are outside of it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
