"""The corpus pipeline: quality rules, near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, in their order.

Defined results of every stage: an empty table gives no rows; null keys, sources, languages and counts are values like any other; null texts are empty ones; a text of
any length is worked on whole; rows that repeat a document are documents of their own; further columns are handed on (by the last stage: left out), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.base import cut
from quire.llm.jaccard import keep_one
from quire.llm.mixing import mixed_documents
from quire.llm.packing import pack
from quire.llm.quality import keep_good
from quire.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the votes keep (operator 6). Null and empty texts fail the base conditions and go; equal texts have equal verdicts; a posterior of exactly one half stays."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 on five-word shingles (operator 9): that with the least key, a null key before all, then the least digest; of rows that tie in both, any one.

    Texts without words are linked to equal ones alone, so one of each kind of them stays.
    """
    return keep_one(docs, threshold=0.8, tolerance=1e-6)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document; a document taken twice is there twice (operator 7).

    Documents without words, and those that the mix takes nothing of, are gone; ``n_chars`` is counted anew (also where it was null). The same rows give the same mix, however they are dealt.
    """
    return mixed_documents(docs, seed=7, block=128)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in sequences of 2048 tokens (operator 2). A text without tokens is a piece of the end id alone; pieces of one length are alike to the plan, so ties change no count."""
    return pack(docs, tokenizer("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Votes, signatures, draws and tokens aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
