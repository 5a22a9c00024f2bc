"""A corpus pipeline: quality rules, exact dedup, near-duplicate join, mixing, SentencePiece encoding.

Each stage is (name, function of (spark, docs, sf_dir)); ``run`` writes its result as Parquet in the shared folder and
gives the reread table to the next one. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellscan.llm import exact_dedup, mixing, ngram_join, piece_dropout, quality_rules
from fellscan.llm.common import landed, table
from fellscan.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines and rejected documents go; n_chars follows the text."""
    kept = quality_rules.clean_documents(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in kept.columns else kept


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that with the smallest doc_id; so does any that names no group."""
    return ngram_join.one_of_each(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_dropout.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram jaccard join", near), ("mixing to target weights", mix), ("sentencepiece encoding", encode)]
#: SQL can express neither Newton's iterations nor the tokenizer; tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
