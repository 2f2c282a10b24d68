"""A corpus pipeline: quality rules, exact dedup, near dedup, mixing and tokenisation, each stage over all rows of the one before.

Every stage but the last returns the columns of documents, whatever they are; extra columns, of names that the operators use
too, pass through. An empty table gives an empty one. A text of any length is one row; only the last stage cuts it up.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import encode_documents
from graphloom.llm.exact_dedup import drop_exact_copies
from graphloom.llm.mixing import mixed_documents
from graphloom.llm.near_dedup import drop_near_copies
from graphloom.llm.quality_rules import apply_quality_rules
from graphloom.runtime import scratch_path

#: The tokenizer's rank file; a parameter of the last stage.
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that too many documents of their source share.

    Null and empty texts go; a null source is a source. Repeated rows count as one document where lines are counted and
    are kept or go together. n_chars follows the text.
    """
    return apply_quality_rules(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space aside: that of the smallest id.

    Null and empty texts are one group. Rows repeated with one id and text leave one row; a group of null ids only leaves one.
    """
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similarity of five-word shingles: that of the smallest id.

    Texts without words, null or empty, are linked with nothing and stay. Repeated rows leave one row.
    """
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none to two times, in mixing order.

    Texts without words, null or empty, go; a null source is a source of its own, last in order. Rows of one id and text
    are taken equally often.
    """
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number and digests of each document of the mix, with its doc_id.

    Null texts count as empty and have no tokens; repeated rows are encoded each.
    """
    out = encode_documents(docs, VOCABULARY, public_tokenizers.PATTERN, want_ids=True)
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("tokens", tokens)]

#: Hashed sketches and the tokenizer's merges have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
