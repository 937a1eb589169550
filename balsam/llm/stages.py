"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balsam.llm import bpe, minhash, mixing as mix, quality_rules as rules
from balsam.llm import line_dedup as lines
from balsam.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band.

    A null or empty text goes; null ids, repeated rows and null languages are judged as any others."""
    return rules.apply_rules(docs, COLUMNS, stored=True).where("kept").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; n_chars follows the text."""
    kept = lines.deduplicate_lines(docs)
    return kept.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies; rows without an id stay."""
    gone = minhash.link_documents(docs).where("not kept").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti").select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per pass that the mix takes of a document."""
    return mix.mix_sources(docs).select(COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, counts and digests per document."""
    return bpe.encode_documents(docs, tokenizer_path(), keep_ids=True)
