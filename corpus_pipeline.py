"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding; each stage on all the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from balsam.llm import stages
from balsam.llm.common import discard, documents, settle

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup),
    ("minhash_near_dedup", stages.near_dedup),
    ("mixing", stages.mixing),
    ("bpe_encoding", stages.encoding),
]

#: Perplexity, sketches and token ids have no SQL form; tests/llm compares the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written and read again, and go once the next has them."""
    docs, before = documents(spark, sf_dir), []
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
        discard(*before)
        before = [docs]
    return docs
