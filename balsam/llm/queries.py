"""The registered queries of this package: each applies one operator, as in production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balsam.llm import (
    bpe, collocations, embedding_dedup, hard_negatives, line_dedup, minhash, mixing, pii, quality_rules, rule_ensemble, sharding,
    suffix_dedup, topk_search,
)
from balsam.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path() -> str:
    """Where the installed public vocabulary lies; read on the driver only."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


@_query("op2_bpe_codec")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), tokenizer_path())


@_query("op3_line_dedup", line_dedup.ORACLE_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.deduplicate_lines(documents(spark, sf_dir)))


@_query("op4_embedding_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(documents(spark, sf_dir, "embeddings"))


@_query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir), stored=True)


@_query("op6_mixing", mixing.ORACLE_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "epoch", *mixing.LEVELS, "n_tokens")


@_query("op7_rule_ensemble")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.score_quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@_query("op8_pii_surrogates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(documents(spark, sf_dir))


@_query("op9_minhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link_documents(documents(spark, sf_dir))


@_query("op10_sharding", sharding.ORACLE_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), sharding.SHARD_BYTES)


@_query("op11_hard_negatives", hard_negatives.ORACLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(
        documents(spark, sf_dir, "embeddings"), F.col("vec_id") % hard_negatives.EVERY == 0, label)


@_query("op12_collocations", collocations.ORACLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(documents(spark, sf_dir))


@_query("op13_topk_search", topk_search.ORACLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search_top_k(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % topk_search.EVERY == 0)
