"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.llm import causal_lm, decision_list, fill_middle, licences, mih, pairwise_quality, pattern_pack, personal_data, piece_codec, simhash, suffix_dedup, threshold_search, token_rollup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op2_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.history(_table(spark, sf_dir, "documents")).totals()


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op8_causal_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return causal_lm.score(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_pattern_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_pack.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(_table(spark, sf_dir, "documents"))


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mih, op2_pairwise_quality, op3_decision_list, op4_simhash, op5_suffix_dedup, op6_token_rollup, op7_licences, op8_causal_lm, op9_piece_codec, op10_pattern_pack, op11_personal_data, op12_threshold_search, op13_fill_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op6_token_rollup": token_rollup.SQL, "op7_licences": licences.sql(), "op12_threshold_search": threshold_search.sql()}
