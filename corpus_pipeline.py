"""The corpus pipeline: quality rules, quality classifier, near-dedup, passage dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of documents, but
for the last, which returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.llm import decision_list, near_text, pairwise_quality, pattern_pack, suffix_dedup
from scriptmill.llm.common import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep. A null doc_id is judged like any other."""
    return decision_list.keep(docs, _table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at the cut or above, null ids and texts too. Most that are labelled bad are gone by now, so it learns from the whole table."""
    ranking = pairwise_quality.learn(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return pairwise_quality.keep(docs, ranking)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of five-word similarity 0.8 or more: that of the least doc_id; null ids come last."""
    return near_text.distinct(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; n_chars follows the text. A null doc_id counts as the least."""
    out = suffix_dedup.removed(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed; a null text is the end id alone, and a null doc_id is kept as it is."""
    return pattern_pack.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("packing", packing),
]

#: The learned stages have no SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
