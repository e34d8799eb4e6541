"""From documents to packed training sequences: five stages, each over all that its predecessor kept."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veiltab.llm import grace, jaccard, mixing, packing, quality
from veiltab.llm.common import written

QUALITY_THRESHOLD = 0.3
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
KEPT_BYTES = 12 << 20  # a worker that has run the earlier stages has less room left


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier scores below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = quality.fit(docs, labels).score(docs, name="_veiltab_score")
    return scored.where(F.col("_veiltab_score") >= QUALITY_THRESHOLD).drop("_veiltab_score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of equal texts."""
    return grace.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw each source to its target; a document drawn twice comes as two rows."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place all pieces of all drawn documents in sequences."""
    return packing.place(packing.cut(docs, public_tokenizers.path(TOKENIZER), END_ID, kept_bytes=KEPT_BYTES))


STAGES = [("quality", reject_bad), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mix", mix_sources), ("pack", pack_sequences)]
#: Trained dictionaries, tokens and pruned joins have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
