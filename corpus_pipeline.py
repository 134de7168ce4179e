"""The corpus pipeline: stages over documents, each written and read again.

Quality rules, exact dedup, near dedup and mixing keep the columns of documents; packing returns pieces.
A document that the mix takes twice comes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import dart_minhash, exact_dedup, mixing, packing, quality_rules
from strandline.session import settled


def tokenizer_path() -> str:
    """Vocabulary file of the public tokenizer the packing uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test keep. Null and empty texts fail the base rules."""
    return quality_rules.passing(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the least doc_id; null ids last, of repeated rows one."""
    return exact_dedup.without_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that with the least doc_id; null ids last."""
    return dart_minhash.without_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it does; user columns of any name pass unchanged."""
    taken = mixing.mixed(docs).where("_times > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("_doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; a null text is its end id alone."""
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select(F.col("_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixture), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
