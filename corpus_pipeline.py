"""Corpus pipeline: documents pass through the stages in turn, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with their
columns; the last one adds what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspan.llm import decontaminate, mixing, probminhash, quality, secret_scan
from terraspan.session import materialize, ship_package


def _only(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`") for c in columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality vote accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = quality.score_quality(docs, labels)
    return _only(scored.filter("predicted = 1"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id."""
    return probminhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a large share of benchmark passages."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _only(decontaminate.decontaminate(docs, benchmark).filter(~F.col("contaminated")), docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars counts the new text."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(masked.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes tokens, with how many and in how many epochs."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
    ("secrets", mask_secrets), ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship_package(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
