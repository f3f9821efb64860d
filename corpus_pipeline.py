"""A training-data pipeline over ``documents``: five stages, each on all that its predecessor kept.

Every stage is written as Parquet and read again, so a lost executor costs a stage's task, not the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborwatch.llm import near, packing, queries, secret_scan, substring, toxicity
from harborwatch.session import staged


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the text now is."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model learns from labels that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~F.coalesce(toxicity.held_out(), F.lit(False)))
    return toxicity.reject_toxic(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 over five-word shingles stays."""
    return near.deduplicate(docs, percent=80, size=5)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that occur elsewhere go."""
    return _counted(substring.remove_repeats(docs, window=35))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported spans become their kind in brackets; no document goes."""
    return _counted(secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, queries.vocabulary("byte_bpe_50k.json"), max_tokens=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The stages fit a classifier, index texts and pack tokens, which SQL can't say; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
