"""The named queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborwatch.llm import bpe, editsketch, extraction, lm, near, negatives, packing, secret_scan, sql, substring, toxicity, vectors, whitening, wordpiece

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {"op8_substrings": sql.SUBSTRINGS, "op9_near": sql.NEAR, "op10_vectors": sql.VECTORS, "op12_negatives": sql.NEGATIVES}


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), max_tokens=1024, end_id=2)


@query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editsketch.fingerprint_edited(documents(spark, sf_dir))


@query("op4_lm")
def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_held_out(documents(spark, sf_dir))


@query("op5_secrets")
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op8_substrings")
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digests(documents(spark, sf_dir), window=35)


@query("op9_near")
def op9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(documents(spark, sf_dir), percent=85, size=5)


@query("op10_vectors")
def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.98)


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=8)
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))  # null where it fits no long


@query("op12_negatives")
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table.withColumn("label", moved), anchors=F.col("i") % 100 == 0)


@query("op13_extraction")
def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
