"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm import bpe, hamming, licences, media, packing, quality, secrets, simhash, sql, tokenfiles, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no paths, so each row gets one by rule: its source is a repository, its id names folders of 1,000 and 100 ids.

    Every tenth id is the licence file of its folder of 100, every hundredth that of its folder of 1,000, every thousandth
    that of its repository.
    """
    docs = _documents(spark, sf_dir)
    i, source = F.col("doc_id"), F.coalesce("source", F.lit("unknown"))
    thousand, hundred = F.concat_ws("/", source, F.floor(i / 1000)), F.concat_ws("/", source, F.floor(i / 1000), F.floor(i / 100) % 10)
    place = F.when(i % 1000 == 0, F.concat(source, F.lit("/LICENSE"))).when(i % 100 == 0, F.concat(thousand, F.lit("/LICENSE"))).when(i % 10 == 0, F.concat(hundred, F.lit("/LICENSE")))
    return licences.scan(docs.withColumn("path", F.coalesce(place, F.concat_ws("/", hundred, i))))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(_documents(spark, sf_dir))


def op4_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes are the signs of each vector; queries are the rows whose id is divisible by 100."""
    return hamming.search_every(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), end_id=2)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"), end_id=2)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(_documents(spark, sf_dir)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir), _labels(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_simhash_near_dedup, op2_license_scans, op3_media_columns, op4_bpe_chunk_reuse, op5_exact_top_k, op6_token_id_files, op7_packing, op8_secret_scans, op9_toxicity, op10_quality]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op8_secret_scans": sql.secret_scans()}
