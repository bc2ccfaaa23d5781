"""From raw documents to packed sequences: reject toxic and poor documents, drop near copies, mask secrets, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents. Classifiers are fitted on labels of the tables in sf_dir; everything
else is computed from the rows that a stage is given. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoframe.llm import packing, quality, secrets, simhash, toxicity
from chronoframe.llm.common import Workspace


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The labels, and the raw documents they belong to: a fit must not depend on what a stage before has kept."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    raw, labels = _labelled(spark, sf_dir)
    return toxicity.keep_clean(docs, toxicity.train(raw, labels))


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    raw, labels = _labelled(spark, sf_dir)
    return quality.keep_good(docs, quality.train(raw, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs, count_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality classifier", reject_poor),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("packing", pack_sequences),
]

#: Trained models and tokenizers have no SQL; the stages are held against brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = space.save(stage(spark, docs, sf_dir), f"stage-{number}")
        if number:
            space.drop(f"stage-{number - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
