"""A bounded sample of labelled rows for fitting, taken without moving texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe import shipping


def fold(doc_id, folds: int):
    """CRC-32 of the id as decimal text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held_out: int, most_rows: int, most_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_text and _label of at most most_rows labelled documents outside the held-out fold.

    Ids are taken by hash order, from the labels alone; only these ids are broadcast, so no text is shuffled. Labels
    that are null, contradict each other or belong to no document are left out, and so are texts of more than
    most_chars characters, which bounds what the fit has to hold.
    """
    shipping.ensure(docs.sparkSession)
    label = F.col(f"`{label_col}`").cast("int")
    known = labels.where(label.isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(label).alias("_label"), F.max(label).alias("_other")).where("_label = _other")
    chosen = known.select("_id", "_label").orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(most_rows)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text.alias("_text")).where(F.length("_text") <= most_chars).join(F.broadcast(chosen), "_id").select("_text", "_label")
