"""Token-id files: documents in ascending id order, each a Simple-8b stream with its block offsets.

A table of part files holds one row per document: file number, place, doc_id, count of ids, words, offsets. Files are cut
by ranges of ids, so the files in order of their number hold all documents in order. They are Parquet, written by Spark's
commit protocol: a lost executor leaves no half file, and any store that Spark writes to will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm import simple8b
from chronoframe.llm.common import Workspace, column, free_shuffles, picked, sliced, texts
from chronoframe.llm.tokens import coder, encoded

#: Characters of a text by which rows that repeat an id are ordered.
HEAD = 64
FILE = "file int, place long, doc_id long, n_tokens long, words binary, offsets binary"


def binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of so many values each as a binary column, without a copy for each."""
    raw, step = values.tobytes(), values.dtype.itemsize
    ends = (np.cumsum(sizes) * step).tolist()
    return pa.array([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary())


def write_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append end_id, write the files under path and return them as read back.

    Rows are sorted into files by id, then the text's first HEAD characters, then its XXH64. A null id comes first, a null text
    is empty (end_id alone). Rows that repeat an id are documents of their own, and can lie in several files. Empty table:
    files without rows. There are as many files as shuffle partitions. Texts are sorted and not their words: these are no
    smaller, and as the sort samples what it sorts, they would have to be written once more before it.
    """
    spark = docs.sparkSession
    plain = picked(docs, id_col, text_col)
    plain = plain.select("_id", F.substring("_text", 1, HEAD).alias("_head"), F.xxhash64("_text").alias("_key"), F.monotonically_increasing_id().alias("_row"), "_text")
    parts, keys = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), ["_id", "_head", "_key", "_row"]
    ordered = plain.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered = ordered.select(F.spark_partition_id().alias("file"), "_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        own = coder(vocabulary)
        end = np.array([end_id], dtype=own.dtype).tobytes()
        for batch in sliced(batches):
            coded = encoded(vocabulary, texts(batch))
            n = len(coded)
            counts = np.array([len(raw) // own.width + 1 for raw in coded], dtype=np.int64)
            words, sizes, offsets, blocks = simple8b.encode_streams(own.ids(end.join([*coded, b""])), counts)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "file"), pa.array(np.arange(place, place + n)), column(batch, "_id"), pa.array(counts), binaries(words, sizes), binaries(offsets, blocks)],
                names=["file", "place", "doc_id", "n_tokens", "words", "offsets"],
            )
            place += n

    ordered.mapInArrow(run, FILE).write.option("compression", "uncompressed").parquet(path)
    free_shuffles(spark)
    return spark.read.schema(FILE).parquet(path)


def decoded(words: list[bytes], offsets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of documents and how many each has, block by block: each block is decoded from its own offset on.

    A block but a document's last has BLOCK ids; anything else means that offsets and words don't belong together.
    """
    sizes = np.array([len(w) // 8 for w in words], dtype=np.int64)
    blocks = np.array([len(o) // 4 for o in offsets], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), blocks)
    starts = np.frombuffer(b"".join(offsets), dtype="<u4").astype(np.int64) + (np.cumsum(sizes) - sizes)[owner]
    ids, counts = simple8b.decode_streams(np.frombuffer(b"".join(words), dtype="<u8"), np.diff(np.append(starts, sizes.sum())))
    last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
    if (counts[~last] != simple8b.BLOCK).any():
        raise ValueError("a block does not begin where its offset says")
    return ids, np.bincount(owner, weights=counts, minlength=len(words)).astype(np.int64)


def read_ids(files: DataFrame) -> DataFrame:
    """file, place, doc_id, n_tokens and ids_crc32 of the ids as decoded, little-endian and 32 bits wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, counts = decoded(column(batch, "words").to_pylist(), column(batch, "offsets").to_pylist())
            if counts.tolist() != column(batch, "n_tokens").to_pylist():
                raise ValueError("a document has another number of ids than its file says")
            raw, ends = memoryview(ids.astype("<u4").tobytes()), 4 * np.cumsum(counts)
            sums = [zlib.crc32(raw[a:b]) for a, b in zip((ends - 4 * counts).tolist(), ends.tolist(), strict=True)]
            kept = [column(batch, c) for c in ("file", "place", "doc_id")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["file", "place", "doc_id", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "file int, place long, doc_id long, n_tokens long, ids_crc32 long")


def with_starts(read: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before. Sums of files come first, so no task sees more than one file's rows."""
    sums = read.groupBy("file").agg(F.sum("n_tokens").alias("own"))
    before = sums.select("file", (F.sum("own").over(Window.orderBy("file")) - F.col("own")).alias("before"))  # a row per file
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place")) - F.col("n_tokens")
    return read.withColumn("inside", inside).join(before, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, all from files written to the shared folder and read back."""
    space = Workspace(docs.sparkSession, "tokenfiles")
    files = write_files(docs, f"{space.root}/files", vocabulary, end_id, id_col, text_col)
    return with_starts(space.save(read_ids(files), "read"))
