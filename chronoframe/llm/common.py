"""What the operators of this subpackage share: the shared folder, tables that cut lineage, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe import shipping

#: Bytes of a row group. Each task holds one while it writes and, of texts, nearly the whole of one while it reads.
ROW_GROUP = 8 << 20
#: Rows of one Arrow batch sent to Python. Texts are read whole, so a batch holds this many of them.
ROWS_PER_BATCH = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one of our own where it is unset and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="chronoframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Workspace:
    """Tables that one run of an operator writes to the shared folder.

    A saved table replaces its plan, so a lost executor costs a re-read and not a recomputation of
    everything before it. `drop` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        shipping.ensure(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", ROWS_PER_BATCH)

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write df and return the table as read back."""
        path = f"{self.root}/{name}"
        df.write.options(**({"compression": "zstd", "parquet.block.size": str(ROW_GROUP)} | options)).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def below(self, name: str) -> Workspace:
        """A workspace in a folder of its own inside this one."""
        inner = Workspace(self.spark, name)
        inner.root = f"{self.root}/{name}-below"
        return inner

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.root}/{name}")

    def drop_all(self) -> None:
        """For the caller, once the operator's result has been written: what it was read from goes."""
        self.drop("")


#: A key with more than one in so many of all rows is hot, so fewer keys than this can be.
MOST_HOT = 1000
#: A key with fewer rows than this is never hot: one task can bear it.
LEAST_HOT = 10_000


def hot_keys(counted: DataFrame, keys: list[str], count_col: str, most: int = MOST_HOT) -> DataFrame:
    """The keys of counted (a row per key) with more than one in `most` of all rows, fewer than `most` rows by construction."""
    total = counted.agg(F.sum(count_col)).first()[0] or 0
    return counted.where(F.col(count_col) > max(LEAST_HOT, total // most)).select(*keys)


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """The inner join of rows with table, which has a row per key, without a hot key's rows meeting in one task.

    hot: some of the keys, fewer than MOST_HOT by hot_keys. Their rows of table are broadcast and their rows of `rows` stay
    where they are; null keys join nothing. All other keys take a shuffled join.
    """
    if hot.isEmpty():
        return rows.join(table, keys)
    names = F.broadcast(hot)
    of_hot = rows.join(F.broadcast(table.join(names, keys, "left_semi")), keys)
    return of_hot.unionByName(rows.join(names, keys, "left_anti").join(table, keys))


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver to forget shuffle files that no DataFrame needs any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def give_back() -> None:
    """Return what Python and Arrow have freed to the system, after a fit on the driver."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under names of our own; other columns can have any name. A null text is the empty text."""
    shipping.ensure(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))


def texts(batch: pa.RecordBatch, column: str = "_text") -> list[str]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, whatever the session's batch size is."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
