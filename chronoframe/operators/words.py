"""Timed words into blocks: the grouping depends on how long the group already is, so words run as a stream per transcript."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions import text as tx

MOST, LEAST, PAUSE, TAIL, CHUNK = 7, 3, 0.35, 0.15, 5


def split_words(segments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Words of segments that have text only, their time shared out evenly: keys, order, pos, word, start, end (three places)."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    split = segments.select(*keys, *order, "start", "end", words.alias("_w"))
    counted = split.select(*keys, *order, "start", "end", F.size("_w").alias("n"), "_w")  # below the explode, so once a text and not once a word
    rows = counted.select(*keys, *order, "start", "end", "n", F.posexplode("_w").alias("pos", "word"))
    each = F.greatest(F.lit(0.2), F.col("end") - F.col("start")) / F.greatest(F.lit(1), F.col("n"))
    places = lambda x: F.floor(x * 1000.0 + 0.5) / 1000.0
    return rows.select(*keys, *order, "pos", "word", places(F.col("start") + F.col("pos") * each).alias("start"), places(F.col("start") + (F.col("pos") + 1) * each).alias("end"))


def blocks(words: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """words (keys, order, word, start, end) with their block's number: a block closes at seven words, or at three and more where a pause or a full stop follows.

    Rows are sorted once; a key's state is the length of its open block.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    pause = F.coalesce(F.lead("start").over(w) - F.col("end") > PAUSE, F.lit(False))
    rows = words.withColumn("_break", pause | F.col("word").rlike("[.!?]$"))
    schema = rows.drop("_break").schema.add("block", "long")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, held = None, 0, 0
        for batch in batches:
            key = list(zip(*(batch.column(names.index(k)).to_pylist() for k in keys), strict=True))
            out = np.zeros(batch.num_rows, dtype=np.int64)
            for i, (k, broken) in enumerate(zip(key, batch.column(names.index("_break")).to_pylist(), strict=True)):
                if k != now:
                    now, block, held = k, 0, 0
                out[i] = block
                held += 1
                if held >= MOST or (held >= LEAST and broken):
                    block, held = block + 1, 0
            kept = [batch.column(names.index(n)) for n in names if n != "_break"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out)], names=[*(n for n in names if n != "_break"), "block"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def block_rows(grouped: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A row per block: its words in order, start, end (a little after the last word), layout."""
    words = F.array_sort(F.collect_list(F.struct(*order, "word", "start", "end")))
    made = grouped.groupBy(*keys, "block").agg(words.alias("w"))
    two = lambda x: F.floor(x * 100.0 + 0.5) / 100.0
    return made.select(*keys, "block", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"), F.size("w").alias("words"), two(F.col("w")[0]["start"]).alias("start"), two(F.element_at("w", -1)["end"] + TAIL).alias("end"), (F.col("block") % 4).alias("layout"))


def fallback_blocks(texts: DataFrame, keys: list[str], text: str, duration: Column) -> DataFrame:
    """Five words a block, all blocks of the same length; a text without words has one block of the stock phrase's first five."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    words = F.when(F.size(words) > 0, words).otherwise(F.split(F.lit("FREESTYLE VOCALS DEMO TRACK"), " "))
    rows = texts.select(*keys, words.alias("_w"), duration.alias("_d")).withColumn("_n", F.ceil(F.size("_w") / CHUNK))
    made = rows.select(*keys, "_w", "_d", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("block"))
    two = lambda x: F.floor(x * 100.0 + 0.5) / 100.0
    each = F.col("_d") / F.col("_n")
    own = F.slice("_w", (F.col("block") * CHUNK + 1).cast("int"), CHUNK)
    return made.select(*keys, "block", F.array_join(own, " ").alias("text"), two(F.col("block") * each).alias("start"), two((F.col("block") + 1) * each).alias("end"), (F.col("block") % 4).alias("layout"))


#: Layouts as rows (type, first word, first word on the right, end; None: to the last), by the greatest number of words and the variant.
LAYOUTS = {
    (3, 0): [("hero", 0, None, 2), ("sub", 2, None, None)],
    (5, 0): [("hero", 0, None, 2), ("sub", 2, None, 4), ("punch", 4, None, None)],
    (5, 1): [("sub", 0, None, 2), ("hero", 2, None, 4), ("punch", 4, None, None)],
    (7, 0): [("hero", 0, None, 2), ("sub", 2, None, 4), ("split", 4, 6, None)],
    (7, 1): [("sub", 0, None, 3), ("hero", 3, None, 5), ("split", 5, 6, None)],
    (7, 2): [("splitHeroRight", 0, 2, 3), ("sub", 3, None, 5), ("hero", 5, None, None)],
    (99, 0): [("hero", 0, None, 2), ("sub", 2, None, 5), ("split", 5, 7, 8), ("punch", 8, None, None)],
    (99, 1): [("sub", 0, None, 3), ("hero", 3, None, 5), ("split", 5, 7, None)],
    (99, 2): [("hero", 0, None, 2), ("sub", 2, None, 4), ("split", 4, 6, 8), ("hero", 8, None, None)],
}
#: Type sizes of single rows, and of the left and right part of a split row.
SIZES = {"hero": (120, 0), "punch": (65, 0), "sub": (55, 0), "split": (42, 95), "splitHeroRight": (48, 110)}
WIDEST, ROW_GAP, SPLIT_GAP, ROOM = 860, 14, 25, 30


def puzzle(blocks_: DataFrame, keys: list[str], words: str, variant: str) -> DataFrame:
    """The rows of each block's layout with text, size, width, x and y; a split row has a left and a right element.

    The layout is a broadcast of a few fixed rows; widths are estimated by characters. Rows without words are left out.
    """
    spark = blocks_.sparkSession
    most = lambda k: {3: 1, 5: 2}.get(k, 3)
    rows = [(k, v, i, t, a, m if m is not None else -1, b if b is not None else 1 << 20) for (k, v), own in LAYOUTS.items() for i, (t, a, m, b) in enumerate(own)]
    table = spark.createDataFrame(rows, "_kind int, _variant int, row int, type string, _a int, _m int, _b int")
    n = F.size(words)
    kind = F.when(n <= 3, 3).when(n <= 5, 5).when(n <= 7, 7).otherwise(99)
    mod = F.when(n <= 3, F.lit(most(3))).when(n <= 5, F.lit(most(5))).otherwise(F.lit(most(7)))
    own = blocks_.where(n > 0).select(*keys, F.transform(words, lambda w: F.upper(w)).alias("_w"), kind.alias("_kind"), (F.col(variant) % mod).cast("int").alias("_variant"))
    met = own.join(F.broadcast(table), ["_kind", "_variant"])
    part = lambda a, b: F.array_join(F.slice("_w", a + 1, F.greatest(F.least(b, F.size("_w")) - a, F.lit(0))), " ")
    split = F.col("_m") >= 0
    met = met.withColumn("left", part(F.col("_a"), F.when(split, F.col("_m")).otherwise(F.col("_b")))).withColumn("right", F.when(split, part(F.col("_m"), F.col("_b"))).otherwise("")).where("left <> ''")
    size = lambda i: F.coalesce(*(F.when(F.col("type") == t, F.lit(float(s[i]))) for t, s in SIZES.items()))
    width = lambda text, s, hero: F.floor(F.length(text) * s * F.when(hero, 0.58).otherwise(0.60) + 0.5)
    hero = F.col("type") == "hero"
    rows_ = met.withColumn("s1", size(0)).withColumn("s2", size(1)).withColumn("w1", width(F.col("left"), F.col("s1"), hero)).withColumn("w2", F.when(F.col("right") != "", width(F.col("right"), F.col("s2"), F.lit(True))).otherwise(0.0))
    total = F.when(split, F.col("w1") + F.col("w2") + ROOM).otherwise(F.col("w1"))
    fit = F.when(total > WIDEST, WIDEST / total)
    rows_ = rows_.withColumn("_fit", fit)
    for s in ("s1", "s2"):
        rows_ = rows_.withColumn(s, F.when(F.col("_fit").isNotNull(), F.floor(F.col(s) * F.col("_fit")).cast("double")).otherwise(F.col(s)))
    rows_ = rows_.withColumn("w1", width(F.col("left"), F.col("s1"), hero).cast("double")).withColumn("w2", F.when(F.col("right") != "", width(F.col("right"), F.col("s2"), F.lit(True)).cast("double")).otherwise(0.0))
    rows_ = rows_.withColumn("h", F.greatest("s1", F.when(split, F.col("s2")).otherwise(0.0)) * 1.05)
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum(F.floor(F.col("h") + ROW_GAP)).over(w.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    top = F.floor((1080 - (F.sum("h").over(w) + ROW_GAP * (F.count("*").over(w) - 1))) / 2)
    pair = F.col("w1") + SPLIT_GAP + F.col("w2")
    x1 = F.when(F.col("right") != "", F.greatest(F.lit(80.0), F.floor((1080 - pair) / 2))).otherwise(F.greatest(F.lit(80.0), F.least(980 - F.col("w1"), F.floor((1080 - F.col("w1")) / 2))))
    placed = rows_.withColumn("y", top + before).withColumn("x1", x1).withColumn("x2", F.when(F.col("right") != "", x1 + F.col("w1") + SPLIT_GAP))
    return placed.select(*keys, "row", "type", "left", "right", "s1", "s2", "w1", "w2", "x1", "x2", "y", "h")


def revealed(words: Column, t: Column) -> Column:
    """The words (word, start) that have begun at t, joined."""
    return F.array_join(F.transform(F.filter(words, lambda w: w["start"] <= t), lambda w: w["word"]), " ")


def revealed_evenly(words: Column, t: Column, start: Column, end: Column) -> Column:
    """Of words without times as many as the share of the time gone by, rounded up."""
    each = F.greatest(F.lit(0.04), (end - start) / F.greatest(F.lit(1), F.size(words)))
    count = F.least(F.size(words), F.floor((t - start) / each).cast("int") + 1)
    return F.when(t < start, "").when(t >= end, F.array_join(words, " ")).otherwise(F.array_join(F.slice(words, 1, count), " "))


def verse(words: Column) -> tuple[Column, Column]:
    """Two lines, split in the middle."""
    middle = F.greatest(F.lit(1), F.floor(F.size(words) / 2).cast("int"))
    return F.array_join(F.slice(words, 1, middle), " "), F.array_join(F.slice(words, middle + 1, F.greatest(F.size(words), F.lit(1))), " ")


def transcripts(lines: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """keys, transcript and error of each process by its output lines: the last transcript it printed, else the last error.

    A process with neither has null in both.
    """
    result = tx.progress(F.col(line))["result"]
    read = lines.select(*keys, F.col(order).alias("_at"), tx.transcript(result).alias("_t"), F.get_json_object(result, "$.error").alias("_e"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at")))
    made = read.groupBy(*keys).agg(last("_t").alias("transcript"), last("_e").alias("_e"))
    return made.select(*keys, "transcript", F.when(F.col("transcript").isNull(), F.col("_e")).alias("error"))
