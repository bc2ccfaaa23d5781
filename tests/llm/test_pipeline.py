import numpy as np
import pytest

import corpus_pipeline
from chronoframe.llm import packing, secrets, simhash

LONE = "zX9kQ2mP7vL4tR8nB3cD6fG1hJ5"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rng = np.random.default_rng(0)
    words = [f"word{i}" for i in range(500)] + ["the", "of"] * 20
    docs, labels = [], []
    for i in range(600):
        text = " ".join(rng.choice(words, int(rng.integers(30, 200)))).capitalize() + "."
        toxic, poor = i % 9 == 0, i % 7 == 0
        text = text.replace(" ", " vileword ", 3) if toxic else text
        text = text + " " + "### $$$ %%% ||| " * 60 if poor else text
        docs.append((i, f"{text} token = {LONE}" if i == 1 else text, "en", f"s{i % 9}", len(text)))
        labels.append((i, int(not poor), int(toxic)))
    clean = [d for d in docs if d[0] % 9 and d[0] % 7][3]
    docs += [(1000 + i, clean[1] if i % 2 else clean[1].upper(), "en", "copy", 1) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return f"{folder}"


def test_each_stage_takes_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = {r["doc_id"]: r for r in docs.collect()}
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], tables).cache())
        assert sorted(steps[-1].columns) == sorted(docs.columns)
    ids = [{r["doc_id"] for r in s.collect()} for s in steps]
    small = [i for i in kept if i < 600]
    assert np.mean([(i in ids[1]) == bool(i % 9) for i in small]) > 0.98
    assert np.mean([(i in ids[2]) == bool(i % 7) for i in small if i in ids[1]]) > 0.98
    groups = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(steps[2]).collect()}
    assert ids[3] == set(groups.values()) and not any(i >= 1000 for i in ids[3])
    after = {r["doc_id"]: r for r in steps[4].collect()}
    assert set(after) == ids[3] and after[1]["text"].endswith(" [SECRET]") and after[1]["n_chars"] == len(after[1]["text"])
    assert all(after[i]["text"] == kept[i]["text"] for i in after if i != 1)
    assert not secrets.find_secrets(steps[4]).where("exists(spans, s -> s.live)").count()
    packed = corpus_pipeline.run(spark, tables)
    assert {r["doc_id"] for r in packed.collect()} == ids[4]
    assert packed.columns == packing.pack(steps[4], __import__("public_tokenizers").path("word_bpe_49k.json"), 2).columns


def test_saved_tables_have_small_row_groups(spark):
    """A task that reads or writes texts holds a row group of them; eight of 128 MB did not fit a heap of 1 GB."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from chronoframe.llm import common

    rows = spark.range(0, 400_000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    files = common.Workspace(spark, "row-groups").save(rows, "rows").inputFiles()
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == str(common.ROWS_PER_BATCH)
    sizes = [m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)]
    assert sum(m.num_rows for m in groups) == 400_000 and max(sizes) <= 2 * common.ROW_GROUP
