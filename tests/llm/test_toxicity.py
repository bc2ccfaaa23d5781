import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from chronoframe.llm import toxicity

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("label", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType())])


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(0)
    words = np.array([f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 40)
    bad = ["vileword", "nastyone", "grimterm", "foulthing"]
    rows, labels = [], []
    for i in range(900):
        text = rng.choice(words, int(rng.integers(5, 200))).tolist()
        toxic = int(i % 6 == 0)
        if toxic:
            for at in rng.integers(0, len(text), 3):
                text[at] = bad[rng.integers(0, 4)]
        rows.append((i, " ".join(text), "", ""))
        labels.append((i, toxic))
    return rows, labels


def ids_of(texts):
    raw = [toxicity.word_ids(t) for t in texts]
    return np.frombuffer(b"".join(raw), dtype="<u2").reshape(-1, 2), np.array([len(r) // 4 for r in raw])


def slow_maxima(model, text):
    x = model.embed(ids_of([text])[0]).astype(float)
    out = []
    for k, kernel in enumerate(model.kernels):
        for f in range(toxicity.FILTERS):
            values = [sum(x[t + j] @ kernel[j, :, f].astype(float) for j in range(len(kernel))) + model.bias[k * toxicity.FILTERS + f] for t in range(len(x) - len(kernel) + 1)]
            out.append(max([0.0, *values]))
    return out


def test_maxima_as_slow_and_over_cuts(corpus, monkeypatch):
    rows, labels = corpus
    model = toxicity.fit([toxicity.word_ids(r[1]) for r in rows[:200]], np.array([y for _, y in labels[:200]]))
    texts = ["", "one", "two words", "", *(r[1] for r in rows[:6]), ""]
    slow = np.array([slow_maxima(model, t) for t in texts])
    assert np.allclose(model.maxima(*ids_of(texts)), slow, atol=1e-4)
    assert np.allclose(model.pooled(*ids_of(texts))[0], slow, atol=1e-4)
    monkeypatch.setattr(toxicity, "AT_ONCE", 7)
    assert np.allclose(model.maxima(*ids_of(texts)), slow, atol=1e-4)


def test_held_out_accuracy_and_odd_rows(spark, corpus):
    rows, labels = corpus
    odd = [(2000, None, "", ""), (2001, "", "", ""), (None, "w1 vileword", "", ""), (5, rows[5][1], "a", "b")]
    docs = spark.createDataFrame(rows + odd, DOCS)
    marks = spark.createDataFrame([*labels, (None, 1), (7777, 1), (3, None)], LABELS)
    got = toxicity.classify(docs, marks).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in [*range(900), 2000, 2001] if zlib.crc32(str(i).encode()) % 5 == 0}
    known = [r for r in held if r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in known]) > 0.97
    kept = toxicity.keep_clean(docs, toxicity.train(docs, marks))
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in got if not r["predicted"])


def test_no_rows_no_labels_one_class(spark):
    none, no_marks = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert toxicity.classify(none, no_marks).collect() == []
    docs = spark.createDataFrame([(1, "a b", "", "")], DOCS)
    assert len(toxicity.classify(docs, no_marks).collect()) == 1
    assert len(toxicity.classify(docs, spark.createDataFrame([(1, 0)], LABELS)).collect()) == 1
