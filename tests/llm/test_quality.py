import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from chronoframe.llm import quality

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("_label", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType())])


def slow(text):
    """The features of a text's passages, word by word."""
    raw = text.encode()
    words, at = [], 0
    for w in raw.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" "):
        if w:
            words.append((at, w))
        at += len(w) + 1
    out = []
    for a in range(0, len(words), quality.PASSAGE):
        own = words[a : a + quality.PASSAGE]
        span = raw[own[0][0] : own[-1][0] + len(own[-1][1])]
        n = len(own)
        row = [sum(flag[b] for b in span) / max(1, len(span)) for flag in quality._IS.values()]
        row += [np.log1p(sum(len(w) for _, w in own) / n), sum(len(w) > 14 for _, w in own) / n]
        up = lambda b: 65 <= b <= 90
        row += [sum(up(w[0]) for _, w in own) / n, sum(up(w[0]) and len(w) > 1 and up(w[1]) for _, w in own) / n]
        row += [sum(i >= k and words[i][1] == words[i - k][1] for i in range(a, a + n)) / n for k in quality.BACK]
        out.append([*row, span.count(b"\n") / n, np.log1p(n)])
    return out or [[0.0] * quality.FEATURES]


def test_features_as_slow():
    rng = np.random.default_rng(0)
    words = ["Ab", "cd", "É", "x|", "!!", "SHOUT", "longlonglongword", "7", "cd", "\n", "a\tb"]
    raw = ["", " ", "one", "a a a b a", *(" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 200, 25)), "", "日本 語\n\n| |"]
    found, bags = quality.passages(raw)
    expected = [slow(t) for t in raw]
    assert bags.tolist() == [len(x) for x in expected]
    assert np.allclose(found, np.concatenate(expected), atol=1e-5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=200), max_size=5))
def test_any_text_has_passages(raw):
    found, bags = quality.passages(raw)
    assert len(bags) == len(raw) and bags.sum() == len(found) and (bags >= 1).all() and np.isfinite(found).all()


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    bags, labels = np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0])
    features = rng.normal(size=(6, quality.FEATURES))
    model = quality.fit(features.astype(np.float32), bags, np.array([1.0, 1.0, 1.0]))
    for k in model.weights:
        model.weights[k] = rng.normal(0, 0.5, model.weights[k].shape)
    loss = lambda: float(np.mean(np.logaddexp(0, model.forward(features, bags)["logit"]) - labels * model.forward(features, bags)["logit"]))
    for k, g in quality.gradients(model, features, bags, labels).items():
        flat = model.weights[k].reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 5)):
            old = flat[i]
            flat[i] = old + 1e-5
            high = loss()
            flat[i] = old - 1e-5
            low = loss()
            flat[i] = old
            assert np.isclose(g.reshape(-1)[i], (high - low) / 2e-5, atol=1e-6)


def test_held_out_accuracy_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(400)]
    rows, marks = [], []
    for i in range(400):
        text = " ".join(rng.choice(words, int(rng.integers(5, 300)))).capitalize() + "."
        bad = i % 5 == 0
        rows.append((i, text + " " + ("Junk " * 60 if i % 2 else "###$$ %%| " * 60) if bad else text, "", ""))
        marks.append((i, int(not bad)))
    odd = [(2000, None, "", ""), (2001, "", "", ""), (None, "null id", "", ""), (5, rows[5][1], "a", "b")]
    docs = spark.createDataFrame(rows + odd, DOCS)
    labels = spark.createDataFrame([*marks, (None, 1), (7777, 0), (3, None)], LABELS)
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert {r["doc_id"] for r in got if r["held_out"]} == {i for i in [*range(400), 2000, 2001] if zlib.crc32(str(i).encode()) % 3 == 1}
    truth = dict(marks)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]) > 0.97
    kept = quality.keep_good(docs, quality.train(docs, labels))
    assert kept.schema == docs.schema and sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in got if r["predicted"])


def test_no_rows_no_labels(spark):
    none, no_marks = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert quality.classify(none, no_marks).collect() == []
    assert len(quality.classify(spark.createDataFrame([(1, "a b", "", "")], DOCS), no_marks).collect()) == 1


def test_a_long_text_in_runs_is_as_whole(monkeypatch):
    rng = np.random.default_rng(5)
    words = ["Ab", "cd", "É", "x|", "!!", "SHOUT", "longlonglongword", "7", "cd", "\n", "a\tb", "z" * 900]
    raw = [" ".join(rng.choice(words, int(n))) + end for n, end in zip(rng.integers(0, 900, 12), ["", " ", "  \n"] * 4, strict=True)] + ["y" * 5000, " " * 4000]
    whole, bags = quality.passages(raw)
    monkeypatch.setattr(quality, "AT_ONCE", 700)
    found, cut = quality.passages(raw)
    assert bags.tolist() == cut.tolist() and np.allclose(whole, found, atol=1e-5)


def test_attention_finds_the_one_passage_that_decides(monkeypatch):
    """Good documents hold only usual passages; bad ones hold one odd passage among many usual ones, which a mean hardly shows."""
    rng = np.random.default_rng(6)

    def draw(n):
        bags, labels = rng.integers(20, 60, n), rng.integers(0, 2, n)
        features = rng.normal(0, 1, (int(bags.sum()), quality.FEATURES)).astype(np.float32)
        for start, size, good in zip((np.cumsum(bags) - bags).tolist(), bags.tolist(), labels.tolist(), strict=True):
            if not good:
                features[start + rng.integers(0, size), :4] += 3.5
        return features, bags, labels.astype(np.float32)

    features, bags, labels = draw(1500)
    model = quality.fit(features, bags, labels)
    test = draw(500)
    learned = np.mean((model.scores(*test[:2]) >= 0.5) == test[2])
    plain = quality.gradients

    def without_attention(*args):
        found = plain(*args)
        found["attend"] = np.zeros_like(found["attend"])
        args[0].weights["attend"][:] = 0
        return found

    monkeypatch.setattr(quality, "gradients", without_attention)
    mean = quality.fit(features, bags, labels)
    mean.weights["attend"][:] = 0
    pooled = np.mean((mean.scores(*test[:2]) >= 0.5) == test[2])
    print(learned, pooled)
    assert learned > 0.93 and learned > pooled + 0.1
    attention = model.forward(*test[:2])["a"]
    starts = np.cumsum(test[1]) - test[1]
    bad = np.flatnonzero(test[2] == 0)
    odd = [starts[i] + test[0][starts[i] : starts[i] + test[1][i], :4].sum(axis=1).argmax() for i in bad]
    assert np.median(attention[odd] * test[1][bad]) > 5  # many times the uniform weight
