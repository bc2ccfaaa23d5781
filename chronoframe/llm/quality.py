"""Quality by attention-based multiple-instance learning in numpy.

A document is a bag of passages of PASSAGE words. Every passage is described by numbers about its characters and the
repetition of its words, encoded by a small layer, and weighted by gated attention; the weighted mean of the encodings is
scored. Labels exist for documents only, so the attention learns which passages decide.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import column, give_back, picked, sliced, texts
from chronoframe.llm.labelled import fold, sample

PASSAGE = 40
#: A passage's words are compared with the words this far before, across passages of one text.
BACK = (1, 2, 3, 5, 8)
HIDDEN, GATE = 16, 8
EPOCHS, STEPS, BATCH, RATE, DECAY = 12, 600, 64, 0.01, 1e-4
#: Labelled rows that the fit takes at most, and characters of one of their texts.
FIT_ROWS, FIT_CHARS = 8000, 25_000
#: Bytes of text described at once, some 30 bytes of memory each. A longer text is described in runs of passages.
AT_ONCE = 2 << 20

_BYTE = np.arange(256)
_IS = {  # classes of UTF-8 bytes; bytes of other characters are letters
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "lower": (_BYTE >= 97) & (_BYTE <= 122),
    "digit": (_BYTE >= 48) & (_BYTE <= 57),
    "stop": np.isin(_BYTE, list(b".,;:?!'\"()-")),
    "odd": np.isin(_BYTE, list(b"#$%&*+/<=>@[\\]^_`{|}~")),
    "shout": _BYTE == 33,
    "bar": _BYTE == 124,
    "wide": _BYTE >= 128,
}
_SPACE = np.isin(_BYTE, [9, 10, 11, 12, 13, 32])
_LINE = _BYTE == 10
_MIX = np.array([zlib.crc32(bytes([i, 0x33])) for i in range(256)], dtype=np.uint32)
FEATURES = len(_IS) + 4 + len(BACK) + 2


def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(flags, starts, dtype=np.int64)


def _describe(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each ending at ends[i] with a space of its own."""
    space = _SPACE[data]
    before = np.append(True, space[:-1])
    starts = np.flatnonzero(~space & before)
    words = len(starts)
    owner = np.searchsorted(ends, starts, side="right")
    count = np.bincount(owner, minlength=len(ends))
    bags = -(-count // PASSAGE)
    if not words:
        return np.zeros((0, FEATURES), dtype=np.float32), bags
    stops = np.flatnonzero(space & ~before)
    size = stops - starts
    first_of = np.cumsum(count) - count
    place = np.arange(words) - first_of[owner]
    heads = np.flatnonzero(place % PASSAGE == 0)  # the first word of each passage
    many = np.diff(np.append(heads, words))
    spans = np.stack([starts[heads], stops[np.append(heads[1:], words) - 1]], axis=1).ravel()
    over = np.append(data, 32)  # so that the last end is a place, too
    chars = np.maximum(1, spans[1::2] - spans[::2])
    columns = [np.add.reduceat(flag[over].astype(np.uint8), spans, dtype=np.int64)[::2] / chars for flag in _IS.values()]
    kind = np.stack([_IS["upper"][data[starts]], (_IS["upper"][data[starts]] & _IS["upper"][over[starts + 1]])])
    lengths = np.add.reduceat(size, heads) / many
    columns += [np.log1p(lengths), np.add.reduceat((size > 14).astype(np.int64), heads) / many, *(np.add.reduceat(k.astype(np.int64), heads) / many for k in kind)]
    steps = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.append(np.append(0, starts), len(data))))
    mixed = np.where(space, np.uint32(0), _MIX[data] * (2 * steps.astype(np.uint32) + np.uint32(1)))
    names = np.add.reduceat(mixed, starts, dtype=np.uint32)
    for back in BACK:
        same = np.zeros(words, dtype=np.int64)
        same[back:] = (names[back:] == names[:-back]) & (size[back:] == size[:-back]) & (place[back:] >= back)
        columns.append(np.add.reduceat(same, heads) / many)
    columns += [np.add.reduceat(_LINE[over].astype(np.uint8), spans, dtype=np.int64)[::2] / many, np.log1p(many)]
    return np.stack(columns, axis=1).astype(np.float32), bags


def _describe_long(data: np.ndarray) -> np.ndarray:
    """The passages of one text, a run at a time. A run begins one passage back, so its first words have those before them to be compared with.

    A passage longer than a run makes the run longer.
    """
    found, at, lead, size = [], 0, 0, AT_ONCE
    while at < len(data):
        part = data[at : at + size]
        done = at + size >= len(data)
        space = _SPACE[part]
        starts = np.flatnonzero(~space & np.append(True, space[:-1]))
        whole = len(starts) if done else (len(starts) - 1) // PASSAGE * PASSAGE  # the last word can go on
        if not done and whole <= lead * PASSAGE:
            size *= 2
            continue
        end = len(part) if done else int(starts[whole])
        features, _ = _describe(np.append(part[:end], np.uint8(32)), np.array([end + 1]))
        found.append(features[lead:])
        if done:
            break
        at, lead, size = at + int(starts[whole - PASSAGE]), 1, AT_ONCE
    return np.concatenate([np.zeros((0, FEATURES), dtype=np.float32), *found])


def passages(raw: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages of the texts, and how many each text has: one of zeros for a text without words."""
    found, counts, held, size = [], [], [], 0
    for t in [*raw, None]:
        if held and (t is None or size + len(t) > AT_ONCE):
            joined = [x.encode("utf-8", "surrogatepass") + b" " for x in held]
            f, n = _describe(np.frombuffer(b"".join(joined), dtype=np.uint8), np.cumsum([len(x) for x in joined]))
            found.append(np.insert(f, np.cumsum(n)[n == 0], 0, axis=0))
            counts.append(np.maximum(n, 1))
            held, size = [], 0
        if t is not None and len(t) > AT_ONCE:
            f = _describe_long(np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8))
            found.append(f if len(f) else np.zeros((1, FEATURES), dtype=np.float32))
            counts.append(np.array([max(1, len(f))]))
        elif t is not None:
            held.append(t)
            size += len(t)
    return np.concatenate([np.zeros((0, FEATURES), dtype=np.float32), *found]), np.concatenate([np.zeros(0, dtype=np.int64), *counts])


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, features: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        """bags: passages of each document, at least one."""
        w = self.weights
        starts = np.cumsum(bags) - bags
        x = np.clip((features - self.mean) / self.spread, -8, 8)
        e = np.tanh(x @ w["encode"] + w["encode_0"])
        t, g = np.tanh(e @ w["tanh"]), 1 / (1 + np.exp(-(e @ w["gate"])))
        raw = (t * g) @ w["attend"]
        top = np.maximum.reduceat(raw, starts)
        a = np.exp(raw - np.repeat(top, bags))
        a /= np.repeat(np.add.reduceat(a, starts), bags)
        z = np.add.reduceat(a[:, None] * e, starts, axis=0)
        return {"x": x, "e": e, "t": t, "g": g, "a": a, "z": z, "logit": z @ w["out"] + w["out_0"][0]}

    def scores(self, features: np.ndarray, bags: np.ndarray) -> np.ndarray:
        if not len(bags):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.forward(features, bags)["logit"].astype(np.float64), -30, 30)))


def gradients(model: Model, features: np.ndarray, bags: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    w, f = model.weights, model.forward(features, bags)
    error = (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - labels) / len(labels)
    dz = np.repeat(error[:, None] * w["out"], bags, axis=0)
    da = (dz * f["e"]).sum(axis=1)
    inner = f["a"] * da
    draw = inner - f["a"] * np.repeat(np.add.reduceat(inner, np.cumsum(bags) - bags), bags)
    dt, dg = draw[:, None] * w["attend"] * f["g"], draw[:, None] * w["attend"] * f["t"]
    dt, dg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
    de = f["a"][:, None] * dz + dt @ w["tanh"].T + dg @ w["gate"].T
    dh = de * (1 - f["e"] ** 2)
    return {
        "encode": f["x"].T @ dh, "encode_0": dh.sum(axis=0), "tanh": f["e"].T @ dt, "gate": f["e"].T @ dg,
        "attend": (f["t"] * f["g"]).T @ draw, "out": f["z"].T @ error, "out_0": np.array([error.sum()]),
    }


def fit(features: np.ndarray, bags: np.ndarray, labels: np.ndarray, seed: int = 3) -> Model:
    """Train on bags of passages with a label each. No rows or one class only: a model of that class's share."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    share = float(np.log((labels.sum() + 1) / ((1 - labels).sum() + 1)))
    weights = {"encode": draw(FEATURES, HIDDEN), "encode_0": np.zeros(HIDDEN, dtype=np.float32), "tanh": draw(HIDDEN, GATE), "gate": draw(HIDDEN, GATE), "attend": draw(GATE), "out": draw(HIDDEN), "out_0": np.array([share], dtype=np.float32)}
    seen = len(features) > 0
    model = Model(features.mean(axis=0) if seen else np.zeros(FEATURES, dtype=np.float32), features.std(axis=0) + 1e-3 if seen else np.ones(FEATURES, dtype=np.float32), weights)
    if labels.sum() in (0, len(labels)):
        weights["out"][:] = 0
        return model
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    starts, order, step = np.cumsum(bags) - bags, np.arange(len(bags)), 0
    for _ in range(max(EPOCHS, -(-STEPS // -(-len(bags) // BATCH)))):
        rng.shuffle(order)
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            rows = np.concatenate([np.arange(starts[i], starts[i] + bags[i]) for i in part])
            step += 1
            for k, g in gradients(model, features[rows], bags[part], labels[part]).items():
                m, v = moment[k]
                g = g + DECAY * weights[k] * (not k.endswith("_0"))
                m += 0.1 * (g - m)
                v += 0.001 * (g**2 - v)
                weights[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """A model from at most fit_rows labelled rows outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found, bags = passages(texts(batch))
            cuts = np.cumsum(bags)
            rows = [found[a:b].tobytes() for a, b in zip((cuts - bags).tolist(), cuts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), column(batch, "_label")], names=["bag", "label"])

    found = sample(docs, labels, "quality", 3, 1, fit_rows, FIT_CHARS, id_col, text_col).mapInArrow(run, "bag binary, label int").toArrow()
    rows = sorted(zip(found["bag"].to_pylist(), found["label"].to_pylist(), strict=True))  # the same fit whatever the partitions
    del found
    features = np.frombuffer(b"".join(r for r, _ in rows), dtype=np.float32).reshape(-1, FEATURES)
    model = fit(features, np.array([len(r) // (4 * FEATURES) for r, _ in rows], dtype=np.int64), np.array([y for _, y in rows], dtype=np.float32))
    del rows, features
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs, from its whole text alone.

    A null or empty text, or one of white space, is one passage of zeros. A null id stays null and is in no fold. Rows
    that repeat an id are scored each. Empty table: empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([column(batch, "_id"), pa.array(shared.value.scores(*passages(texts(batch))))], names=["doc_id", "score"])

    found = picked(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score(docs, train(docs, labels, id_col, text_col), id_col, text_col)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows predicted to be of low quality; decided in the scan, row by row, with all columns as they are.

    A null text counts as empty and its row stays null; rows that repeat an id or a text are decided each, alike. Ids are
    not read. Empty table: empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = shared.value.scores(*passages([t or "" for t in texts(batch, text_col)]))
            yield batch.filter(pa.array(found >= 0.5))

    return docs.mapInArrow(run, docs.schema)
