"""Toxicity by a convolutional text classifier in numpy.

A word is two hashed embeddings, of the word and of its first letters. Filters of several widths run over the words,
each keeps its maximum over the text, and a logistic layer reads the maxima. Thresholds are calibrated for each language,
which is told from the text's own function words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import ROWS_PER_BATCH, column, give_back, picked, sliced, texts
from chronoframe.llm.labelled import fold, sample

WORDS, HEADS, HEAD = 1 << 15, 1 << 14, 4
#: At least EPOCHS passes over the rows and STEPS batches.
SIZE, FILTERS, FILTER_WIDTHS = 16, 8, (1, 2, 3)
EPOCHS, STEPS, BATCH, RATE, DROP, DECAY = 4, 150, 64, 0.02, 0.2, 1e-4
#: Labelled rows that the fit takes at most, and characters of one of their texts.
FIT_ROWS, FIT_CHARS = 8000, 25_000
#: A language's threshold lies between its own best one and the common one: half-way where it has so many positive calibration rows.
HALF_WAY = 20
#: Words that a worker keeps, characters of the longest of them, and words that are convolved at once.
KEPT, LONGEST, AT_ONCE = 400_000, 64, 1 << 16
#: Frequent function words of the languages that thresholds know.
LANGUAGES = {
    "en": "the of and to in is that for it with was on are be this",
    "fr": "le la les des et une du dans qui est pour que pas sur au",
    "de": "der die und den das von zu mit ist nicht ein eine auf im dem",
    "es": "el los las del que en por con una para es se lo al como",
}
_WORD = re.compile(r"\w+")


class _Ids(dict):
    """word -> its two hashes in 4 bytes."""

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        ids = (zlib.crc32(raw) % WORDS).to_bytes(2, "little") + (zlib.crc32(word[:HEAD].encode("utf-8", "surrogatepass"), 1) % HEADS).to_bytes(2, "little")
        if len(word) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        return ids


_IDS = _Ids()


def word_ids(text: str) -> bytes:
    """Pairs of hashes (16 bits each) of the words of a text in lower case."""
    return b"".join(map(_IDS.__getitem__, _WORD.findall(text.lower())))


def _language_table() -> np.ndarray:
    table = np.zeros((len(LANGUAGES), WORDS), dtype=np.uint8)
    for i, words in enumerate(LANGUAGES.values()):
        table[i, [zlib.crc32(w.encode()) % WORDS for w in words.split()]] = 1
    return table


def languages(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text the language with most function words, the first of equals; one more than the last for none."""
    counts = np.zeros((len(LANGUAGES), len(starts)), dtype=np.int64)
    full = sizes > 0
    if full.any():
        for i, own in enumerate(_language_table()):
            counts[i, full] = np.add.reduceat(own[words], starts[full], dtype=np.int64)
    return np.where(counts.max(axis=0) > 0, counts.argmax(axis=0), len(LANGUAGES))


@dataclass
class Model:
    word: np.ndarray
    head: np.ndarray
    kernels: list[np.ndarray]  # width x SIZE x FILTERS each
    bias: np.ndarray
    out: np.ndarray
    shift: float
    threshold: np.ndarray  # of each language and none
    scale: float = 1.0

    def embed(self, ids: np.ndarray) -> np.ndarray:
        return self.word[ids[:, 0]] + self.head[ids[:, 1]]

    def _windows(self, ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each filter width its number and the filters' values at each window: FILTERS x windows; no window leaves its text."""
        kernels = np.concatenate([kernel[j].T for kernel in self.kernels for j in range(kernel.shape[0])])
        x = kernels @ self.embed(ids).T
        ends, at = np.cumsum(sizes), 0
        for k, kernel in enumerate(self.kernels):
            width = kernel.shape[0]
            n = max(0, len(ids) - width + 1)
            y = x[at : at + FILTERS, :n]
            for j in range(1, width):
                y = y + x[at + j * FILTERS : at + (j + 1) * FILTERS, j : j + n]
            over = (ends[:, None] - np.arange(1, width)).ravel()
            y[:, over[(over >= 0) & (over < n)]] = -np.inf
            yield k, y
            at += width * FILTERS

    def pooled(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The filters' maxima (rectified) for each text, and the first place of each (-1: nowhere above zero)."""
        best, where = np.zeros((len(sizes), len(self.bias)), dtype=np.float32), np.full((len(sizes), len(self.bias)), -1)
        ends = np.cumsum(sizes)
        for k, y in self._windows(ids, sizes):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            for i in np.flatnonzero(sizes >= FILTER_WIDTHS[k]).tolist():
                own = y[:, ends[i] - sizes[i] : ends[i]]
                places = own.argmax(axis=1)
                top = own[np.arange(FILTERS), places] + self.bias[part]
                best[i, part] = np.maximum(top, 0)
                where[i, part] = np.where(top > 0, places + ends[i] - sizes[i], -1)
        return best, where

    def maxima(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """As pooled, without places, in parts of bounded memory: a text may be cut, with windows over the cut kept."""
        reach = max(FILTER_WIDTHS) - 1
        best = np.zeros((len(sizes), len(self.bias)), dtype=np.float32)
        ends = np.cumsum(sizes)
        bounds = np.append(0, ends)
        at, total = 0, len(ids)
        while at < total:
            stop = min(total, at + AT_ONCE)
            first, last = np.searchsorted(ends, at, side="right"), np.searchsorted(bounds, stop, side="left")
            low, high = np.maximum(bounds[first:last], at), np.minimum(bounds[first + 1 : last + 1], stop + reach)
            own = self._tops(ids[at : int(high[-1])], high - low)
            best[first:last] = np.maximum(best[first:last], own)
            at = stop
        return best

    def _tops(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        best = np.zeros((len(sizes), len(self.bias)), dtype=np.float32)
        starts = np.cumsum(sizes) - sizes
        for k, y in self._windows(ids, sizes):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            long = np.flatnonzero(sizes >= FILTER_WIDTHS[k])
            if len(long):
                best[long, part] = np.maximum(np.maximum.reduceat(y, starts[long], axis=1).T + self.bias[part], 0)
        return best

    def logits(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.maxima(ids, sizes) @ self.out + self.shift

    def scores(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """0 to 1; at least 0.5 from the language's threshold on."""
        starts = np.cumsum(sizes) - sizes
        spoken = languages(ids[:, 0], starts, sizes)
        z = np.clip((self.logits(ids, sizes) - self.threshold[spoken]) * self.scale, -30, 30)
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def _start(ids: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> Model:
    """Embeddings whose first number is how sure it is that a hash is commoner in positive texts; unseen hashes are zero."""

    def table(column: int, size: int) -> np.ndarray:
        a, both = np.zeros(size), np.zeros(size)
        for own, y in zip(ids, labels, strict=True):
            met = np.unique(own[:, column])
            both[met] += 1
            a[met] += y
        odds = np.log((a + 0.5) / (labels.sum() + 1)) - np.log((both - a + 0.5) / ((1 - labels).sum() + 1))
        sure = np.maximum(0, odds - 1.5 * np.sqrt(1 / (a + 0.5) + 1 / (both - a + 0.5)))
        made = rng.normal(0, 0.02, (size, SIZE)).astype(np.float32)
        made[:, 0] = sure
        made[both < 3] = 0
        return made

    kernels = [rng.normal(0, 0.3 / np.sqrt(w * SIZE), (w, SIZE, FILTERS)).astype(np.float32) for w in FILTER_WIDTHS]
    for kernel in kernels:
        kernel[:, 0, 0] = 1 / len(kernel)
    n = len(FILTER_WIDTHS) * FILTERS
    return Model(table(0, WORDS), table(1, HEADS), kernels, np.zeros(n, dtype=np.float32), np.full(n, 0.3, dtype=np.float32), float(np.log((labels.sum() + 1) / ((1 - labels).sum() + 1))), np.zeros(len(LANGUAGES) + 1, dtype=np.float32))


def fit(rows: list[bytes], labels: np.ndarray, seed: int = 5) -> Model:
    """Train on word ids of texts; one row in five is kept back to calibrate thresholds. One class only: a model of that class's share."""
    rng = np.random.default_rng(seed)
    all_ids = [np.frombuffer(r, dtype="<u2").reshape(-1, 2) for r in rows]  # views: the rows are held once
    labels = labels.astype(np.float64)
    order = rng.permutation(len(rows))
    kept_back, train = order[: len(order) // 5], order[len(order) // 5 :]
    join = lambda of: (np.concatenate([np.zeros((0, 2), dtype="<u2"), *(all_ids[i] for i in of)]), np.array([len(all_ids[i]) for i in of], dtype=np.int64))
    model = _start([all_ids[i] for i in train], labels[train], rng)
    parameters = [*model.kernels, model.bias, model.out]
    shift = np.array([model.shift])
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in [*parameters, shift]]
    seen = {"word": np.full(WORDS, 1e-3), "head": np.full(HEADS, 1e-3)}
    step = 0
    epochs = max(EPOCHS, -(-STEPS // max(1, -(-len(train) // BATCH))))
    for _ in range(epochs if 0 < labels.sum() < len(labels) else 0):
        rng.shuffle(train)
        for a in range(0, len(train), BATCH):
            part = train[a : a + BATCH]
            ids, sizes = join(part)
            step += 1
            top, where = model.pooled(ids, sizes)
            mask = (rng.random(top.shape) >= DROP) / (1 - DROP)
            p = 1 / (1 + np.exp(-np.clip((top * mask) @ model.out + shift[0], -30, 30)))
            error = (p - labels[part]) / len(part)
            grads = [np.zeros_like(g) for g in parameters] + [np.array([error.sum()])]
            grads[-2] = ((top * mask).T @ error).astype(np.float32) + DECAY * model.out
            back = (error[:, None] * model.out * mask * (where >= 0)).astype(np.float32)
            x = model.embed(ids) if len(ids) else np.zeros((0, SIZE), dtype=np.float32)
            moved, amounts = [], []
            for k, kernel in enumerate(model.kernels):
                sub, at = back[:, k * FILTERS : (k + 1) * FILTERS], where[:, k * FILTERS : (k + 1) * FILTERS]
                row, f = np.nonzero(at >= 0)
                place, g = at[row, f], sub[row, f]
                grads[len(model.kernels)][k * FILTERS : (k + 1) * FILTERS] = sub.sum(axis=0)
                for j in range(kernel.shape[0]):
                    grad = np.zeros((FILTERS, SIZE), dtype=np.float32)
                    np.add.at(grad, f, g[:, None] * x[place + j])
                    grads[k][j] = grad.T + DECAY * kernel[j]
                    moved.append(place + j)
                    amounts.append(g[:, None] * kernel[j].T[f])
            moved, amounts = np.concatenate(moved), np.concatenate(amounts)
            for name, col in (("word", 0), ("head", 1)):
                table, rows_ = getattr(model, name), ids[moved, col]
                own, inverse = np.unique(rows_, return_inverse=True)
                g = np.zeros((len(own), SIZE), dtype=np.float32)
                np.add.at(g, inverse, amounts)
                live = (table[own] != 0).any(axis=1)
                seen[name][own] += (g**2).mean(axis=1)
                table[own] -= np.where(live[:, None], RATE * g / np.sqrt(seen[name][own])[:, None], 0).astype(np.float32)
            for p_, g, (m, v) in zip([*parameters, shift], grads, moment, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g**2 - v)
                p_ -= (0.2 * RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p_.dtype)
    model.shift = float(shift[0])
    if len(kept_back):
        ids, sizes = join(kept_back)
        spoken = languages(ids[:, 0], np.cumsum(sizes) - sizes, sizes)
        z = model.logits(ids, sizes)
        common = best_threshold(z, labels[kept_back])
        for i in range(len(LANGUAGES) + 1):
            own, found = labels[kept_back][spoken == i], labels[kept_back][spoken == i].sum()
            share = found / (found + HALF_WAY) if 0 < found < len(own) else 0.0
            model.threshold[i] = share * best_threshold(z[spoken == i], own) + (1 - share) * common
    return model


def best_threshold(z: np.ndarray, labels: np.ndarray) -> float:
    """Where fewest rows are on the wrong side, in the middle of the widest such gap. One class only: 0."""
    order = np.argsort(z, kind="stable")
    z, labels = z[order], labels[order]
    if not len(z) or labels.min() == labels.max():
        return 0.0
    wrong = np.append(0, np.cumsum(labels)) + np.append(0, np.cumsum((1 - labels)[::-1]))[::-1]
    gap = np.append(np.append(0, np.diff(z)), 0)
    gap[wrong > wrong.min()] = -1
    at = int(np.argmax(gap))
    return float((z[at - 1] + z[at]) / 2) if 0 < at < len(z) else float(z[0] - 1e-3 if at == 0 else z[-1] + 1e-3)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """A model from at most fit_rows labelled rows outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array([word_ids(t) for t in texts(batch)], pa.binary()), column(batch, "_label")], names=["ids", "label"])

    found = sample(docs, labels, "toxic", 5, 0, fit_rows, FIT_CHARS, id_col, text_col).mapInArrow(run, "ids binary, label int").toArrow()
    rows = sorted(zip(found["ids"].to_pylist(), found["label"].to_pylist(), strict=True))  # the same fit whatever the partitions
    del found
    model = fit([r for r, _ in rows], np.array([y for _, y in rows], dtype=np.int64))
    del rows
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs, from its whole text alone.

    A null text is empty and an empty one has no maxima: its score is that of the model's own shift. A null id stays null
    and is in no fold. Rows that repeat an id are scored each. Empty table: empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS_PER_BATCH):
            raw = [word_ids(t) for t in texts(batch)]
            sizes = np.array([len(r) // 4 for r in raw], dtype=np.int64)
            found = shared.value.scores(np.frombuffer(b"".join(raw), dtype="<u2").reshape(-1, 2), sizes)
            yield pa.RecordBatch.from_arrays([column(batch, "_id"), pa.array(found)], names=["doc_id", "score"])

    found = picked(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score(docs, train(docs, labels, id_col, text_col), id_col, text_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows predicted toxic; decided in the scan, row by row, with all columns as they are.

    A null text counts as empty and its row stays null; rows that repeat an id or a text are decided each, alike. Ids are
    not read. Empty table: empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raw = [word_ids(t or "") for t in texts(batch, text_col)]
            sizes = np.array([len(r) // 4 for r in raw], dtype=np.int64)
            found = shared.value.scores(np.frombuffer(b"".join(raw), dtype="<u2").reshape(-1, 2), sizes)
            yield batch.filter(pa.array(found < 0.5))

    return docs.mapInArrow(run, docs.schema)
