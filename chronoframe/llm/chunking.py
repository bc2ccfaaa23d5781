"""Content-defined chunks, and which of them occur more than once in a corpus.

A rolling gear hash over the last 32 bytes cuts a text where its top bits are zero, so equal passages are cut alike
wherever they stand. A chunk's digest is compared across the corpus by an aggregation; only digests travel. Digests that
occur again are folded into a Bloom filter of a fixed size, which tells a second scan what to send to other tasks: chunks
that occur once stay where they are. A filter that says yes too often sends more and is never wrong.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import Workspace, column, sliced, texts

#: One pseudo-random number for each byte, by rule.
GEAR = np.array([zlib.crc32(bytes([i, 0x5C])) for i in range(256)], dtype=np.uint32)
WINDOW = 32
#: The filter has 16 bits for each digest that occurs again, 2^28 (32 MB) at most whatever the corpus: beyond 17 million such
#: digests it says yes too often, and more chunks travel.
LEAST_BITS, MOST_BITS, PROBES = 20, 28, 3


def cut_marks(data: np.ndarray, average_bits: int) -> np.ndarray:
    """Places after which the gear hash of the last WINDOW bytes ends a chunk. Doubling steps make it six passes over the data."""
    h = GEAR[data]
    reach = 1
    while reach < WINDOW:
        more = h[:-reach] << np.uint32(reach)
        h[reach:] += more
        reach *= 2
    return np.flatnonzero(h >> np.uint32(32 - average_bits) == 0) + 1


def cuts(size: int, marks: np.ndarray, least: int, most: int) -> list[int]:
    """Ends of the chunks of a text of so many bytes: marks at least `least` apart, forced cuts after `most`. An empty text has no chunk."""
    ends, at = [], 0
    for m in marks.tolist():
        while m - at > most:
            at += most
            ends.append(at)
        if m - at >= least and m < size:
            ends.append(m)
            at = m
    while size - at > most:
        at += most
        ends.append(at)
    return [*ends, size] if size else []


class Chunker:
    """Chunks of about 2^average_bits bytes beyond the least. text: cut before the start of a character only."""

    def __init__(self, average_bits: int = 10, least: int = 256, most: int = 8192, text: bool = False):
        assert least >= WINDOW, "a cut must depend on bytes of its own text only"
        self.average_bits, self.least, self.most, self.text = average_bits, least, most, text

    def split(self, payloads: list[bytes]) -> list[list[bytes]]:
        """The chunks of each payload, in order; together they are the payload."""
        out: list[list[bytes]] = []
        held: list[bytes] = []
        size = 0
        for p in [*payloads, None]:
            if held and (p is None or size + len(p) > 4 << 20):
                out += self._split(held)
                held, size = [], 0
            if p is not None:
                held.append(p)
                size += len(p)
        return out

    def _split(self, payloads: list[bytes]) -> list[list[bytes]]:
        joined = np.frombuffer(b"".join(payloads), dtype=np.uint8)
        marks = cut_marks(joined, self.average_bits)
        if self.text and len(marks):  # forward to the next byte that starts a character
            follows = np.append((joined & 0xC0) == 0x80, [False] * 4)
            for _ in range(3):
                marks = marks + follows[marks]
        bounds = np.cumsum([0, *map(len, payloads)])
        which = np.searchsorted(marks, bounds)
        out = []
        for i, p in enumerate(payloads):
            ends = cuts(len(p), marks[which[i] : which[i + 1]] - bounds[i], self.least, self.most)
            if self.text:
                ends = [self._start(p, e) for e in ends]
            out.append([p[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        return out

    @staticmethod
    def _start(p: bytes, at: int) -> int:
        while at < len(p) and p[at] & 0xC0 == 0x80:
            at += 1
        return at


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def probes(digests: list[bytes], log: int) -> np.ndarray:
    """Places of each digest in a filter of 2^log bits, one row each."""
    words = np.frombuffer(b"".join(digests), dtype="<u4").reshape(-1, 4)[:, :PROBES]
    return (words >> np.uint32(32 - log)).astype(np.int64)


class Repeats:
    """Tells of a digest whether it may occur more than once in the corpus: always yes if it does."""

    def __init__(self, bits: np.ndarray, log: int):
        self.bits, self.log = bits, log

    def has(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, dtype=bool)
        at = probes(digests, self.log)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def repeats(docs: DataFrame, space: Workspace, payload: Callable[[str], bytes], chunker: Chunker) -> Repeats:
    """One scan of docs (column _text). payload(text) gives the bytes to chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counted: dict[bytes, int] = {}
            for chunks in chunker.split([payload(t) for t in texts(batch)]):
                for c in chunks:
                    d = digest(c)
                    counted[d] = counted.get(d, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], names=["digest", "n"])

    counts = docs.select("_text").mapInArrow(run, "digest binary, n long")
    again = space.save(counts.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest"), "again")
    log = min(max((16 * again.count()).bit_length(), LEAST_BITS), MOST_BITS)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's own filter as its words of 8 bytes that aren't zero."""
        bits = np.zeros(1 << log, dtype=np.uint8)
        for batch in batches:
            found = column(batch, "digest").to_pylist()
            if found:
                bits[probes(found, log).ravel()] = 1
        words = np.packbits(bits, bitorder="little").view("<i8")
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used])], names=["word", "bits"])

    folded = again.mapInArrow(fold, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (log - 6), dtype="<i8")  # 2^22 rows at most come here
    words[folded["word"].to_numpy()] = folded["bits"].to_numpy()
    return Repeats(words.view(np.uint8), log)
