"""Simple-8b: ids in 64-bit words, a selector in the top 4 bits and a varying count of equally wide ids in the other 60.

A stream is cut into blocks of at most BLOCK ids; a word never spans blocks, and an array of word offsets lets each block
be decoded alone. An id of more than 60 bits is an escape: a word with the escape selector, then the id as a raw word.
"""

from __future__ import annotations

import numpy as np

#: Ids in a word by selector. Selector 14 marks an escape, 15 is not used.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = 60 // COUNTS
ESCAPE = 14
BLOCK = 1024
_SELECTOR = np.uint64(60)


_BITS16 = np.maximum(1, np.ceil(np.log2(np.arange(1 << 16) + 1.0))).astype(np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, 1 at least."""
    bits = _BITS16[(ids & np.uint64(0xFFFF)).astype(np.uint16)]
    for step in (16, 32, 48):
        large = np.flatnonzero(ids >> np.uint64(step)) if ids.max(initial=0) >> np.uint64(step) else ()
        if len(large):
            bits[large] = step + _BITS16[((ids[large] >> np.uint64(step)) & np.uint64(0xFFFF)).astype(np.uint16)]
    return bits


def _later(values: np.ndarray, by: int) -> np.ndarray:
    """values[i + by], and 0 beyond the end."""
    out = np.zeros_like(values)
    out[: max(0, len(values) - by)] = values[by:]
    return out


def _choices(bits: np.ndarray, room: np.ndarray) -> np.ndarray:
    """At each place the selector with most ids that fit from there on; room: ids left in the block, as bytes."""
    chosen = np.full(len(bits), ESCAPE, dtype=np.uint8)
    widest, reach = {1: bits}, 1  # widest[n][i]: the most bits among n ids from i on, for powers of two
    for selector in range(len(COUNTS) - 1, -1, -1):
        n, width = int(COUNTS[selector]), int(WIDTHS[selector])
        while 2 * reach <= n:
            widest[2 * reach] = np.maximum(widest[reach], _later(widest[reach], reach))
            reach *= 2
        most = widest[reach]
        if n > reach:
            most = np.maximum(most, _later(most, n - reach))
        fits = (most <= width) & (room >= n)
        chosen = np.where(fits, np.uint8(selector), chosen)
        if not fits.any() and width < int(bits.min(initial=0)):
            break
    return chosen


def encode_streams(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Streams of so many ids each, one after the other, in one call.

    Returns the words, the number of words of each stream, the offset of each block's first word in its stream, and the
    number of blocks of each stream.
    """
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    sizes = np.asarray(sizes, dtype=np.int64)
    n = len(ids)
    ends = np.cumsum(sizes)
    place = np.arange(n) - np.repeat(ends - sizes, sizes)
    left = np.repeat(sizes, sizes) - place
    room = np.minimum(np.minimum(left, BLOCK - (place & (BLOCK - 1))), int(COUNTS[0])).astype(np.uint8)
    chosen = _choices(_bits(ids), room)
    steps, at, starts = np.append(COUNTS, 1).astype(np.uint8)[chosen].tobytes(), 0, []
    while at < n:  # the one step that follows from the one before
        starts.append(at)
        at += steps[at]
    first = np.array(starts, dtype=np.int64)
    selector = chosen[first]
    words = selector.astype(np.uint64) << _SELECTOR
    for s in np.unique(selector).tolist():
        if s == ESCAPE:
            continue
        count, width = int(COUNTS[s]), int(WIDTHS[s])
        rows = np.flatnonzero(selector == s)
        for k in range(count):
            words[rows] |= ids[first[rows] + k] << np.uint64(k * width)
    size = np.where(selector == ESCAPE, 2, 1)
    where = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype="<u8")
    out[where] = words
    raw = np.flatnonzero(selector == ESCAPE)
    out[where[raw] + 1] = ids[first[raw]]
    word_ends = np.append(where, len(out))[np.searchsorted(first, ends)]
    word_begins = np.append(0, word_ends[:-1])
    heads = np.flatnonzero(place[first] % BLOCK == 0)
    stream = np.searchsorted(ends, first[heads], side="right")
    blocks = np.bincount(stream, minlength=len(sizes))
    return out, word_ends - word_begins, (where[heads] - word_begins[stream]).astype("<u4"), blocks


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One stream: its words, and for each block the offset of its first word."""
    words, _, offsets, _ = encode_streams(ids, np.array([len(ids)]))
    return words, offsets


def decode_streams(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of streams of so many words each, in order, and the number of ids of each stream."""
    words = np.asarray(words, dtype=np.uint64)
    selector = (words >> _SELECTOR).astype(np.int64)
    escapes = np.flatnonzero(selector == ESCAPE)
    if len(escapes):  # a raw word can look like anything: an escape is one only if the word before isn't one
        real, last = [], -2
        for e in escapes.tolist():
            if e != last + 1:
                real.append(e)
                last = e
        escapes = np.array(real)
        selector[escapes + 1] = ESCAPE + 1  # raw: no ids of its own
    count = np.append(COUNTS, [1, 0])[selector]
    after = np.cumsum(count)
    starts = after - count
    out = np.zeros(int(after[-1]) if len(after) else 0, dtype=np.uint64)
    out[starts[escapes]] = words[escapes + 1] if len(escapes) else 0
    for s in np.unique(selector).tolist():
        if s >= ESCAPE:
            continue
        rows = np.flatnonzero(selector == s)
        held, to, mask, width = words[rows], starts[rows], np.uint64((1 << int(WIDTHS[s])) - 1), int(WIDTHS[s])
        for k in range(int(COUNTS[s])):
            out[to + k] = (held >> np.uint64(k * width)) & mask
    ends = np.append(0, after)[np.cumsum(sizes)]
    return out, np.diff(ends, prepend=0)


def decode(words: np.ndarray) -> np.ndarray:
    """All ids of one stream, or of a run of its blocks."""
    return decode_streams(words, np.array([len(words)]))[0]


def decode_block(words: np.ndarray, offsets: np.ndarray, number: int) -> np.ndarray:
    """The ids of one block."""
    end = int(offsets[number + 1]) if number + 1 < len(offsets) else len(words)
    return decode(words[int(offsets[number]) : end])
