"""Exactly the tokenizers library's ids, with a memory of words.

Both vocabularies split a text into words before any merge, so a word's ids don't depend on its neighbours. A worker
keeps the ids of words it has met and merges only new words, by the table of the library's own file. Texts with
characters whose class, case or normal form could be told differently by Python and by the library go to the library
whole. Each worker's first texts are encoded by both; if their ids differ, that worker goes on with the library alone.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Callable, Sequence

import numpy as np

#: Words that a worker keeps, and bytes of the longest of them: 100 MB at most. Beyond that it forgets all words.
MOST_WORDS, LONGEST = 400_000, 64
#: Texts that each worker encodes by the library as well.
CHECKED = 8
_WORD_END = b"\xff"
#: Latin-1 without controls, no-break space and soft hyphen: \s, \p{L}, \p{N} and lower case are plain there.
_PLAIN = bytes([9, 10, 11, 12, 13, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
_NUMBER = "0-9²³¹¼½¾"
_LOWER = "a-zªµºß-öø-ÿ"
_LETTER = f"A-ZÀ-ÖØ-Þ{_LOWER}"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: The split patterns of the two public vocabularies, with classes spelled out for plain texts.
_WORD_ENDS = re.compile(rf"{_SHORT}|[{_LOWER}]+|[{_NUMBER}]|[^\s{_LOWER}{_NUMBER}]+")
_BYTE_LEVEL = re.compile(rf"{_SHORT}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_WORD_ENDS_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 as it is, the other bytes from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merger(model: dict, end: bytes) -> Callable[[bytes], list[int]] | None:
    """word's bytes (and `end`) -> ids, or None where the file is no plain byte-level BPE whose ids are in the order of its merges.

    The end of a word is a byte that UTF-8 never has, so that a last character with its mark is a pair of bytes; the ids of
    those pairs are lower than any merge's, so they are joined first, as the vocabulary wants it.
    """
    import tiktoken

    if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or (model.get("end_of_word_suffix") or "") != ("</w>" if end else ""):
        return None
    byte, ranks = _alphabet(), {}
    for token, i in model["vocab"].items():
        last = bool(end) and token.endswith("</w>")
        try:
            ranks[bytes(byte[c] for c in (token[:-4] if last else token)) + (end if last else b"")] = i
        except KeyError:
            return None
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if len(ranks) != len(model["vocab"]) or made != sorted(made) or len(made) + (512 if end else 256) != len(ranks):
        return None
    return tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class _Memory(dict):
    """Words and their packed ids; a new word is merged when it is asked for."""

    def __init__(self, merge: Callable[[bytes], list[int]], end: bytes, packed: list[bytes]):
        super().__init__()
        self.merge, self.end, self.pack = merge, end, packed.__getitem__

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = b"".join(map(self.pack, self.merge(raw + self.end)))
        if len(raw) <= LONGEST:
            self[word] = ids
        return ids


class Coder:
    """encode(texts): for each text its ids as little-endian bytes, `width` bytes an id. path: a tokenizers JSON file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        size = max(self.library.get_vocab().values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.width = self.dtype.itemsize
        self.special = [t["content"] for t in rules["added_tokens"]]
        before, normal = rules.get("pre_tokenizer") or {}, rules.get("normalizer") or {}
        parts = [p["type"] for p in before.get("pretokenizers", [])]
        self.words, self.end, self.to_check = None, b"", CHECKED
        if [x["type"] for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and parts == ["Split", "ByteLevel"] and before["pretokenizers"][0]["pattern"] == {"Regex": _WORD_ENDS_SPLIT}:
            self.words, self.end = _WORD_ENDS, _WORD_END
        elif not normal and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            self.words = _BYTE_LEVEL
        if self.words:
            merge = _merger(rules["model"], self.end)
            self.memory = _Memory(merge, self.end, [i.to_bytes(self.width, "little") for i in range(size)])
            self.words = self.words if merge else None

    def whole(self, texts: Sequence[str]) -> list[bytes]:
        """The library alone."""
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.library.encode_batch(list(texts), add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, _PLAIN) and not any(s in text for s in self.special)
        except UnicodeEncodeError:
            return False

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """A batch at a time, so that memory is bounded by the batch and the kept words."""
        if self.words is None:
            return self.whole(texts)
        if len(self.memory) > MOST_WORDS:
            self.memory.clear()
        known, words, lower = self.memory.__getitem__, self.words.findall, bool(self.end)
        plain = [self._plain(t) for t in texts]
        out = [b"".join(map(known, words(t.lower() if lower else t))) if p else b"" for t, p in zip(texts, plain, strict=True)]
        odd = [i for i, p in enumerate(plain) if not p]
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = ids
        if self.to_check and texts:  # each worker holds its first texts against the library
            few = range(min(self.to_check, len(texts)))
            if [out[i] for i in few] != self.whole([texts[i] for i in few]):
                self.words = None
                return self.whole(texts)
            self.to_check -= len(few)
        return out

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, dtype=self.dtype)

    @functools.cached_property
    def tokens(self) -> list[str]:
        """Each id's token; an id without one decodes to nothing, as in the library."""
        names = self.library.get_vocab()
        table = [""] * (max(names.values()) + 1)
        for token, i in names.items():
            table[i] = token
        return table


@functools.lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    """One for each file and worker."""
    return Coder(path)


def batches_of(texts: list[str], most_chars: int = 4_000_000) -> list[list[str]]:
    """Runs of texts with about so many characters, so that long texts don't meet in one call."""
    out, held, size = [], [], 0
    for t in texts:
        if held and size + len(t) > most_chars:
            out.append(held)
            held, size = [], 0
        held.append(t)
        size += len(t)
    return [*out, held] if held else out


def encoded(path: str, texts: list[str]) -> list[bytes]:
    return list(itertools.chain.from_iterable(coder(path).encode(part) for part in batches_of(texts)))
