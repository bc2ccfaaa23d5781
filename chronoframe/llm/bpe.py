"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut into chunks by a rolling hash. A chunk that occurs more than once in the corpus is encoded once, on
whichever task gets its digest, and its ids are joined to all documents that hold it; a chunk that occurs once is encoded
where it lies. A chunk's ids are taken between its first and last word end that white space follows; the text before and
after is kept, and where chunks meet these ends are joined and encoded again. Each such place is tried: the text outside is
encoded with the next piece inside, and if their ids are not those of both apart, the repair grows to the next place, until
they agree exactly. If a chunk has no such place, the repair grows over it to the next chunk that has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.chunking import Chunker, digest, repeats
from chronoframe.llm.common import Workspace, column, free_shuffles, hot_keys, picked, sliced, spread_join, texts
from chronoframe.llm.tokens import Coder, coder, encoded

#: A chunk's code: text up to its first safe place, ids between, text after its last; open: no such place, all of it is head.
Part = tuple[str, bytes, str, bool]
_PART = pa.struct([("head", pa.string()), ("ids", pa.binary()), ("tail", pa.string()), ("open", pa.bool_())])
_SPACE = " \n\t\r"
_SAFE = re.compile(r"(?<=\S)[ \n\t\r]")


def ends(chunk: str, skip: tuple[int, int] = (0, 0)) -> tuple[str, str, str, bool]:
    """The text before the first safe place, between, and after the last, with so many safe places skipped from the front and from the back.

    Safe: between a character and white space that follows it. Without two such places all of the chunk is open.
    """
    if skip == (0, 0):
        first = _SAFE.search(chunk)
        if not first:
            return chunk, "", "", True
        last = len(chunk)
        while True:
            last = max(chunk.rfind(c, 0, last) for c in _SPACE)
            if not chunk[last - 1].isspace():
                break
        a, b = first.start(), last
    else:
        places = [m.start() for m in _SAFE.finditer(chunk)]
        a, b = (places[skip[0]], places[len(places) - 1 - skip[1]]) if len(places) > sum(skip) else (0, 0)
    return (chunk[:a], chunk[a:b], chunk[b:], False) if a < b else (chunk, "", "", True)


def _word(text: str, last: bool) -> str:
    """The first or the last piece of a text between safe places."""
    if last:
        found = [m.start() for m in _SAFE.finditer(text[-256:])]
        return text[-256:][found[-1] :] if found else text
    found = _SAFE.search(text, 1)
    return text[: found.start()] if found else text


def encode_parts(vocabulary: str, chunks: list[str]) -> list[Part]:
    """The code of each chunk. What lies outside is encoded with the next piece inside, and both apart: where the ids differ
    the vocabulary joins something over that place, so the repair grows to the next one, until they agree exactly or all is open.
    """
    cut = [ends(c) for c in chunks]
    skip = [(0, 0)] * len(chunks)
    unsure = [i for i, c in enumerate(cut) if not c[3] and c[1]]
    while unsure:
        seams = []
        for i in unsure:
            head, inner, tail, _ = cut[i]
            first, last = _word(inner, False), _word(inner, True)
            seams += [head + first, head, first, last + tail, last, tail]
        ids = iter(encoded(vocabulary, seams))
        again = []
        for i in unsure:
            front, head, first, back, last, tail = (next(ids) for _ in range(6))
            apart = (front != head + first, back != last + tail)
            if any(apart):
                skip[i] = (skip[i][0] + apart[0], skip[i][1] + apart[1])
                cut[i] = ends(chunks[i], skip[i])
                again += [i] if cut[i][1] else []
        unsure = again
    ids = encoded(vocabulary, [c[1] for c in cut])
    return [(head, raw, tail, whole) for (head, _, tail, whole), raw in zip(cut, ids, strict=True)]


def join_parts(vocabulary: str, documents: list[list[Part]]) -> list[bytes]:
    """The ids of each document: those of its parts, and between them the ends that meet, encoded again in one call for all."""
    pieces: list[list[bytes | int]] = []
    seams: list[str] = []
    for parts in documents:
        held, out = "", []
        for head, ids, tail, whole in parts:
            held += head
            if not whole:
                out += [len(seams), ids]
                seams.append(held)
                held = tail
        out.append(len(seams))
        seams.append(held)
        pieces.append(out)
    repaired = encoded(vocabulary, seams)
    return [b"".join(repaired[x] if isinstance(x, int) else x for x in out) for out in pieces]


class Decoder:
    """ids -> text as the library decodes without a decoder of its own: tokens with a space between; else the library itself."""

    def __init__(self, own: Coder, vocabulary: str):
        import json

        with open(vocabulary, encoding="utf-8") as f:
            self.plain = json.load(f).get("decoder") is None
        self.own = own
        self.token = [t.encode() for t in own.tokens]
        self.decimal = [str(i).encode() for i in range(len(self.token))]

    def digests(self, raw: bytes) -> tuple[int, str, str]:
        ids = self.own.ids(raw).tolist()
        text = b" ".join(map(self.token.__getitem__, ids)) if self.plain else self.own.library.decode(ids, skip_special_tokens=False).encode()
        return len(ids), hashlib.sha256(b" ".join(map(self.decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(text).hexdigest()


def decode(vocabulary: str, raw: bytes) -> str:
    """The text of packed ids, special tokens included."""
    return coder(vocabulary).library.decode(coder(vocabulary).ids(raw).tolist(), skip_special_tokens=False)


_CODED = "row long, doc_id long, key binary, ids binary, own array<struct<place:int,head:string,ids:binary,tail:string,open:boolean>>, refs array<struct<place:int,digest:binary>>, shared array<struct<digest:binary,body:string>>"
_PLACED = pa.struct([("place", pa.int32()), *_PART])
_REFS = pa.struct([("place", pa.int32()), ("digest", pa.binary())])
_SHARED = pa.struct([("digest", pa.binary()), ("body", pa.string())])


def _part(place: int, part: Part) -> dict:
    return {"place": place, "head": part[0], "ids": part[1], "tail": part[2], "open": part[3]}


def encode_chunks(docs: DataFrame, space: Workspace, vocabulary: str, chunker: Chunker, id_col: str, text_col: str) -> DataFrame:
    """A row per document: its ids where it has no repeated chunk, else its own chunks' codes and references to the others."""
    plain = picked(docs, id_col, text_col)
    again = repeats(plain, space, lambda t: t.encode("utf-8", "surrogatepass"), chunker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()  # digests whose text this task has sent already
        for batch in sliced(batches):
            split = chunker.split([t.encode("utf-8", "surrogatepass") for t in texts(batch)])
            digests = [[digest(c) for c in chunks] for chunks in split]
            flags = again.has([d for own in digests for d in own])
            bounds = np.cumsum([0, *map(len, split)]).tolist()
            flat = [c.decode("utf-8", "surrogatepass") for chunks in split for c in chunks]
            coded = iter(encode_parts(vocabulary, [c for c, f in zip(flat, flags.tolist(), strict=True) if not f]))
            closed, rows = [], []
            for i, own in enumerate(digests):
                mine, refs, shared = [], [], []
                for place, d in enumerate(own):
                    at = bounds[i] + place
                    if not flags[at]:
                        mine.append((place, next(coded)))
                        continue
                    refs.append({"place": place, "digest": d})
                    if d not in sent:
                        sent.add(d)
                        shared.append({"digest": d, "body": flat[at]})
                if not refs:
                    closed.append([p for _, p in mine])
                rows.append((digest(b"".join(own)), None if refs else len(closed) - 1, [_part(k, p) for k, p in mine] if refs else [], refs, shared))
            ids = join_parts(vocabulary, closed)
            columns = [
                pa.array([r[0] for r in rows], pa.binary()), pa.array([None if r[1] is None else ids[r[1]] for r in rows], pa.binary()),
                pa.array([r[2] for r in rows], pa.list_(_PLACED)), pa.array([r[3] for r in rows], pa.list_(_REFS)), pa.array([r[4] for r in rows], pa.list_(_SHARED)),
            ]
            yield pa.RecordBatch.from_arrays([column(batch, "row"), column(batch, "_id"), *columns], names=["row", "doc_id", "key", "ids", "own", "refs", "shared"])

    return plain.select(F.monotonically_increasing_id().alias("row"), "_id", "_text").mapInArrow(run, _CODED)


def encode(docs: DataFrame, space: Workspace, vocabulary: str, finish, schema: str, id_col: str = "doc_id", text_col: str = "text", average_bits: int = 10, least: int = 256, most: int = 8192) -> DataFrame:
    """finish(ids of documents) -> columns of schema, for each row of docs; with doc_id in front.

    Ids are the tokenizers library's without special tokens added. A null text is empty, a null id stays null, rows that
    repeat an id stay apart. Empty table: empty result. Other columns are not read.
    """
    fields = [x.split()[0] for x in schema.split(", ")]

    def finished(rows: list[int], ids: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *finish(ids)], names=["row", *fields])

    coded = encode_chunks(docs, space, vocabulary, Chunker(average_bits, least, most, text=True), id_col, text_col)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is whole already is finished in the same scan, so ids of such documents go nowhere."""
        for batch in batches:
            ids = column(batch, "ids").to_pylist()
            done = finish([x for x in ids if x is not None])
            at = np.cumsum([x is not None for x in ids]) - 1
            take = pa.array([None if x is None else int(k) for x, k in zip(ids, at, strict=True)], pa.int64())
            names = ["row", "doc_id", "key", "own", "refs", "shared"]
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in names), *(c.take(take) for c in done)], names=[*names, *fields])

    kept = _CODED.replace("ids binary, own", "own")
    coded = space.save(coded.mapInArrow(close, f"{kept}, {schema}"), "coded")
    sent = coded.select(F.explode("shared").alias("c")).select("c.digest", "c.body").groupBy("digest").agg(F.first("body").alias("body"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            parts = encode_parts(vocabulary, column(batch, "body").to_pylist())
            columns = [pa.array([p[i] for p in parts], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([column(batch, "digest"), *columns], names=["digest", "head", "ids", "tail", "open"])

    shared = space.save(sent.mapInArrow(once, "digest binary, head string, ids binary, tail string, open boolean"), "shared")
    free_shuffles(docs.sparkSession)
    opened = coded.where(F.size("refs") > 0)
    # Documents of repeated chunks only are put together once for each distinct list of chunks.
    alike = opened.where(F.size("own") == 0).groupBy("key").agg(F.min("row").alias("row"), F.first("refs").alias("refs"), F.count("*").alias("n"))
    hot_lists = space.save(hot_keys(alike, ["key"], "n"), "hot-lists")
    mixed = opened.where(F.size("own") > 0)
    wanted = mixed.select("row", F.explode("refs").alias("r")).union(alike.select("row", F.explode("refs").alias("r"))).select("row", "r.place", "r.digest")
    names = ["row", "place", "head", "ids", "tail", "open"]
    # A chunk that very many documents hold is broadcast (fewer than 1,000 codes), so its references stay where they are.
    hot = space.save(hot_keys(wanted.groupBy("digest").count(), ["digest"], "count"), "hot")
    parts = spread_join(wanted, shared, ["digest"], hot).select(*names).union(mixed.select("row", F.explode("own").alias("p")).select("row", "p.*").select(*names))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by row, then place."""
        rows: list[int] = []
        held: list[list[Part]] = []
        for batch in sliced(batches):
            for row, head, ids, tail, whole in zip(*(column(batch, n).to_pylist() for n in ("row", "head", "ids", "tail", "open")), strict=True):
                if not rows or rows[-1] != row:
                    if len(rows) >= 256:
                        yield finished(rows, join_parts(vocabulary, held))
                        rows, held = [], []
                    rows.append(row)
                    held.append([])
                held[-1].append((head, ids, tail, whole))
        yield finished(rows, join_parts(vocabulary, held))

    gathered = parts.repartition("row").sortWithinPartitions("row", "place").mapInArrow(gather, f"row long, {schema}")
    gathered = space.save(gathered, "gathered")
    closed = coded.where(F.size("refs") == 0).select("doc_id", *fields)
    alone = mixed.select("row", "doc_id").join(gathered, "row").select("doc_id", *fields)
    leaders = gathered.join(alike.select("row", "key"), "row").drop("row")
    copied = spread_join(opened.where(F.size("own") == 0).select("doc_id", "key"), leaders, ["key"], hot_lists).select("doc_id", *fields)
    return closed.union(alone).union(copied)


def token_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", **chunks: int) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids with a space between) and decoded_sha256 of each row of docs."""

    def finish(ids: list[bytes]) -> list[pa.Array]:
        own = _decoder(vocabulary)
        found = [own.digests(raw) for raw in ids]
        return [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

    return encode(docs, Workspace(docs.sparkSession, "bpe"), vocabulary, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col, **chunks)


def token_ids(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", **chunks: int) -> DataFrame:
    """doc_id and ids, the array of each row's token ids."""

    def finish(ids: list[bytes]) -> list[pa.Array]:
        own = coder(vocabulary)
        return [pa.array([own.ids(raw).astype("<i4") for raw in ids], pa.list_(pa.int32()))]

    return encode(docs, Workspace(docs.sparkSession, "bpe"), vocabulary, finish, "ids array<int>", id_col, text_col, **chunks)


_DECODERS: dict[str, Decoder] = {}


def _decoder(vocabulary: str) -> Decoder:
    if vocabulary not in _DECODERS:
        _DECODERS[vocabulary] = Decoder(coder(vocabulary), vocabulary)
    return _DECODERS[vocabulary]
