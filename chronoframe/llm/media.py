"""Media columns: payloads as content-defined chunks, each distinct chunk stored once, ordered chunk lists beside.

A document's payload is its UTF-8 bytes, filled with bytes 255 to whole blocks of 8-bit samples. The store has two tables.
`lists` has a row per document: its ordered chunk list (digest and size of each chunk) and the bodies of those chunks that
occur nowhere else. `chunks` has each repeated chunk once, after a join-side deduplication by digest. A document is read
back by its list: bodies from its own row and from `chunks`, each held against its digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.chunking import Chunker, digest, repeats
from chronoframe.llm.common import Workspace, column, free_shuffles, hot_keys, picked, sliced, spread_join, texts

#: Samples of one block: a payload is a positive number of them.
BLOCK = 576
FILL = b"\xff"
#: The stored form: this mark, the number of chunks, each chunk's digest and size, then the bodies in order.
MARK = b"CDC1"
_ENTRY = struct.Struct("<16sI")
_LISTS = "row long, doc_id long, n_bytes long, list binary, key binary, own binary, refs array<struct<place:int,digest:binary>>, shared array<struct<digest:binary,body:binary>>"
_FOUND = "row long, key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + FILL * (-len(raw) % BLOCK if raw else BLOCK)


def feature(samples: np.ndarray) -> str:
    """Samples in each of 16 equal bands, and the sum of absolute steps between neighbours."""
    bands = np.bincount(samples >> 4, minlength=16)
    steps = np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64)
    return ",".join(map(str, bands.tolist())) + f";{steps}"


def packed_list(chunks: list[bytes], digests: list[bytes]) -> bytes:
    return MARK + struct.pack("<I", len(chunks)) + b"".join(_ENTRY.pack(d, len(c)) for c, d in zip(chunks, digests, strict=True))


def entries(packed: bytes) -> list[tuple[bytes, int]]:
    if packed[:4] != MARK or len(packed) != 8 + _ENTRY.size * struct.unpack_from("<I", packed, 4)[0]:
        raise ValueError("not a chunk list")
    return list(_ENTRY.iter_unpack(packed[8:]))


def store(docs: DataFrame, space: Workspace, chunker: Chunker, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write docs to the shared folder and return the tables `lists` and `chunks` as read back."""
    plain = picked(docs, id_col, text_col)
    again = repeats(plain, space, payload, chunker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()  # digests whose body this task has sent already
        for batch in sliced(batches):
            raw = texts(batch)
            out: list[tuple] = []
            split = chunker.split([payload(t) for t in raw])
            digests = [[digest(c) for c in chunks] for chunks in split]
            repeated = iter(again.has([d for own in digests for d in own]).tolist())
            for text, chunks, own in zip(raw, split, digests, strict=True):
                refs, bodies, shared = [], [], []
                for place, (c, d) in enumerate(zip(chunks, own, strict=True)):
                    if not next(repeated):
                        bodies.append(c)
                        continue
                    refs.append({"place": place, "digest": d})
                    if d not in sent:
                        sent.add(d)
                        shared.append({"digest": d, "body": c})
                listed = packed_list(chunks, own)
                out.append((len(text.encode("utf-8", "surrogatepass")), listed, digest(listed), b"".join(bodies), refs, shared))
            names = ["n_bytes", "list", "key", "own", "refs", "shared"]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.struct([("place", pa.int32()), ("digest", pa.binary())])), pa.list_(pa.struct([("digest", pa.binary()), ("body", pa.binary())]))]
            columns = [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([column(batch, "row"), column(batch, "_id"), *columns], names=["row", "doc_id", *names])

    numbered = plain.select(F.monotonically_increasing_id().alias("row"), "_id", "_text")
    lists = space.save(numbered.mapInArrow(run, _LISTS), "lists")
    sent = lists.select(F.explode("shared").alias("c")).select("c.digest", "c.body")
    chunks = space.save(sent.groupBy("digest").agg(F.first("body").alias("body")), "chunks")
    free_shuffles(docs.sparkSession)
    return lists.drop("shared"), chunks


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by row, then place; place -1 has the list and the own bodies, the others a body from `chunks` each."""
    out: list[tuple] = []

    def finish(row: int, listed: bytes, own: bytes, bodies: dict[int, bytes]) -> tuple:
        parts, at = [], 0
        for place, (d, size) in enumerate(entries(listed)):
            body = bodies.get(place)
            if body is None:
                body = own[at : at + size]
                at += size
            if len(body) != size or digest(body) != d:
                raise ValueError(f"chunk {place} of row {row} is not what its list says")
            parts.append(body)
        media = hashlib.sha256(listed)
        for p in parts:
            media.update(p)
        read = b"".join(parts)
        return (row, digest(listed), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]), len(listed) + len(read), media.hexdigest(), feature(np.frombuffer(read, dtype=np.uint8)))

    def flush() -> pa.RecordBatch:
        names = ["row", "key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)
        out.clear()
        return made

    now: list = []  # row, list, own, bodies of the document being read
    for batch in sliced(batches):
        columns = [column(batch, n).to_pylist() for n in ("row", "place", "list", "body")]
        for row, place, listed, body in zip(*columns, strict=True):
            if place < 0:
                if now:
                    out.append(finish(*now))
                now = [row, listed, body, {}]
            else:
                now[3][place] = body
        if len(out) >= 512:
            yield flush()
    if now:
        out.append(finish(*now))
    yield flush()


def load(lists: DataFrame, chunks: DataFrame, space: Workspace) -> DataFrame:
    """doc_id, n_bytes and what the payload read back says, one row per document.

    Documents without repeated chunks are read where they lie. The others get their repeated chunks by a join on digest;
    those that consist of repeated chunks only are read once for each distinct list, so a third of all rows being copies
    moves one body and not as many.
    """
    head = [F.col("row"), F.lit(-1).alias("place"), "list", F.col("own").alias("body")]
    closed = lists.where(F.size("refs") == 0).select(*head).mapInArrow(_read, _FOUND)
    opened = lists.where(F.size("refs") > 0)
    light = opened.where(F.length("own") == 0).select("row", "key", "list", "refs")
    once = light.groupBy("key").agg(F.min("row").alias("row"), F.first("list").alias("list"), F.first("refs").alias("refs"), F.count("*").alias("n"))
    hot_lists = space.save(hot_keys(once, ["key"], "n"), "hot-lists")
    mixed = opened.where(F.length("own") > 0)
    wanted = mixed.select("row", F.explode("refs").alias("r")).union(once.select("row", F.explode("refs").alias("r")))
    # A chunk that very many documents hold is broadcast (fewer than 1,000 bodies), so its references stay where they are.
    wanted = wanted.select("row", "r.place", "r.digest")
    hot = space.save(hot_keys(wanted.groupBy("digest").count(), ["digest"], "count"), "hot")
    bodies = spread_join(wanted, chunks, ["digest"], hot).select("row", "place", F.lit(None).cast("binary").alias("list"), "body")
    heads = mixed.select(*head).union(once.select("row", F.lit(-1).alias("place"), "list", F.lit(b"").alias("body")))
    gathered = heads.union(bodies).repartition("row").sortWithinPartitions("row", "place").mapInArrow(_read, _FOUND)
    found = space.save(closed.union(gathered), "found")
    told = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    names = lists.select("row", "doc_id", "n_bytes", "key", ((F.size("refs") > 0) & (F.length("own") == 0)).alias("copied"))
    alone = names.where("not copied").join(found.drop("key"), "row")
    leaders = found.join(once.select("row"), "row", "left_semi").drop("row")
    copied = spread_join(names.where("copied").drop("row"), leaders, ["key"], hot_lists)
    return alone.select("doc_id", "n_bytes", *told).union(copied.select("doc_id", "n_bytes", *told))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", average_bits: int = 10, least: int = 256, most: int = 8192) -> DataFrame:
    """Store every text of docs as media chunks, read them back and compute features.

    doc_id, n_bytes (unpadded), payload_bytes, payload_sha256, tail_crc32 (last 32 payload bytes), media_bytes and
    media_sha256 (chunk list and bodies as stored), feature: a row for each row of docs. A null text is empty: one block
    of filling. A null id stays null; rows that repeat an id stay apart. Equal texts have equal values. Empty table:
    empty result. Other columns are not read.
    """
    space = Workspace(docs.sparkSession, "media")
    lists, chunks = store(docs, space, Chunker(average_bits, least, most), id_col, text_col)
    return load(lists, chunks, space)
