"""SimHash near-duplicates by a forest of Gray-ordered hierarchical indexes.

Fingerprints are made distinct first. The 64 bits are cut into blocks; for each choice of blocks there is one tree,
whose codes have those blocks as leading bits. Codes that differ in at most `most` bits agree on all bits of at least
one choice, so they lie under the same upper node of that tree: upper nodes are the shuffle keys, and no pair is lost.

Under an upper node codes are sorted by Gray rank. Runs of neighbours become leaves, leaves become nodes, and each node
keeps the bits that all its codes share (mask and pattern). Two nodes are compared by the bits that both share; a child
pair adds only the differences on bits that its parents did not share. A pair of nodes with more than `most` accumulated
differences is dropped with all codes below. A pair of nodes already in one component is dropped, too.

An upper node with very many codes is split by further blocks of the bits that do not lead there yet, as the codes were
split at first. Cells send out one link per code and not all pairs.

similar_groups asks for a Jaccard similarity of 0.8, which is more differing bits than blocks can bear at any size. Its upper
nodes are bands of least hashes (MinHash), which bring such texts together almost surely; under them the same index over
fingerprints of 256 bits drops what is far apart, and every link is then checked on the shingle sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import Workspace, column, free_shuffles, fresh, hot_keys, picked, sliced, spread_join, texts
from chronoframe.llm.components import components, unite

BITS = 64
LEAF, FAN = 16, 8
#: Codes of one cell; upper nodes with more are split.
CELL_CODES = 8192
#: Codes that an upper node should hold on average; the number of blocks follows from it and the corpus's count.
NODE_CODES = 2048


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """64 bits by majority over the XXH64 of word shingles of the text in ASCII lower case; no words: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    count = max(1, len(words) - width + 1)
    starts = [0, *(ends[: count - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[min(width, len(words)) - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, count, 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """id (long) and fp (long, the 64 bits as they are) for each row of docs. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([fingerprint(t, width, seed) for t in texts(batch)], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([column(batch, "_id"), pa.array(found)], names=["id", "fp"])

    return picked(docs, id_col, text_col).mapInArrow(run, "id long, fp long")


def blocks(count: int, most: int) -> tuple[list[tuple[int, int]], int]:
    """(first bit, width) of each block, and how many of them lead in a tree: the fewest blocks that keep upper nodes small."""
    for lead in range(1, BITS - most):
        k = most + lead
        if count / 2 ** (BITS * lead // k) <= NODE_CODES or lead == 4:
            break
    cuts = [round(i * BITS / k) for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)], lead


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _levels(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Nodes of a forest over sorted codes (a row of 64-bit words each), leaves first, one root for each [start, end)."""
    tree = np.repeat(np.arange(len(starts)), -(-(ends - starts) // LEAF))
    number = np.arange(len(tree)) - np.searchsorted(tree, tree)
    first = starts[tree] + number * LEAF
    after = np.minimum(first + LEAF, ends[tree])
    levels = [{"tree": tree, "first": first, "after": after, "all": np.bitwise_and.reduceat(codes, first, axis=0), "any": np.bitwise_or.reduceat(codes, first, axis=0)}]
    while len(levels[-1]["tree"]) > len(starts):
        low = levels[-1]
        head = np.searchsorted(low["tree"], low["tree"])
        cut = np.flatnonzero((np.arange(len(head)) - head) % FAN == 0)
        levels.append({"tree": low["tree"][cut], "first": cut, "after": np.append(cut[1:], len(head)), "all": np.bitwise_and.reduceat(low["all"], cut, axis=0), "any": np.bitwise_or.reduceat(low["any"], cut, axis=0)})
    for level in levels:
        level["mask"] = ~(level["all"] ^ level["any"])
    return levels


def _ones(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=1, dtype=np.int64)


def _children(first: np.ndarray, after: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of children of the node pairs (i, j), i <= j, each unordered pair once; and the pair each comes from."""
    ni, nj = after[i] - first[i], after[j] - first[j]
    size = ni * nj
    of = np.repeat(np.arange(len(i)), size)
    place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    x, y = first[i][of] + place // nj[of], first[j][of] + place % nj[of]
    keep = (i[of] != j[of]) | (x <= y)
    return x[keep], y[keep], of[keep]


def link_codes(codes: np.ndarray, group: np.ndarray, most: int, at_once: int = 1 << 14) -> np.ndarray:
    """For each code the index of a code that stands for its component among the codes of its group.

    codes: uint64, a code or a row of words each; group: equal values are consecutive. Two codes of a group are linked at
    `most` or fewer differing bits.
    """
    codes = codes.reshape(len(codes), -1)
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    ends = np.append(heads[1:], n)
    order = np.lexsort((gray_rank(codes[:, 0]), np.repeat(np.arange(len(heads)), ends - heads)))
    sorted_codes, label = codes[order], np.arange(n)
    levels = _levels(sorted_codes, heads, ends)
    roots = np.arange(len(heads))
    spare = np.zeros((len(heads), codes.shape[1]), dtype=np.uint64)
    stack = [(len(levels) - 1, roots[a : a + at_once], roots[a : a + at_once], spare[a : a + at_once], np.zeros(len(roots[a : a + at_once]), dtype=np.int64)) for a in range(0, len(roots), at_once)]
    while stack:
        depth, i, j, known, gap = stack.pop()
        node = levels[depth]
        both = node["mask"][i] & node["mask"][j]
        gap = gap + _ones((node["all"][i] ^ node["all"][j]) & both & ~known)
        near = gap <= most
        if depth == 0 and near.any():  # a leaf pair that is one component already has nothing to add
            low, high = np.minimum.reduceat(label, node["first"]), np.maximum.reduceat(label, node["first"])
            near &= ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
        i, j, both, gap = i[near], j[near], both[near], gap[near]
        if not len(i):
            continue
        x, y, of = _children(node["first"], node["after"], i, j)
        if depth:
            known, gap = both[of], gap[of]
            for a in range(0, len(x), at_once):
                stack.append((depth - 1, x[a : a + at_once], y[a : a + at_once], known[a : a + at_once], gap[a : a + at_once]))
        else:
            linked = (_ones(sorted_codes[x] ^ sorted_codes[y]) <= most) & (x != y)
            unite(label, x[linked], y[linked])
    out = np.empty(n, dtype=np.int64)
    out[order] = order[label]
    return out


def _cells(batches: Iterator[pa.RecordBatch], words: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, words, rep) sorted by cell: links (u, v) from each rep to the least rep of its component in the cell."""

    def links(cell: np.ndarray, rep: np.ndarray, *code: np.ndarray) -> pa.RecordBatch:
        root = link_codes(np.stack(code, axis=1).view(np.uint64), cell, most)
        least = rep.copy()
        np.minimum.at(least, root, rep)
        u, v = rep, least[root]
        far = u != v
        return pa.RecordBatch.from_arrays([pa.array(u[far]), pa.array(v[far])], names=["u", "v"])

    held: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * (2 + len(words))
    for batch in batches:
        rows = [np.ascontiguousarray(column(batch, c).to_numpy(zero_copy_only=False)) for c in ("cell", "rep", *words)]
        held = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if len(held[0]) >= 1 << 16:  # the last cell can go on in the next batch
            ended = np.flatnonzero(held[0] != held[0][-1])
            if len(ended):
                yield links(*(x[: ended[-1] + 1] for x in held))
                held = [x[ended[-1] + 1 :] for x in held]
    if len(held[0]):
        yield links(*held)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def split_masks(mask: int, count: int, most: int) -> list[int]:
    """Longer masks for a crowded upper node: the bits beyond `mask` are cut into blocks and some of them lead, too.

    Two codes under the node that differ in at most `most` bits agree on all bits of one of these masks: there are `most`
    more blocks than lead. As many lead as bring `count` codes down to half a cell, if their bits are spread evenly.
    """
    left = [b for b in range(BITS) if not mask >> b & 1]
    for lead in range(1, len(left) - most + 1):
        k = most + lead
        if count / 2 ** (len(left) * lead // k) <= CELL_CODES // 2:
            break
    cuts = [round(i * len(left) / k) for i in range(k + 1)]
    own = [sum(1 << b for b in left[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
    return [mask | sum(chosen) for chosen in combinations(own, lead)]


def _under(codes: DataFrame, masks) -> DataFrame:
    """fp, rep, mask, node: each code under one upper node for each of the masks (a column of arrays)."""
    led = codes.select("fp", "rep", F.explode(masks).alias("mask"))
    return led.withColumn("node", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))


def upper_nodes(codes: DataFrame, space: Workspace, masks: list[int], most: int) -> list[DataFrame]:
    """Tables fp, rep, node: upper nodes of at most CELL_CODES codes that bring together all codes at `most` or fewer bits.

    Each mask is a tree. A crowded node is split by further blocks (split_masks), and again until none is: a code is
    sent on once for each choice of blocks and not once for each cell of other codes, so the work grows with the codes. At the end 13
    bits are left, which 8,192 codes can fill; then a node can't be crowded. One row per mask comes to the driver.
    """
    spark = codes.sparkSession
    nodes, out = _under(codes, F.array(*(F.lit(_signed(m)) for m in masks))), []
    for depth in range(BITS):
        sizes = space.save(nodes.groupBy("mask", "node").count().where(F.col("count") > CELL_CODES), f"crowded-{depth}")
        worst = sizes.groupBy("mask").agg(F.max("count").alias("n")).collect()
        if not worst:
            return [*out, nodes.select("fp", "rep", "node")]
        crowded = sizes.select("mask", "node")
        # Crowded nodes are few: each holds more than CELL_CODES codes. The planner sees that by the saved table's size.
        out.append(nodes.join(crowded, ["mask", "node"], "left_anti").select("fp", "rep", "node"))
        level = space.save(nodes.join(crowded, ["mask", "node"], "left_semi").select("fp", "rep", "mask"), f"level-{depth}")
        longer = [(r["mask"], [_signed(m) for m in split_masks(r["mask"] % (1 << 64), r["n"], most)]) for r in worst]
        table = spark.createDataFrame(longer, "mask long, masks array<long>")  # a row per crowded mask
        nodes = _under(level.join(F.broadcast(table), "mask"), F.col("masks"))
    raise AssertionError("a node with all its bits leading holds one code")


def code_links(codes: DataFrame, space: Workspace, most: int = 4) -> DataFrame:
    """Links u, v between rows of codes (fp distinct, rep a distinct long): their closure is that of all pairs at `most` or fewer bits."""
    count = codes.count()
    cut, lead = blocks(count, most)
    masks = [sum(((1 << width) - 1) << first for first, width in chosen) for chosen in combinations(cut, lead)]
    cells = reduce(DataFrame.union, upper_nodes(codes, space, masks, most)).withColumnRenamed("node", "cell")
    # Two nodes of equal hash would only share a cell: their codes are compared bit by bit all the same.
    parts = max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(count * len(masks) / 2_000_000))
    return cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(lambda batches: _cells(batches, ["fp"], most), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, most: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least id reachable over links) for each row of docs.

    Null and empty texts have fingerprint zero and are linked like any other. Each row gives one row; rows that repeat an
    id with another text have the component of their own text, and texts with the same least id count as linked. A row
    without id gets the component of the rows with its fingerprint, null if none has an id. Empty table: empty result.
    Other columns are not read.
    """
    space = Workspace(docs.sparkSession, "simhash")
    marked = space.save(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    codes = space.save(marked.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "codes")
    hot = space.save(hot_keys(codes, ["fp"], "n"), "hot")
    links = space.save(code_links(codes.where("rep is not null").select("fp", "rep"), space, most), "links")
    stars = components(links, space)
    named = codes.join(stars, codes.rep == stars.u, "left").select("fp", F.coalesce("m", "rep").alias("component_id"))
    named = space.save(named, "named")
    free_shuffles(docs.sparkSession)
    return spread_join(marked, named, ["fp"], hot).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Long fingerprints for a similarity: 256 bits, in this many words.
LONG = ["f0", "f1", "f2", "f3"]
#: Differing bits of 256 beyond which texts are no candidates. Texts at a similarity of 0.8 differ in 39 bits on average, very
#: short ones of unequal length in 48, with a standard deviation of 6; unlike texts differ in 128, give or take 8.
LOOSE = 80


def long_fingerprint(text: str, width: int = 5) -> np.ndarray:
    """256 bits as four words, by majority over two 128-bit hashes of each distinct word shingle; no words: zeros."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(len(LONG), dtype="<i8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    count = max(1, len(words) - width + 1)
    shingles = list(dict.fromkeys(joined[a:b] for a, b in zip([0, *(ends[: count - 1] + 1).tolist()], ends[min(width, len(words)) - 1 :].tolist(), strict=True)))
    count = len(shingles)
    digest = xxhash.xxh3_128_digest
    ones = np.zeros(256, dtype=np.int64)
    for at in range(0, count, 2048):
        part = shingles[at : at + 2048]
        raw = b"".join([digest(x, 42) for x in part] + [digest(x, 43) for x in part])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(2, -1, 16), axis=2).sum(axis=1, dtype=np.int64)
        ones += bits.ravel()
    return np.packbits(2 * ones > count).view("<i8")


def bits_apart(similarity: float) -> int:
    """Differing bits of 256 up to which two texts count as this similar (Jaccard): what the angle between them makes one expect, and one standard deviation."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(256 * share + math.sqrt(256 * share * (1 - share)))


#: Bands of a text and hashes of a band: a pair at 0.8 shares no band with a chance of (1 - 0.8^4)^28, 4 in 10^7.
BANDS, BAND_HASHES = 28, 4
#: Shingles of one cell of exact checks; groups of candidates with more are cut into parts of half as many.
CELL_SHINGLES = 4_000_000
_SEEDS = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * BAND_HASHES), dtype=np.uint64)


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """XXH64 of each distinct word shingle of the text in ASCII lower case, sorted; a text of fewer words is one shingle, no words: none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: max(0, len(words) - width)] + 1).tolist()]
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[min(width, len(words)) - 1 :].tolist(), strict=True)], dtype="<u8"))


def bands(shingles: np.ndarray) -> np.ndarray:
    """A hash of each band of the set's least hashes. Two sets share a least hash with a chance of their Jaccard similarity."""
    least = np.full(BANDS * BAND_HASHES, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        x = (shingles[at : at + 1024, None] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0), out=least)
    raw = least.reshape(BANDS, BAND_HASHES)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(raw)], dtype="<u8").view("<i8")


def link_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the least index of its component, where two sets are linked at this Jaccard similarity or more.

    Sets are walked from link to link: each one meets only those not reached yet, so sets close together cost one walk.
    """
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    label = np.arange(len(sets))
    words, flat = np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *sets]), return_inverse=True)
    at = np.append(0, np.cumsum(sizes))
    mark = np.zeros(len(words), dtype=np.int64)
    left = np.arange(len(sets))  # not reached, in order
    while len(left):
        first, left = left[0], left[1:]
        frontier = [first]
        while frontier and len(left):
            i = frontier.pop()
            own = flat[at[i] : at[i + 1]]
            fits = (sizes[left] >= similarity * sizes[i] - 1e-9) & (similarity * sizes[left] - 1e-9 <= sizes[i])
            near = left[fits]
            if not len(near):
                continue
            mark[own] = 1
            n = sizes[near]
            heads = np.cumsum(n) - n
            places = np.arange(int(n.sum())) + np.repeat(at[near] - heads, n)
            both = np.add.reduceat(np.append(mark[flat[places]], 0), heads) * (n > 0)
            mark[own] = 0
            hit = both >= similarity * (sizes[i] + n - both) - 1e-9
            label[near[hit]] = first
            frontier += near[hit].tolist()
            left = left[~np.isin(left, near[hit], assume_unique=True)]
    return label


def _set_cells(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (cell, rep, shingles) sorted by cell: links (u, v) from each rep to the one that stands for its component in the cell."""

    def links(rep: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.array(rep, dtype=np.int64)
        to = ids[link_sets(sets, similarity)] if sets else ids
        far = ids != to
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(to[far])], names=["u", "v"])

    now, rep, sets = None, [], []
    for batch in sliced(batches):
        for cell, r, raw in zip(*(column(batch, c).to_pylist() for c in ("cell", "rep", "shingles")), strict=True):
            if cell != now:
                yield links(rep, sets)
                now, rep, sets = cell, [], []
            rep.append(r)
            sets.append(np.frombuffer(raw, dtype="<u8"))
    yield links(rep, sets)


def _candidates(nodes: DataFrame, codes: DataFrame, space: Workspace) -> DataFrame:
    """Links u, v between texts that share a band and are at most LOOSE bits apart.

    nodes: rep, band, key. codes: rep and the words of LONG. Bands with the same members are looked at once. In a band with
    more than CELL_CODES members all are candidates of the least one: that is more than asked for, and linear.
    """
    told = [F.sum(F.shiftright(F.xxhash64("rep", F.lit(seed)), 20)).alias(f"h{seed}") for seed in (0, 1)]  # of the members
    met = nodes.groupBy("band", "key").agg(F.min("rep").alias("v"), F.count("*").alias("n"), *told).where("n > 1")
    met = met.groupBy("v", "n", "h0", "h1").agg(F.min(F.struct("band", "key")).alias("b"))
    met = space.save(met.select("b.band", "b.key", "v", "n"), "bands")
    hot = space.save(hot_keys(met, ["band", "key"], "n"), "hot-bands")
    members = spread_join(nodes, met, ["band", "key"], hot).withColumn("cell", F.xxhash64("band", "key"))
    members = space.save(members.select("cell", "rep", "v", "n"), "members")
    small = members.where(F.col("n") <= CELL_CODES).select("cell", "rep").join(codes, "rep")  # BANDS rows of a text at most
    small = small.select("cell", "rep", *LONG).repartition("cell").sortWithinPartitions("cell")
    near = small.mapInArrow(lambda batches: _cells(batches, LONG, LOOSE), "u long, v long")
    crowded = members.where((F.col("n") > CELL_CODES) & (F.col("rep") != F.col("v")))
    return near.union(crowded.select(F.col("rep").alias("u"), "v")).distinct()


def _near_first(batches: Iterator[pa.RecordBatch], width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """rep, coarse and size of each text, and whether it is similar to the first text of its group."""
    for batch in sliced(batches):
        near, sizes, known = [], [], ("", np.zeros(0, dtype="<u8"))
        for text, first in zip(texts(batch), texts(batch, "_first"), strict=True):
            if first != known[0]:
                known = (first, shingle_set(first, width))
            own = shingle_set(text, width)
            both = len(np.intersect1d(own, known[1], assume_unique=True))
            near.append(both >= similarity * (len(own) + len(known[1]) - both) - 1e-9)
            sizes.append(len(own))
        kept = [column(batch, c) for c in ("rep", "coarse")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(near, pa.bool_()), pa.array(sizes, pa.int64())], names=["rep", "coarse", "near", "size"])


def _cells_of_large(asked: DataFrame, texts_of: DataFrame, space: Workspace, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """For groups of candidates beyond a cell's size: links u, v to their first texts, and rep, cell for what is left to check.

    asked: rep, coarse, size, salts (parts of half a cell). Each text is held against its group's first one; that takes one
    pass, as each part of a group has the first text beside it. What is similar to it is linked and needs no check against
    the others that are. So pairs of parts are made of the texts that are left, among them and with the others: near copies
    of one text cost one pass and not the square of their number.
    """
    dealt = asked.select("rep", "coarse", F.pmod(F.xxhash64("rep"), "salts").cast("int").alias("salt")).join(texts_of, "rep")
    firsts = asked.where("rep = coarse").select("coarse", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    firsts = firsts.join(texts_of.withColumnRenamed("rep", "coarse").withColumnRenamed("_text", "_first"), "coarse")
    paired = dealt.hint("merge").join(firsts, ["coarse", "salt"]).select("rep", "coarse", "_text", "_first")
    told = space.save(paired.mapInArrow(lambda b: _near_first(b, width, similarity), "rep long, coarse long, near boolean, size long"), "near-first")
    parts = lambda x: F.ceil(2 * F.sum(x) / CELL_SHINGLES).cast("int")
    sizes = told.groupBy("coarse").agg(parts(F.when(~F.col("near"), F.col("size"))).alias("far_parts"), parts(F.when(F.col("near"), F.col("size"))).alias("near_parts"))
    sizes = space.save(sizes.where("far_parts > 0"), "parts")  # a row for each large group that is not settled yet
    left = spread_join(told, sizes, ["coarse"], space.save(hot_keys(told.groupBy("coarse").count().join(sizes.select("coarse"), "coarse"), ["coarse"], "count"), "hot-groups"))
    salt = lambda n: F.pmod(F.xxhash64("rep", F.lit(3)), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    far, near = left.where("not near").withColumn("salt", salt(F.col("far_parts"))), left.where("near")
    among = far.select("rep", "coarse", "salt", F.explode(upto("far_parts")).alias("other"))
    among = among.select("rep", F.xxhash64("coarse", F.lit(0), F.least("salt", "other"), F.greatest("salt", "other")).alias("cell"))
    far_side = far.where("near_parts > 0").select("rep", "coarse", "salt", F.explode(upto("near_parts")).alias("other"))
    near_side = near.select("rep", "coarse", F.explode(upto("far_parts")).alias("salt"), salt(F.col("near_parts")).alias("other"))
    between = far_side.union(near_side).select("rep", F.xxhash64("coarse", F.lit(1), "salt", "other").alias("cell"))
    return told.where("near and rep <> coarse").select(F.col("rep").alias("u"), F.col("coarse").alias("v")), among.union(between)


def _row_groups(rows: DataFrame, space: Workspace, width: int, similarity: float) -> DataFrame:
    """row, id and least (the least row of the group) of rows _row (distinct longs), _id, _text.

    Texts with the same set of shingles are one. The shingle sets of groups of candidates are fetched, and only links with
    the exact similarity stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raw = texts(batch)
            sets = [shingle_set(t, width) for t in raw]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), dtype="<i8").reshape(-1, 2)
            keys = np.concatenate([np.zeros(0, dtype="<i8"), *(bands(x) for x in sets)])
            code = np.array([long_fingerprint(t, width) for t in raw], dtype="<i8").reshape(-1, len(LONG))
            columns = {
                "row": column(batch, "_row"), "id": column(batch, "_id"), "d0": pa.array(digests[:, 0].copy()), "d1": pa.array(digests[:, 1].copy()), "size": pa.array([len(x) for x in sets], pa.int64()),
                "bands": pa.FixedSizeListArray.from_arrays(pa.array(keys), BANDS).cast(pa.list_(pa.int64())), **{name: pa.array(code[:, i].copy()) for i, name in enumerate(LONG)},
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(t, width).tobytes() for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([column(batch, "rep"), column(batch, "cells"), pa.array(sets, pa.binary())], names=["rep", "cells", "shingles"])

    marked = space.save(rows.mapInArrow(run, "row long, id long, d0 long, d1 long, size long, bands array<long>, " + ", ".join(f"{w} long" for w in LONG)), "marked")
    codes = space.save(marked.groupBy("d0", "d1").agg(F.min("row").alias("rep"), F.count("*").alias("n")), "codes")
    copied = space.save(hot_keys(codes, ["d0", "d1"], "n"), "copied")
    # Every text's bands are those of its representative row.
    own = space.save(marked.where("size > 0").join(codes.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), "size", "bands", *LONG), "own")
    links = space.save(_candidates(own.select("rep", F.posexplode("bands").alias("band", "key")), own.select("rep", *LONG), space), "near")
    near = components(links, space.below("near"))
    near = space.save(near.select(F.col("u").alias("rep"), F.col("m").alias("coarse")), "candidates")
    asked = space.save(near.union(near.select(F.col("coarse").alias("rep"), "coarse").distinct()).join(own.select("rep", "size"), "rep"), "asked")
    salts = asked.groupBy("coarse").agg(F.ceil(2 * F.sum("size") / CELL_SHINGLES).cast("int").alias("salts"))
    large = space.save(salts.where("salts > 2"), "large")
    cells, proved = asked.select("rep", F.xxhash64("coarse").alias("cell")), None
    texts_of = rows.select(F.col("_row").alias("rep"), "_text")
    if not large.isEmpty():
        hot = space.save(hot_keys(asked.groupBy("coarse").count(), ["coarse"], "count"), "hot-coarse")
        cells = asked.join(large, "coarse", "left_anti").select("rep", F.xxhash64("coarse").alias("cell"))
        proved, more = _cells_of_large(spread_join(asked, large, ["coarse"], hot.join(large, "coarse", "left_semi")), texts_of, space, width, similarity)
        cells = cells.union(more)
    cells = space.save(cells.groupBy("rep").agg(F.collect_set("cell").alias("cells")), "cells")
    sets = texts_of.hint("merge").join(cells, "rep").select("rep", "cells", "_text").mapInArrow(fetch, "rep long, cells array<long>, shingles binary")
    sets = sets.select("rep", "shingles", F.explode("cells").alias("cell")).repartition("cell").sortWithinPartitions("cell")
    links = sets.mapInArrow(lambda batches: _set_cells(batches, similarity), "u long, v long")
    stars = components(space.save(links if proved is None else links.union(proved), "links"), space)
    named = space.save(codes.join(stars, codes.rep == stars.u, "left").select("d0", "d1", F.coalesce("m", "rep").alias("least")), "named")
    free_shuffles(rows.sparkSession)
    return spread_join(marked.select("row", "id", "d0", "d1"), named, ["d0", "d1"], copied).select("row", "id", "least")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id (the group's least id) of each row of docs: texts whose sets of word shingles have this Jaccard similarity or more are linked.

    Each link is checked on the shingle sets themselves. Texts without words are one group. Rows without id are linked like
    any other; a group without any id has the component null. Empty table: empty result. Other columns are not read.
    """
    space = Workspace(docs.sparkSession, "simhash")
    rows = space.save(picked(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("_row"), "_id", "_text"), "rows")
    groups = space.save(_row_groups(rows, space, width, similarity), "groups")
    ids = groups.groupBy("least").agg(F.min("id").alias("component_id"))
    return groups.join(ids, "least").select(F.col("id").alias("doc_id"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without all but one of each group of similar texts: the row with the least id stays.

    Rows are told apart by a number of their own, so ids may clash or repeat. Beside the row with the least id, one row
    without id stays of each group that has any.
    """
    space = Workspace(docs.sparkSession, "simhash")
    row = fresh(docs, "_row")
    numbered = space.save(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    plain = numbered.select(F.col(row).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    steps = space.below("groups")
    groups = _row_groups(plain, steps, width, similarity)
    first = groups.groupBy("least", F.col("id").isNull().alias("nameless")).agg(F.min(F.struct("id", "row")).alias("first"))
    kept = space.save(first.select(F.col("first.row").alias(row)), "kept")
    steps.drop_all()  # kept is all that the result needs of them
    # kept grows with docs: the same shuffled join at every size, never a broadcast.
    return numbered.hint("merge").join(kept, row, "left_semi").drop(row).select(*(F.col(f"`{c}`") for c in docs.columns))
