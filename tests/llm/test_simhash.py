import numpy as np
import xxhash
from pyspark.sql import types as T

from chronoframe.llm import simhash

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("_text", T.StringType())])


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(ids, prints, most=4):
    least = dict(zip(ids, ids, strict=True))
    changed = True
    near = [(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids[:i]) if (prints[i] ^ prints[j]).bit_count() <= most]
    while changed:
        changed = False
        for a, b in near:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def test_fingerprint_as_slow():
    for text in ("", " \n", "one", "One two THREE", "a b c d", "a b c d e f g a b c d e", "É é x\ty", "x " * 9000):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_gray_rank_orders_by_one_bit():
    codes = np.arange(256, dtype=np.uint64) ^ (np.arange(256, dtype=np.uint64) >> np.uint64(1))
    assert simhash.gray_rank(codes).tolist() == list(range(256))


def test_codes_against_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(9))]))
    group = np.sort(rng.integers(0, 3, len(codes)))
    found = simhash.link_codes(codes, group, 4, at_once=64)
    for g in range(3):
        here = np.flatnonzero(group == g)
        slow = slow_groups(here.tolist(), [int(codes[i]) for i in here])
        pairs = {(found[a] == found[b], slow[a] == slow[b]) for a in here for b in here}
        assert pairs <= {(True, True), (False, False)}


def test_blocks_cover_all_bits_and_lose_no_pair():
    for count in (1, 10**5, 10**8, 10**10):
        cut, lead = simhash.blocks(count, 4)
        assert len(cut) - lead == 4 and sum(w for _, w in cut) == 64


def test_documents_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_CODES", 64)
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    docs = []
    for text in base:
        docs += [text, text.upper()]
        for _ in range(30):
            parts = text.split()
            parts[rng.integers(0, 120)] = "changed"
            docs.append(" ".join(parts))
    docs += ["", None, " \t", "one", "one", "one two"]
    rows = [(i * 3 + 1, t, "x", "y") for i, t in enumerate(docs)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    prints = [slow_fingerprint(t or "") for t in docs]
    slow = slow_groups([r[0] for r in rows], prints)
    assert {k: r["component_id"] for k, r in got.items()} == slow
    assert {k: r["fingerprint"] for k, r in got.items()} == {r[0]: f"{p:016x}" for r, p in zip(rows, prints, strict=True)}


def test_empty_null_ids_and_repeats(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "a b c d e", "", ""), (4, "a b c d e", "", ""), (4, "a b c d e", "", ""), (None, "lonely words here now", "", "")]
    got = sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect() if r["component_id"] is not None)
    assert got == [(False, 4, 4), (False, 4, 4), (True, None, 4)]
    kept = simhash.keep_one(spark.createDataFrame([(7, "a b c d", "p", "q"), (5, "a b c d", "r", "s"), (None, "a b c d", "", "")], DOCS))
    assert sorted((r["doc_id"] or 0, r["fp"]) for r in kept.collect()) == [(0, ""), (5, "r")]


def slow_long(text, width=5):
    words = text.lower().split()
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]).encode() for i in range(max(1, len(words) - width + 1))]
    hashes = [int.from_bytes(xxhash.xxh3_128_digest(s, 42) + xxhash.xxh3_128_digest(s, 43), "big") for s in shingles]
    return sum(1 << (255 - b) for b in range(256) if 2 * sum(h >> (255 - b) & 1 for h in hashes) > len(hashes))


def test_long_fingerprint_as_slow():
    for text in ("", "one", "a b c d e", "a b c d e f g a b", "x y " * 3000):
        assert int.from_bytes(simhash.long_fingerprint(text).tobytes(), "big") == slow_long(text)


def test_bits_of_a_similarity():
    assert simhash.bits_apart(0.8) == 44 and simhash.bits_apart(1.0) == 0


def jaccard(a, b, width=5):
    sets = [{tuple(t.lower().split()[i : i + width]) for i in range(max(1, len(t.split()) - width + 1))} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_groups_of_similar_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_CODES", 64)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(2000)]
    docs, of = [], []
    for g in range(25):
        base = rng.choice(words, 300)
        for changes in (0, 0, 1, 2, 3, 4, 60):
            own = base.copy()
            own[rng.choice(300, changes, replace=False)] = "changed"
            docs.append(" ".join(own))
            of.append((g, changes))
    rows = [(i, t, "", "") for i, t in enumerate(docs)] + [(900, "", "", ""), (901, None, "", ""), (None, "no id here at all", "", "")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[900] == got[901] == 900 and got[None] is None
    alike = [i for i, (_, c) in enumerate(of) if c < 60]
    assert all(got[i] == i for i, (_, c) in enumerate(of) if c == 60)
    assert all(jaccard(docs[of[i][0] * 7], docs[i]) >= 0.8 for i in alike)
    assert np.mean([got[i] == of[i][0] * 7 for i in alike]) > 0.98
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == {r for i, r in got.items() if i is not None} | {None}
    assert simhash.similar_groups(spark.createDataFrame([], DOCS)).collect() == []


def test_a_repeated_line_links_no_unlike_texts(spark):
    rng = np.random.default_rng(8)
    line = "\n" + "all rights to this line are shared" + "\n"
    docs = [" ".join(f"w{i}" for i in rng.choice(50000, 150, replace=False)) + line * 30 for _ in range(12)]
    assert max(jaccard(a, b) for i, a in enumerate(docs) for b in docs[:i]) < 0.1
    rows = [(i, t, "", "") for i, t in enumerate(docs)] + [(50, docs[3] + line * 40, "", "")]
    bits = [int.from_bytes(simhash.long_fingerprint(t).tobytes(), "big") for t in docs]
    assert min((a ^ b).bit_count() for i, a in enumerate(bits) for b in bits[:i]) > simhash.bits_apart(0.8)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: i for i in range(12)} | {50: 3}


def test_sets_against_all_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(0, 40)))).astype("<u8") for _ in range(150)]
    sets += [np.delete(x, rng.integers(0, len(x), 2)) for x in sets if len(x) > 3]
    sets = [x for x in sets if len(x)]
    got = simhash.link_sets(sets, 0.8)
    slow = np.arange(len(sets))
    own = [set(x.tolist()) for x in sets]
    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if len(a & b) >= 0.8 * len(a | b) and slow[i] != slow[j]:
                slow[slow == max(slow[i], slow[j])] = min(slow[i], slow[j])
    assert got.tolist() == slow.tolist() and len(set(got)) < len(sets)


def test_groups_are_those_of_exact_similarity(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_SHINGLES", 200)
    rng = np.random.default_rng(6)
    docs = []
    for g in range(60):  # the last word differs: 0.71 to 0.75, not similar enough
        base = [f"g{g}w{i}" for i in range(10 + g % 2)]
        docs += [" ".join([*base, "x"]), " ".join([*base, "y"])]
    for g in range(60):  # one word more or less at the end: 0.8 and more
        base = [f"h{g}w{i}" for i in range(8 + g % 30)]
        docs += [" ".join(base), " ".join([*base, "more"])]
    for g in range(20):  # chains and larger groups around the limit
        base = rng.choice(5000, 100).astype(str)
        for changes in range(7):
            own = base.copy()
            own[rng.choice(100, changes, replace=False)] = f"c{changes}"
            docs.append(" ".join(own))
    slow = np.arange(len(docs))
    for i, a in enumerate(docs):
        for j, b in enumerate(docs[:i]):
            if slow[i] != slow[j] and jaccard(a, b) >= 0.8:
                slow[slow == max(slow[i], slow[j])] = min(slow[i], slow[j])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(docs)], DOCS)).collect()}
    assert [got[i] for i in range(len(docs))] == slow.tolist()


def test_clashing_and_repeated_ids_lose_no_text_and_leave_no_copy(spark):
    x, y, z = "the first text of a few words", "another text that is not like it", "a third one stands alone here today"
    rows = [(3, x, "a", ""), (7, y, "b", ""), (7, x, "c", ""), (5, z, "d", ""), (5, z, "d", ""), (5, z, "d", ""), (None, "no id and two copies of this", "e", ""), (None, "no id and two copies of this", "e", "")]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect())
    assert kept == [(0, rows[6][1]), (3, x), (5, z), (7, y)]


def test_split_masks_lose_no_pair_and_a_crowded_node_stays_linear(spark, tmp_path):
    from pyspark.sql import functions as F

    from chronoframe.llm.common import Workspace

    rng = np.random.default_rng(9)
    for mask in (0, 0xFFF, 0xF0F0_0000_FFFF_0000):
        masks = simhash.split_masks(mask, 10**6, 4)
        for _ in range(50):
            flips = sum(1 << int(b) for b in rng.choice([b for b in range(64) if not mask >> b & 1], 4, replace=False))
            assert any(flips & m == 0 for m in masks) and all(m & mask == mask for m in masks)
    # 50,000 codes near one, all alike in 24 bits: every tree has them in few upper nodes.
    flips = np.array([sum(1 << int(b) for b in rng.choice(np.arange(24, 64), 6, replace=False)) for _ in range(50_000)], dtype=np.uint64)
    codes = np.unique(np.uint64(0x123456789ABCDEF0) ^ flips).view(np.int64)
    rows = spark.createDataFrame([(int(c), i) for i, c in enumerate(codes)], "fp long, rep long")
    cut, lead = simhash.blocks(len(codes), 4)
    masks = [sum(((1 << w) - 1) << a for a, w in chosen) for chosen in simhash.combinations(cut, lead)]
    nodes = simhash.reduce(simhash.DataFrame.union, simhash.upper_nodes(rows, Workspace(spark, "crowded"), masks, 4))
    sizes = nodes.groupBy("node").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    assert sizes["most"] <= simhash.CELL_CODES and sizes["all"] <= 40 * len(codes)


def test_crowded_nodes_against_all_pairs(spark, monkeypatch):
    from chronoframe.llm.common import Workspace
    from chronoframe.llm.components import components

    monkeypatch.setattr(simhash, "CELL_CODES", 100)
    rng = np.random.default_rng(2)
    flips = [sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 14)), replace=False)) for _ in range(900)]
    codes = sorted({0x0F1E2D3C4B5A6978 ^ f for f in flips})
    rows = spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "fp long, rep long") if max(codes) < 2**63 else spark.createDataFrame([(simhash._signed(c), i) for i, c in enumerate(codes)], "fp long, rep long")
    space = Workspace(spark, "crowded")
    got = {r["u"]: r["m"] for r in components(space.save(simhash.code_links(rows, space), "links"), space).collect()}
    slow = slow_groups(list(range(len(codes))), codes)
    assert {i: got.get(i, i) for i in range(len(codes))} == slow and len(set(slow.values())) > 20


def test_large_groups_and_hot_keys_change_nothing(spark, monkeypatch):
    from chronoframe.llm import common

    docs, rng = [], np.random.default_rng(12)
    for g in range(6):
        base = rng.choice(9000, 60).astype(str)
        for changes in [0, 0, 0, *range(12)]:
            own = base.copy()
            own[rng.choice(60, changes % 4, replace=False)] = f"c{changes}"
            docs.append(" ".join(own) + (" and a longer end" if changes > 6 else ""))
    frame = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(docs)], DOCS)
    slow = np.arange(len(docs))
    for i, a in enumerate(docs):
        for j, b in enumerate(docs[:i]):
            if slow[i] != slow[j] and jaccard(a, b) >= 0.8:
                slow[slow == max(slow[i], slow[j])] = min(slow[i], slow[j])
    monkeypatch.setattr(simhash, "CELL_SHINGLES", 100)
    monkeypatch.setattr(common, "LEAST_HOT", 1)
    monkeypatch.setattr(simhash, "CELL_CODES", 4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame).collect()}
    assert [got[i] for i in range(len(docs))] == slow.tolist()


def test_components_in_one_task_and_by_stars_with_a_hot_centre(spark, monkeypatch, tmp_path):
    from chronoframe.llm import components as c
    from chronoframe.llm.common import Workspace

    rng = np.random.default_rng(1)
    pairs = [(0, i) for i in range(1, 300)] + [(int(a), int(b)) for a, b in rng.integers(300, 900, (250, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    slow = {n: n for p in pairs for n in p}
    for _ in range(60):
        for a, b in pairs:
            slow[a] = slow[b] = min(slow[a], slow[b])
    frame = spark.createDataFrame([*pairs, (5, 5), (None, 3)], "u long, v long")
    for few in (c.FEW, 0):
        monkeypatch.setattr(c, "FEW", few)
        monkeypatch.setattr(c, "LEAST_HOT", 50)
        found = {r["u"]: r["m"] for r in c.components(frame, Workspace(spark, "stars")).collect()}
        assert found == {n: m for n, m in slow.items() if n != m}
