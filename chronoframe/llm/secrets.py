"""Secret scans by corpus-wide ownership frequency. DataFrame functions only.

Base kinds are matches of fixed patterns. The method adds the kind `owned`: long tokens of letters and digits whose value
occurs under few owners and few repositories of the whole corpus. A value that many owners have is a copied example and
not a live credential; that holds for base spans too, which stay in any case and are counted apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.common import Workspace, fresh, hot_keys, spread_join

#: Kind, pattern, group that holds the value, least length of that group. Kinds in the order of listing.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [
    ("assign", ASSIGN, 2, 6),
    # A maximal run that is too short has no longer match inside it, so the length can stand in the pattern.
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("owned", r"[A-Za-z0-9+/_-]{24,}", 0, 24),
]
BASE = 3
#: An `owned` value has at least so many digits, letters and different characters.
DIGITS, LETTERS, DIFFERENT = 4, 4, 12
#: Characters of the blocks that a text is cut into for masking.
BLOCK = 4096


def _matches(text: Column, number: int) -> Column:
    """All matches of a kind in order: characters between it and the one before, its length, its value. Texts without one cost one search."""
    _, pattern, group, _ = KINDS[number]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    one = lambda gap, m: F.struct(
        F.lit(number).alias("kind"), F.length(gap).alias("gap"), F.length(m).alias("size"), (F.regexp_extract(m, pattern, group) if group else m).alias("value")
    )
    found = F.filter(F.zip_with(between, whole, one), lambda m: m["size"].isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:int,gap:int,size:int,value:string>>"))


def scan(docs: DataFrame, space: Workspace, id_col: str, text_col: str, owner_col: str, repo_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Every row of docs under a number of its own, without text; and its spans (number, kind, start, end, value's digest)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_key"), name(owner_col).alias("owner"), F.sha2(F.concat_ws("\x01", *map(name, repo_cols)), 256).alias("repo"),
        F.concat(*(_matches(text, k) for k in range(len(KINDS)))).alias("found"),
    )
    rows = space.save(rows, "rows")
    order = "PARTITION BY row, m.kind ORDER BY place"
    spans = rows.where(F.size("found") > 0).select("row", "owner", "repo", F.posexplode("found").alias("place", "m"))
    spans = spans.withColumn("end", F.expr(f"sum(m.gap + m.size) OVER ({order} ROWS UNBOUNDED PRECEDING)")).withColumn("start", F.col("end") - F.col("m.size"))
    value = F.col("m.value")
    long_enough = reduce(lambda x, k: x.when(F.col("m.kind") == k, F.length(value) >= KINDS[k][3]), range(1, len(KINDS)), F.when(F.col("m.kind") == 0, F.length(value) >= KINDS[0][3]))
    digits, letters = F.length(F.regexp_replace(value, "[^0-9]", "")), F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    mixed = (digits >= DIGITS) & (letters >= LETTERS) & (F.size(F.array_distinct(F.split(value, ""))) >= DIFFERENT)
    spans = spans.where(long_enough & ((F.col("m.kind") < BASE) | mixed))
    spans = spans.select("row", "owner", "repo", F.col("m.kind").alias("kind"), "start", "end", F.sha2(value, 256).alias("value"))
    return rows.select("row", "doc_id", "text_key"), space.save(spans, "spans")


def ownership(spans: DataFrame) -> DataFrame:
    """value, owners, repos: in how many different owners and repositories each value occurs, over the whole corpus.

    Values are made distinct by owner and repository before the count, so a value in a third of all rows is a few rows.
    """
    places = spans.groupBy("value", "owner", "repo").agg(F.count("*").alias("uses"))
    owners = places.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("uses").alias("uses"))
    return owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("uses").alias("uses"))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), most_owners: int = 2, most_repos: int = 4
) -> DataFrame:
    """For each row of docs: row (its number in this run), doc_id, text_key (the text's XXH64) and spans, an array of (kind, start, end, value digest, owners, repos, live) by start, then kind.

    start and end count code points, end exclusive. Base kinds always stay; `owned` spans are those whose value has at most
    most_owners owners and most_repos repositories and that lie in no base span. live says the same of any span. A null
    text is empty and has no spans; a null owner or repository is one owner or repository of its own; a null id stays null;
    rows that repeat an id are scanned each. Empty table: empty result. Other columns are not read.
    """
    space = Workspace(docs.sparkSession, "secrets")
    rows, spans = scan(docs, space, id_col, text_col, owner_col, list(repo_cols))
    live = (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos)
    owned = space.save(ownership(spans), "owned")
    hot = space.save(hot_keys(owned, ["value"], "uses"), "hot")
    judged = spread_join(spans, owned, ["value"], hot).withColumn("live", live).where((F.col("kind") < BASE) | F.col("live"))
    # Spans in order: one lies in a base span if it ends no later than the furthest of those that begin no later.
    so_far = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.coalesce(F.max(F.when(F.col("kind") < BASE, F.col("end"))).over(so_far), F.lit(-1))
    judged = judged.withColumn("reach", reach).where((F.col("kind") < BASE) | (F.col("reach") < F.col("end")))
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    item = F.struct("start", "kind", "end", "value", "owners", "repos", "live")
    listed = judged.groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("all"))
    named = F.transform("all", lambda x: F.struct(F.element_at(names, x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["owners"].alias("owners"), x["repos"].alias("repos"), x["live"].alias("live")))
    listed = listed.select("row", named.alias("spans"))
    none = F.array().cast(listed.schema["spans"].dataType)
    return rows.join(listed, "row", "left").select("row", "doc_id", "text_key", F.coalesce("spans", none).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """What a report needs of find_secrets: counts by kind, the base spans' SHA-256 and all spans as text."""
    names = [k[0] for k in KINDS[:BASE]]
    base = F.filter("spans", lambda s: s["kind"].isin(names))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of = lambda k: count(lambda s: s["kind"] == k).alias(f"n_{k}")
    return found.select(
        "doc_id", *(of(k) for k in names), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_copied"),
    )


def _cut(blocks: Column, first: Column, after: Column) -> Column:
    """Characters first to after of a text in blocks: only the blocks that they lie in are looked at."""
    block = lambda at: F.floor(at / BLOCK).cast("int")
    own = F.array_join(F.slice(blocks, block(first) + 1, block(after - 1) - block(first) + 1), "")
    return F.when(after > first, F.substr(own, first % BLOCK + 1, after - first)).otherwise("")


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """text with spans (start, end, at: the furthest end before) replaced; its pieces are cut once and joined once."""

    def put(blocks: Column) -> Column:
        piece = lambda s: F.when(s["start"] >= s["at"], F.concat(_cut(blocks, s["at"], s["start"]), F.lit(mask))).otherwise("")
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(spans, piece), ""), _cut(blocks, last, F.length(text)))

    # As a lambda variable the blocks are made once for a text and not once for a piece.
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))), put)[0]


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", count_col: str | None = None, **options) -> DataFrame:
    """docs with each live span of a text replaced by mask. All rows and columns stay, and so do copied examples.

    Overlapping spans become one mask. A text without live spans is as before, null included; rows that repeat an id and
    text are masked alike, a null id is like any other. count_col, where it is given, holds the number of characters and
    follows a changed text. Empty table: empty result. The work grows with a text's length and its number of spans.
    """
    found = find_secrets(docs, id_col, text_col, **options)
    own_id, own_key, own_spans, made = (fresh(docs, c) for c in ("_id", "_key", "_spans", "_masked"))
    live = found.select("doc_id", "text_key", F.filter("spans", lambda s: s["live"]).alias("live")).where(F.size("live") > 0)
    live = live.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", F.explode("live").alias("s"))
    earlier = Window.partitionBy("doc_id", "text_key").orderBy("s.start", "s.end").rowsBetween(Window.unboundedPreceding, -1)
    live = live.withColumn("at", F.coalesce(F.max("s.end").over(earlier), F.lit(0)))
    item = F.struct(*(F.col(f"s.{c}").cast("int").alias(c) for c in ("start", "end")), F.col("at").cast("int").alias("at"))
    live = live.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(item)).alias(own_spans))
    live = live.withColumnsRenamed({"doc_id": own_id, "text_key": own_key})
    text = F.col(f"`{text_col}`")
    # Only texts with a match of some kind can change: the others stay where they lie, so the join moves few texts.
    matched = F.coalesce(reduce(lambda a, b: a | b, (text.rlike(k[1]) for k in KINDS)), F.lit(False))
    same = docs.where(~matched)
    joined = docs.where(matched).join(live, F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))) == F.col(own_key)), "left")
    changed = joined.select("*", F.when(F.col(own_spans).isNotNull(), _masked(text.cast("string"), F.col(own_spans), mask)).alias(made))

    def kept(c: str) -> Column:
        now = {text_col: F.col(made), count_col: F.length(made).cast(docs.schema[c].dataType)}.get(c)
        return F.col(f"`{c}`") if now is None else F.coalesce(now, F.col(f"`{c}`")).alias(c)

    return changed.select(*map(kept, docs.columns)).union(same.select(*(F.col(f"`{c}`") for c in docs.columns)))
