"""Benchmark decontamination with DataFrame functions alone.

Test items are cut into windows of ``WINDOW`` words (a shorter item is one window). The distinct
windows' hashes form a hash set inside the plan (``InSet``) that each document's windows probe in
place, so that no text is shuffled and no window exploded; only hits leave the row, and each is
verified against the window's own words. Above ``MAX_SET`` windows the set would be too large for
a plan: then hashed windows are exploded and joined, and Spark picks the join; rows are the same.

A row is known by its id and words alone, never by its place in a partition, so that a lost task
may run again in any order.

Defined results: words are A-Z lower-cased runs of anything but ASCII non-alphanumerics; null texts
and items have no words; items without words never occur; an empty table of items hits nothing.
Repeated rows and ids, null ones too, each keep their own result row. Items are sorted as strings,
repeated items count once. Other columns, whatever their names, are unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az, stored

WINDOW = 8
#: Most distinct windows in the plan's hash set (8 bytes each).
MAX_SET = 200_000
#: Items that must occur in a document to make it contaminated.
MIN_ITEMS = 2
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), _GAP), "")


def _runs(w: Column, size: int | Column) -> Column:
    """Starts (from 1) of the runs of ``size`` words."""
    return F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _key(start: Column, size: int) -> Column:
    return F.struct(F.lit(size).alias("size"), (start - 1).alias("start"), F.array_join(F.slice("w", start, size), " ").alias("key"))


def _hits(size: int, hashes: list[int]) -> Column:
    """Runs of ``size`` words whose hash is in the set; Catalyst makes the list a hash set."""
    found = F.filter(_runs(F.col("w"), size), lambda i: F.xxhash64(F.slice("w", i, size)).isin(hashes))
    return F.transform(found, lambda i: _key(i, size))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows size, key (the window's words joined by a space), item ids (array of string)."""
    w = items.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(text)).alias("w")).where("size(w) > 0")
    w = w.withColumn("size", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)
    one = w.select("item_id", "size", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("size")), " "))).alias("key"))
    return one.groupBy("size", "key").agg(F.collect_set("item_id").alias("items"))


def scan(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, min_items: int = MIN_ITEMS, max_set: int = MAX_SET,
) -> DataFrame:
    """One row per input row: doc_id, n_words, items (sorted array of string), spans (start, size; from 0), n_hit, contaminated."""
    wins = item_windows(items, item_id, item_text, window)
    keys = wins.select("size", F.xxhash64(F.split("key", " ")).alias("h"))
    sizes = [r[0] for r in keys.select("size").distinct().collect()]  # at most ``window`` of them
    few = keys.limit(max_set + 1).count() <= max_set
    w = words(df[text_col])
    docs = df.select(df[id_col].alias("doc_id"), w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_words"), F.xxhash64("w").alias("h"), "w")
    row = ["doc_id", "n_words", "h"]
    if few:
        hits = [_hits(n, [r.h for r in keys.where(F.col("size") == n).select("h").distinct().collect()]) for n in sorted(sizes)]
        none = F.expr("cast(array() as array<struct<size:int,start:int,key:string>>)")
        found = docs.select(*row, (F.concat(*hits) if hits else none).alias("hits")).select(*row, F.posexplode_outer("hits").alias("at", "x"))
        found = found.select(*row, (F.coalesce("at", F.lit(0)) == 0).cast("long").alias("rows"), "x.*")
        found = found.join(F.broadcast(wins), ["size", "key"], "left").select(*row, "rows", "size", "start", "items")  # at most max_set rows
    else:
        runs = F.flatten(F.array(*(F.transform(_runs(F.col("w"), n), lambda i: _key(i, n)) for n in sizes)))
        every = docs.select(*row, F.explode(runs).alias("x")).select(*row, "x.*").join(wins, ["size", "key"]).select(*row, F.lit(0).cast("long").alias("rows"), "size", "start", "items")
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("size", "int"), ("start", "int"), ("items", "array<string>"))]
        found = docs.select(*row, F.lit(1).cast("long").alias("rows"), *empty).unionAll(every)
    spans = F.array_sort(F.collect_set(F.when(F.col("items").isNotNull(), F.struct("start", "size"))))  # bounded by the words of a text
    out = found.groupBy(*row).agg(F.sum("rows").alias("rows"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = out.select("doc_id", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))  # equal rows as often as they came
    return out.select(
        "doc_id", "n_words", F.size(_covered(F.col("spans"))).cast("long").alias("n_hit"), "items", "spans", (F.size("items") >= min_items).alias("contaminated")
    )


def _covered(spans: Column) -> Column:
    """Places that spans cover, rising."""
    return F.sort_array(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))))


#: Spans up to which found documents are broadcast (about 20 bytes each).
FEW = 1_000_000
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _cut(text: Column, spans: Column) -> Column:
    """The text without the words that spans cover; what stood around them stays. Linear in the text."""
    gaps = F.split(text, _WORD, -1)
    both = F.struct(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("w"), gaps.alias("g"), _covered(spans).alias("c"))

    def runs(x: Column) -> Column:
        c = x["c"]
        first = F.filter(c, lambda p, i: (i == 0) | (F.get(c, i - 1) != p - 1))
        last = F.filter(c, lambda p, i: F.coalesce(F.get(c, i + 1) != p + 1, F.lit(True)))
        whole = F.zip_with(x["w"], F.slice(x["g"], F.lit(2), F.size(x["w"])), lambda w, g: F.concat(w, g))
        return F.struct(whole.alias("w"), x["g"].alias("g"), first.alias("first"), last.alias("last"))

    def join(x: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            since = F.coalesce(F.get(x["last"], i - 1) + 1, F.lit(0))
            kept = F.slice(x["w"], since + 1, p - since)
            return F.concat(F.array_join(kept, ""), F.array_join(F.slice(x["g"], p + 2, F.get(x["last"], i) - p + 1), ""))

        end = F.element_at(x["last"], -1) + 1
        rest = F.slice(x["w"], end + 1, F.greatest(F.size(x["w"]) - end, F.lit(0)))
        return F.concat(x["g"][0], F.array_join(F.transform(x["first"], piece), ""), F.array_join(rest, ""))

    return F.transform(F.transform(F.array(both), runs), join)[0]


def decontaminate(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` without contaminated documents, and without hit words in the others; other columns unchanged.

    What stood around a cut stays. Rows of equal id and text are treated alike; null texts stay null.
    """
    key = F.struct(F.coalesce(df[id_col].cast("string"), F.lit("")).alias("id"), df[id_col].isNull().alias("none"), F.xxhash64(F.coalesce(df[text_col], F.lit(""))).alias("h"))
    hit = scan(df.select(key.alias("key"), df[text_col].alias("text")), items, id_col="key", text_col="text", **options)
    hit = stored(hit.where("n_hit > 0").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("key"), "contaminated", "spans"), "hits")
    side = F.broadcast(hit) if (hit.agg(F.sum(F.size("spans"))).first()[0] or 0) <= FEW else hit
    row = F.struct(*(df[c] for c in df.columns)).alias("row")  # one column: no other name can clash
    one = df.select(row, key.alias("key")).join(side, "key", "left").where("contaminated is null or not contaminated")
    text = F.when(F.col("spans").isNotNull(), _cut(F.col("row")[text_col], F.col("spans"))).otherwise(F.col("row")[text_col])
    return one.select(*((text if c == text_col else F.col("row")[c]).alias(c) for c in df.columns))
