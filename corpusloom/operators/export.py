"""Sinks: metric and similarity tables as CSV-ready rows, bundle payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from .records import shards
from .vectors import extremes


def melt(wide: DataFrame, key: str = "text_id") -> DataFrame:
    """Rows key, metric, value; NaN becomes null."""
    names = [c for c in wide.columns if c != key]
    return wide.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")) for c in names))).alias("x")).select(key, "x.*")


def metrics_table(values: DataFrame, key: str = "text_id", decimals: int = 6) -> DataFrame:
    """One row per text, one column per metric that has a value, trimmed decimals, blank for null."""
    names = [r.metric for r in values.where("value is not null").select("metric").distinct().orderBy("metric").collect()]  # registry-sized
    wide = values.groupBy(key).pivot("metric", names).agg(F.first("value"))
    return wide.select(key, *(F.coalesce(trimmed(F.col(f"`{n}`"), decimals), F.lit("")).alias(n) for n in names))


def similarity_table(vectors: DataFrame, k: int = 100) -> DataFrame:
    """Per text the k closest, then the k farthest: text_id, kind, rank, other, score (4 trimmed decimals)."""
    return extremes(vectors, k).select(F.col("a").alias("text_id"), "kind", "rank", F.col("b").alias("other"), trimmed(F.col("cosine")).alias("score"))


def handle(df: DataFrame) -> DataFrame:
    """Adds handle: from @name or /c/, /user/ links, else the name; ids of channels are not handles."""
    tries = [
        F.regexp_extract(F.coalesce("channel_url", F.lit("")), r"/@([^/?#]+)", 1), F.regexp_extract(F.coalesce("url", F.lit("")), r"/@([^/?#]+)", 1),
        F.regexp_extract(F.coalesce("channel_url", F.lit("")), r"/(?:c|user)/([^/?#]+)", 1), F.regexp_extract(F.coalesce("channel_id", F.lit("")), r"^@(.+)$", 1),
        F.regexp_replace(F.lower(F.coalesce("channel_name", F.lit(""))), r"[^a-z0-9_.-]", ""),
    ]
    ok = [F.when((t != "") & ~t.rlike(r"^UC[A-Za-z0-9_-]{22}$"), t) for t in tries]
    return df.withColumn("handle", F.coalesce(*ok))


def channel_records(videos: DataFrame) -> DataFrame:
    """Per channel its name (of the first row) and videos as (id, date, duration) in order."""
    first = F.min_by("channel_name", F.struct("upload_date", "id"))
    return videos.groupBy("text_id").agg(first.alias("name"), F.array_sort(F.collect_list(F.struct("upload_date", "id", "duration"))).alias("videos"))


def xor_hex(column, key: str):
    """Bytes of a text xor a repeated key, as hex. In the JVM: pairs of hex digits as numbers."""
    h = F.hex(F.encode(column, "UTF-8"))
    k = key.encode()
    n = (F.length(h) / 2).cast("int")
    at = F.sequence(F.lit(0), n - 1)
    keys = F.array(*(F.lit(b) for b in k))
    byte = lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    out = F.transform(at, lambda i: F.lpad(F.lower(F.hex(byte(i).bitwiseXOR(F.get(keys, i % len(k))))), 2, "0"))
    return F.when(n > 0, F.array_join(out, "")).otherwise("")


def bundle(df: DataFrame, key: str, size: int = 40) -> DataFrame:
    """Payloads of ``size`` rows each in the order of ``key``: shard, n, first, payload (JSON array), sha256. Without payload, the manifest."""
    rows = shards(df, key, size).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct(key, *(c for c in df.columns if c != key)))).alias("rows"))  # ``size`` each
    out = rows.select("shard", F.size("rows").cast("long").alias("n"), F.col("rows")[0][key].alias("first"), F.to_json("rows", {"ignoreNullFields": "false"}).alias("payload"))
    return out.withColumn("sha256", F.sha2(F.col("payload").cast("binary"), 256))


def nearest_resolution(variants: DataFrame, target: float = 1.3) -> DataFrame:
    """Rows of the variant whose resolution is nearest to the target; null labels go."""
    best = variants.agg(F.min_by("variant", F.struct(F.abs(F.col("variant") - target), "variant")).alias("variant"))
    return variants.join(F.broadcast(best), "variant").where("label is not null")  # one row


def ranked(df: DataFrame, by: str, score: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
