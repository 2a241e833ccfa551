"""Corpus-wide style measures: distinctive words, function-word profiles, Delta, and their decompositions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import kept
from ..functions.wordlists import FUNCTION_WORDS
from .explore import correlation, normal_cdf

ALPHA, LEAST, FLOOR_RANK = 0.01, 5, 1000


def fighting_words(freq: DataFrame, rank: int = 1, least: int = LEAST, alpha: float = ALPHA) -> DataFrame:
    """For each text the z score and word at ``rank`` (or the last): text_id, z, word. Ties go by the word.

    ``freq`` has text_id, token, f. Nulls where a text has no candidate or nothing to compare with.
    """
    freq = kept(freq, "frequencies")  # read three times
    size = freq.groupBy("text_id").agg(F.sum("f").alias("n"))
    both = size.crossJoin(F.broadcast(size.agg(F.sum("n").alias("all"))))  # one row
    total = freq.groupBy("token").agg(F.sum("f").alias("everywhere"))
    c = freq.where(F.col("f") >= least).join(total, "token").join(both, "text_id").where("all > n")
    v = F.count("*").over(Window.partitionBy("text_id"))
    rest, n_rest = F.col("everywhere") - F.col("f"), F.col("all") - F.col("n")
    odds = F.log((F.col("f") + alpha) / (F.col("n") + alpha * v)) - F.log((rest + alpha) / (n_rest + alpha * v))
    c = c.withColumn("z", odds / F.sqrt(1 / (F.col("f") + alpha) + 1 / (rest + alpha))).withColumn("v", v)
    c = c.withColumn("rn", F.row_number().over(Window.partitionBy("text_id").orderBy(F.round("z", 9).desc(), "token")))
    hit = c.where(F.col("rn") == F.least(F.lit(rank), F.col("v"))).select("text_id", "z", F.col("token").alias("word"))
    return size.select("text_id").join(hit, "text_id", "left")


def profiles(texts: DataFrame) -> DataFrame:
    """Rows text_id, word, rate for every function word of every text with tokens.

    Tokens are counted where they are read, all but the listed words as one; contractions are parted in the counts. Kept as a small table, since it is read several times.
    """
    t = F.col("t")
    e = texts.select("text_id", F.explode_outer("tokens").alias("t")).select("text_id", "t", F.when(t.isin([*FUNCTION_WORDS, *T.CONTRACTIONS]), t).alias("word"))
    e = e.groupBy("text_id", "word").agg(F.count("t").alias("f"))  # a row for each listed word, and one for the others; outer, or a filter on the tokens' number would cut the texts twice
    parted = F.when(F.col("word").isNull(), F.array(F.lit(None).cast("string"))).otherwise(T.expand(F.array("word")))
    e = e.select("text_id", F.explode(parted).alias("w"), "f")
    e = kept(e.groupBy("text_id", F.when(F.col("w").isin(FUNCTION_WORDS), F.col("w")).alias("word")).agg(F.sum("f").alias("f")), "profiles")  # 131 rows a text
    size = e.groupBy("text_id").agg(F.sum("f").alias("n")).where("n > 0")
    grid = size.crossJoin(F.broadcast(texts.sparkSession.createDataFrame([(w,) for w in FUNCTION_WORDS], "word string")))  # 130 words
    return grid.join(e.where("word is not null"), ["text_id", "word"], "left").select("text_id", "word", (F.coalesce("f", F.lit(0)) / F.col("n")).alias("rate"))


def z_scores(profile: DataFrame) -> DataFrame:
    """Adds z over texts (population deviation; 0 becomes 1e-12)."""
    by = profile.groupBy("word").agg(F.avg("rate").alias("mu"), F.stddev_pop("rate").alias("sd"))
    return profile.join(F.broadcast(by), "word").select("text_id", "word", "rate", ((F.col("rate") - F.col("mu")) / F.when(F.col("sd") == 0, 1e-12).otherwise(F.col("sd"))).alias("z"))


def delta_pairs(z: DataFrame, blocks: int | None = None) -> DataFrame:
    """Rows a, b (a < b), delta, burrows_sim: the mean absolute difference of z. Quadratic in texts, as asked for; in blocks, so that no side is broadcast whole."""
    blocks = blocks or max(1, math.isqrt(z.select("text_id").distinct().count() // 250))
    vec = z.groupBy("text_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "z"))), lambda x: x["z"]).alias("v"))  # 130 each
    vec = vec.withColumn("k", F.pmod(F.xxhash64("text_id"), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    x = vec.select(F.col("text_id").alias("a"), F.col("v").alias("va"), "k", every.alias("m"))
    y = vec.select(F.col("text_id").alias("b"), F.col("v").alias("vb"), F.col("k").alias("m"), every.alias("k"))
    d = F.aggregate(F.zip_with("va", "vb", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, e: s + e) / F.size("va")
    return x.join(y, ["k", "m"]).where("a < b").select("a", "b", d.alias("delta")).withColumn("burrows_sim", 1 / (1 + F.col("delta")))


def both_ways(pairs: DataFrame) -> DataFrame:
    other = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.select("a", "b", *other).union(pairs.select("b", "a", *other))


def pair_decomposition(z: DataFrame, a, b) -> DataFrame:
    """Per word: difference, mean z, what drives and shares the two texts, and the share in per cent."""
    x, y = z.where(F.col("text_id") == a).select("word", F.col("z").alias("za")), z.where(F.col("text_id") == b).select("word", F.col("z").alias("zb"))
    w = x.join(y, "word").withColumn("diff", F.abs(F.col("za") - F.col("zb"))).withColumn("mean_z", (F.col("za") + F.col("zb")) / 2)
    same = F.signum("za") == F.signum("zb")
    w = w.withColumn("driver", F.when(same, F.least(F.abs("za"), F.abs("zb")) * F.exp(-F.col("diff"))).otherwise(0.0)).withColumn("shared", F.abs("mean_z") * F.exp(-F.col("diff")))
    total = F.sum("diff").over(Window.partitionBy())  # 130 rows
    return w.withColumn("share", F.when(total > 0, F.col("diff") / total * 100).otherwise(0.0))


def centre_deviation(profile: DataFrame) -> DataFrame:
    """text_id, centre_deviation: mean absolute deviation of a text's rates from the mean profile."""
    mean = profile.groupBy("word").agg(F.avg("rate").alias("mu"))
    return profile.join(F.broadcast(mean), "word").groupBy("text_id").agg(F.avg(F.abs(F.col("rate") - F.col("mu"))).alias("centre_deviation"))  # a row per function word


def cluster_decomposition(z: DataFrame, clusters: DataFrame, against: int | None = None) -> DataFrame:
    """Per cluster and word: mean z, share of the cluster's absolute means, sign, consistency (mean over deviation; 99 if there is none).

    With ``against``, means are differences from those of that cluster, not from the corpus (whose mean z is 0).
    """
    m = z.join(clusters, "text_id").groupBy("cluster", "word").agg(F.avg("z").alias("mean_z"), F.stddev_pop("z").alias("sd"), F.count("*").alias("n"))
    if against is not None:
        other = m.where(F.col("cluster") == against).select("word", F.col("mean_z").alias("other"))
        m = m.where(F.col("cluster") != against).join(F.broadcast(other), "word").withColumn("mean_z", F.col("mean_z") - F.col("other")).drop("other")
    total = F.sum(F.abs("mean_z")).over(Window.partitionBy("cluster"))
    still = F.col("sd") < 1e-12
    return m.select(
        "cluster", "word", "mean_z", F.when(total > 0, F.abs("mean_z") / total * 100).otherwise(0.0).alias("share"), F.signum("mean_z").cast("int").alias("sign"),
        F.when(still & (F.col("mean_z") == 0), 0.0).when(still, 99.0).otherwise(F.abs("mean_z") / F.col("sd")).alias("consistency"),
    )


def rate_context(profile: DataFrame) -> DataFrame:
    """Per text and word: z with a floor on the deviation, empirical percentile."""
    w = Window.partitionBy("word")
    sd = F.greatest(F.stddev_pop("rate").over(w), F.lit(1e-9), F.avg("rate").over(w) * 1e-3)
    return profile.select("text_id", "word", "rate", ((F.col("rate") - F.avg("rate").over(w)) / sd).alias("z"), (F.cume_dist().over(w.orderBy("rate")) * 100).alias("percentile"))


def cluster_rate_context(profile: DataFrame, clusters: DataFrame) -> DataFrame:
    """``rate_context`` with the percentile of a normal distribution, and per cluster and word the mean, deviation and bounds of the rate."""
    c = rate_context(profile).join(clusters, "text_id")
    w = Window.partitionBy("cluster", "word")
    return c.select(
        "text_id", "word", "rate", "z", "percentile", (normal_cdf(F.col("z")) * 100).alias("normal_percentile"), F.avg("rate").over(w).alias("cluster_mean"),
        F.stddev_pop("rate").over(w).alias("cluster_sd"), F.min("rate").over(w).alias("cluster_low"), F.max("rate").over(w).alias("cluster_high"),
    )


def disagreement(pairs: DataFrame) -> DataFrame:
    """1 less Spearman's rho between two distances (columns a, b, x, y; both ways) over each text's peers; null below two peers."""

    def ranks(c: str):
        w = Window.partitionBy("a")
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy("a", c)) - 1) / 2

    r = pairs.withColumn("rx", ranks("x")).withColumn("ry", ranks("y"))
    return r.groupBy("a").agg(F.when(F.count("*") >= 2, 1 - F.coalesce(correlation("rx", "ry"), F.lit(0.0))).alias("burrows_cosine_disagreement")).withColumnRenamed("a", "text_id")


def top_contributors(parts: DataFrame, k: int = 12, *by: str) -> DataFrame:
    """The k words with the greatest share, with rank and cumulative share. Ties by the word."""
    w = Window.partitionBy(*by).orderBy(F.round("share", 9).desc(), "word")
    out = parts.withColumn("rank", F.row_number().over(w)).withColumn("cumulative", F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where(F.col("rank") <= k).select(*by, "rank", "word", "share", "cumulative")


def cluster_summary(z: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, n texts, mean absolute mean z, and whether it holds every text with a profile."""
    m = z.join(clusters, "text_id").groupBy("cluster", "word").agg(F.avg("z").alias("mz"), F.count("*").alias("n"))
    all_ = z.select("text_id").distinct().agg(F.count("*").alias("all"))
    return m.groupBy("cluster").agg(F.max("n").alias("n"), F.avg(F.abs("mz")).alias("mean_abs_z")).crossJoin(F.broadcast(all_)).select(  # one row
        "cluster", "n", "mean_abs_z", (F.col("n") == F.col("all")).alias("whole_corpus")
    )


def aggregated_rate(profile: DataFrame, words: list[str]) -> DataFrame:
    """Sum of the words' rates of each text; null if one is missing."""
    c = profile.where(F.col("word").isin(words)).groupBy("text_id").agg(F.sum("rate").alias("rate"), F.count("rate").alias("n"))
    return c.select("text_id", F.when(F.col("n") == len(set(words)), F.col("rate")).alias("rate"))
