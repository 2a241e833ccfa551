"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, licences, lines, lm, media, oracles, pack, pii, substrings, toxicity
from .common import read


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return media.media_features(media.encode_media(docs)).drop("fingerprints")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.dedup_lines(docs)
    return out.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op3_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pack.pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_on_labels(docs, read(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymise(docs, pii.EXAMPLE_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["kind"]))), ",")
    return out.select("doc_id", F.size("found").cast("long").alias("n_found"), kinds.alias("kinds"), "text", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_line_dedup": op2_line_dedup,
    "op3_interpolated_lm": op3_interpolated_lm,
    "op4_retrieval_packing": op4_retrieval_packing,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_pii_pseudonyms": op9_pii_pseudonyms,
    "op10_licence_scans": op10_licence_scans,
}
#: The others need digests, models or tokenizers that SQL lacks; tests compare them with brute force.
ORACLES: dict[str, str] = {
    "op2_line_dedup": oracles.LINES,
    "op5_ngram_jaccard_join": oracles.JACCARD,
    "op6_substring_dedup": oracles.SUBSTRINGS,
    "op7_benchmark_decontamination": oracles.DECONTAMINATION,
}
