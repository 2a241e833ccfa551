"""A corpus pipeline: the STAGES are applied to ``documents`` in turn.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, jaccard, lines, pack, toxicity
from corpusloom.llm.common import read, stored, tuned

#: Word shingles of near-duplicate documents, and their least similarity.
SHINGLE, NUM, DEN = 5, 80, 100


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` says the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    tuned(spark)
    return toxicity.keep_clean(docs, toxicity.train_on_labels(docs, read(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; documents stay."""
    tuned(spark)
    return _measured(lines.dedup_lines(docs)).select(*docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    tuned(spark)
    return jaccard.keep_one(docs, size=SHINGLE, num=NUM, den=DEN)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; single passages are cut from the others."""
    tuned(spark)
    return _measured(decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    tuned(spark)
    return pack.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", keep_one_of_group),
    ("benchmark decontamination", drop_benchmark),
    ("packing", pack_sequences),
]
#: SQL can express neither the classifier nor the packing; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
