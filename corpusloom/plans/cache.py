"""Metrics kept between runs: only changed texts and metrics not seen before are computed.

The store is a folder of Parquet parts, rows text_id, fingerprint, version, metric, value; each run
appends a part. A text's fingerprint says which files it has, ``VERSION`` how metrics are defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import registry as R

#: Raised when a metric's definition changes, so that what is stored counts as stale.
VERSION = 1
SCHEMA = "text_id string, fingerprint string, version int, metric string, value double"


def fingerprint(ids: Column) -> Column:
    """Of an array of file ids: the digest of them in order, empty for none."""
    return F.when(F.size(ids) == 0, "").otherwise(F.md5(F.array_join(F.sort_array(ids.cast("array<string>")), ",").cast("binary")))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def measure_cached(texts: DataFrame, path: str, names: list[str], registry: dict[str, R.Builder] | None = None) -> DataFrame:
    """Metrics ``names`` of ``texts`` (text_id, fingerprint, tokens): text_id and a column for each.

    Texts with a stored fingerprint get only the metrics that they lack.
    """
    spark = texts.sparkSession
    own = texts.select(F.col("text_id").cast("string").alias("text_id"), "fingerprint", "tokens")
    have = _stored(spark, path).where((F.col("version") == VERSION) & F.col("metric").isin(names))
    known = have.join(own.select("text_id", "fingerprint"), ["text_id", "fingerprint"], "left_semi").groupBy("text_id").agg(F.array_sort(F.collect_set("metric")).alias("have"))
    todo = own.join(known, "text_id", "left").withColumn("have", F.coalesce("have", F.expr("cast(array() as array<string>)")))
    lacking = [tuple(r[0]) for r in todo.select("have").distinct().collect() if len(r[0]) < len(set(names))]  # one for each run before
    for own_names in lacking:
        missing = [n for n in names if n not in own_names]
        part = todo.where(F.col("have") == F.array(*map(F.lit, own_names)).cast("array<string>"))
        made = R.measure(part.select("text_id", "tokens"), missing, registry)
        rows = made.join(part.select("text_id", "fingerprint"), "text_id").select("text_id", "fingerprint", F.lit(VERSION).alias("version"), F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in missing))).alias("x"))
        rows.select("text_id", "fingerprint", "version", "x.*").write.mode("append").parquet(path)
    now = _stored(spark, path).where(F.col("version") == VERSION).join(own.select("text_id", "fingerprint"), ["text_id", "fingerprint"])
    return now.groupBy("text_id").pivot("metric", sorted(set(names))).agg(F.first("value"))
