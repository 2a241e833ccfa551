"""Subtitle conversion as a stream: each new file of a folder is cleaned once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import clean_subtitles


def convert(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Reads ``source``/*.vtt, writes Parquet rows file_id, content. The checkpoint remembers what is done."""
    raw = spark.readStream.format("text").option("wholetext", True).load(f"{source}/*.vtt")
    raw = raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.vtt$", "").alias("file_id"), "value")

    def batch(df: DataFrame, _: int) -> None:
        lines = df.select("file_id", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
        clean_subtitles(lines).write.mode("append").parquet(target)

    out = raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
