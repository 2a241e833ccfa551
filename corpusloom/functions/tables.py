"""Small tables that are read several times, kept in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df`` written once as Parquet in spark.checkpoint.dir, where it goes with the session; where that is unset, as local masters may have it, a folder of our own."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = f"file://{tempfile.gettempdir()}/corpusloom-checkpoints"
    path = f"{at}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
