"""Sources: text folders, metadata, ignore lists, subtitles. Paths go through Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranges import numbered
from pyspark.sql import types as Y

#: A bracketed id of eleven characters in a file name.
ID = r"\[([A-Za-z0-9_-]{11})\]"
METADATA = Y.StructType(
    [Y.StructField(c, Y.StringType()) for c in ("id", "title", "url", "upload_date")]
    + [Y.StructField(c, Y.LongType()) for c in ("duration", "view_count", "like_count", "comment_count")]
    + [Y.StructField(c, Y.BooleanType()) for c in ("was_live", "is_live")]
    + [Y.StructField(c, Y.StringType()) for c in ("timestamp", "channel_name", "channel_id", "channel_url")]
    + [Y.StructField("subscriber_count", Y.LongType()), Y.StructField("category", Y.StringType()), Y.StructField("original_timestamp", Y.StringType())]
)


def plain(path: Column) -> Column:
    """A path as Spark reports it, without its escapes."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of ``root/<text>/txt_files/*.txt``: text_id, file_id, file_name, content."""
    df = spark.read.text(f"{root}/*/txt_files/*.txt", wholetext=True)
    name = F.regexp_replace(plain(F.col("_metadata.file_name")), r"\.txt$", "")
    text = F.regexp_extract(plain(F.col("_metadata.file_path")), r"/([^/]+)/txt_files/[^/]+$", 1)
    found = F.regexp_extract(name, ID, 1)
    file_id = F.when(found != "", found).otherwise(F.element_at(F.split(name, r"\."), -1))
    return df.select(text.alias("text_id"), file_id.alias("file_id"), name.alias("file_name"), F.col("value").alias("content")).where(~F.col("text_id").startswith("."))


def directory_documents(spark: SparkSession, root: str, depth: int = 3) -> DataFrame:
    """A text per .txt file down to ``depth`` folders: text_id from its path, content. Long names are cut and hashed."""
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    top = root.rstrip("/").rsplit("/", 1)[-1]
    rel = F.regexp_extract(plain(F.col("_metadata.file_path")), f"/{top}/(.*)$", 1)
    label = F.concat(F.lit("txt_"), F.regexp_replace(F.regexp_replace(rel, r"\.txt$", ""), "/", "__"))
    label = F.when(F.length(label) > 240, F.concat(F.substring(label, 1, 220), F.substring(F.sha2(label.cast("binary"), 256), 1, 16))).otherwise(label)
    out = df.where(F.size(F.split(rel, "/")) - 1 <= depth).select(label.alias("text_id"), rel.alias("source_id"), F.col("value").alias("content"))
    # a label that an earlier path has already gets the number of paths before it
    again = F.row_number().over(Window.partitionBy("text_id").orderBy("source_id")) > 1
    out = numbered(out, "i", "source_id").withColumn("again", again)
    return out.withColumn("text_id", F.when(F.col("again"), F.concat("text_id", F.lit("_"), (F.col("i") - 1).cast("string"))).otherwise(F.col("text_id"))).drop("i", "again")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON arrays; of equal ids in a file the last wins. Numbers that are missing are 0."""
    df = spark.read.schema(METADATA).option("multiLine", True).json(path).withColumn("row", F.monotonically_increasing_id())
    df = df.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("row")))).where("id is not null and rn = 1").drop("row", "rn")
    return df.fillna(0, ["duration", "view_count", "like_count", "comment_count", "subscriber_count"])


def ignore_list(lines: DataFrame, line: str = "line") -> DataFrame:
    """Ids of an ignore list: comments go, links and names give their id of eleven characters."""
    s = F.trim(F.regexp_replace(F.col(line), r"#.*$", ""))
    s = F.regexp_replace(s, r"\.(txt|json)$", "")
    link = F.regexp_extract(s, r"(?:v=|youtu\.be/|/shorts/|/live/|/embed/)([A-Za-z0-9_-]{11})", 1)
    found = F.when(link != "", link).when(F.length(s) >= 10, F.substring(s, 1, 11))
    return lines.select(found.alias("id")).where("id is not null").distinct()


_SKIP = r"^(?:WEBVTT.*|Kind:.*|Language:.*|NOTE.*|STYLE.*|\d+|.*-->.*|\s*)$"
_CENSORED = r"\[\s*__\s*\]"


def clean_subtitles(lines: DataFrame, keep_marks: bool = False, censored: str = "[censored]") -> DataFrame:
    """Lines (file_id, pos, line) of subtitles to text: file_id, content.

    Headers, times and counters go; tags and, unless ``keep_marks``, bracketed marks, entities and
    speaker labels go; white space is joined; a line that repeats the one before it goes.
    """
    s = F.regexp_replace(F.col("line"), r"<[^>]*>", "") if not keep_marks else F.regexp_replace(F.col("line"), r"</?(?:c|color|b|i|u)(?:[.\s][^>]*)?>|<\d[\d:.]*>", "")
    if not keep_marks:
        s = F.regexp_replace(s, _CENSORED, " __censored__ ")
        s = F.regexp_replace(s, r"\[[^\]]*\]", " ")
        s = F.regexp_replace(s, r"&[a-zA-Z]+;|&#\d+;", " ")
        s = F.regexp_replace(s, r"align:\S+|position:\S+", " ")
        s = F.regexp_replace(s, r"^\s*(?:>>\s*)?[A-Z][A-Z ]{0,30}:\s", "")
        s = F.regexp_replace(s, "__censored__", censored)
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    kept = lines.where(~F.col("line").rlike(_SKIP)).select("file_id", "pos", s.alias("line")).where("line <> ''")
    # one file is one task; a file is short
    w = Window.partitionBy("file_id").orderBy("pos")
    kept = kept.withColumn("prev", F.lag("line").over(w)).where("prev is null or line <> prev")
    return kept.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("content"))


def subtitle_lines(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.text(path, wholetext=True)
    name = F.regexp_replace(plain(F.col("_metadata.file_name")), r"\.(vtt|vtx)$", "")
    return df.select(name.alias("file_id"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))


def unconverted(sources: DataFrame, done: DataFrame, name: str = "file_id") -> DataFrame:
    """Sources whose base name has no result yet."""
    return sources.join(done.select(name).distinct(), name, "left_anti")
