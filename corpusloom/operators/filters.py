"""Filters and limits on files and tokens. Files have text_id, file_id, ord (a string to order by), tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def date_range(df: DataFrame, column: str, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Dates as strings YYYYMMDD, compared as such. Rows without a date go only if a bound is given."""
    if date_from is None and date_to is None:
        return df
    out = df.where(F.col(column).isNotNull() & (F.col(column) != ""))
    if date_from is not None:
        out = out.where(F.col(column) >= date_from)
    return out if date_to is None else out.where(F.col(column) <= date_to)


def duration_range(df: DataFrame, column: str, least: float = 0, most: float = 0) -> DataFrame:
    """A bound of 0 is off. A missing duration is 0 for the least and endless for the most."""
    out = df if not least else df.where(F.coalesce(F.col(column).cast("double"), F.lit(0.0)) >= least)
    return out if not most else out.where(F.coalesce(F.col(column).cast("double"), F.lit(float("inf"))) <= most)


def exclude_live(df: DataFrame) -> DataFrame:
    return df.where(~(F.coalesce("was_live", F.lit(False)) | F.coalesce("is_live", F.lit(False))))


def ignore(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids.select(on).distinct(), on, "left_anti")


def file_limit(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("tokens", F.slice("tokens", 1, n))


def least_tokens(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.size("tokens") >= n)


def least_total(df: DataFrame, n: int, embedding_only: bool = False) -> DataFrame:
    """Files of texts that have ``n`` tokens in all. With ``embedding_only`` the others stay too: ``low_token_text`` says which get vectors but no metrics."""
    total = F.sum(F.size("tokens")).over(Window.partitionBy("text_id"))
    out = df.withColumn("total_tokens", total.cast("long")).withColumn("low_token_text", F.col("total_tokens") < n)
    return out if embedding_only else out.where(~F.col("low_token_text"))


def recent_files(df: DataFrame, n: int) -> DataFrame:
    """The n last files of each text."""
    w = Window.partitionBy("text_id").orderBy(F.desc("ord"), F.desc("file_id"))
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def spans(df: DataFrame) -> DataFrame:
    """Adds start and end: each file's half-open place among its text's tokens, and total."""
    w = Window.partitionBy("text_id").orderBy("ord", "file_id")
    size = df.withColumn("len", F.size("tokens").cast("long")) if "tokens" in df.columns else df
    out = size.withColumn("end", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("start", F.col("end") - F.col("len")).withColumn("total", F.sum("len").over(Window.partitionBy("text_id")))


def first_tokens(df: DataFrame, n: int) -> DataFrame:
    """The first n tokens of each text, file by file: every file keeps what lies in the interval."""
    return _keep(spans(df), F.lit(0), F.lit(n))


def newest_tokens(df: DataFrame, n: int) -> DataFrame:
    """The last n tokens of each text, file by file."""
    return _keep(spans(df), F.col("total") - n, F.col("total"))


def _keep(s: DataFrame, lo: Column, hi: Column) -> DataFrame:
    a, b = F.greatest(F.col("start"), lo.cast("long")), F.least(F.col("end"), hi.cast("long"))
    return s.where((F.col("end") > lo) & (F.col("start") < hi)).withColumn("tokens", F.slice("tokens", (a - F.col("start") + 1).cast("int"), (b - a).cast("int"))).drop("start", "end", "len", "total")


def newest_whole_files(df: DataFrame, target: int) -> DataFrame:
    """Newest files until their tokens reach the target, then cut to the last ``target`` tokens."""
    w = Window.partitionBy("text_id").orderBy(F.desc("ord"), F.desc("file_id")).rowsBetween(Window.unboundedPreceding, -1)
    held = df.withColumn("later", F.coalesce(F.sum(F.size("tokens")).over(w), F.lit(0))).where(F.col("later") < target).drop("later")
    return newest_tokens(held, target)


def texts_of(df: DataFrame) -> DataFrame:
    """Files joined to texts: text_id, tokens in order."""
    s = df.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("ord", "file_id", "tokens"))).alias("files"))
    return s.select("text_id", F.flatten(F.transform("files", lambda f: f["tokens"])).alias("tokens"))


def exportable(df: DataFrame, category: str = "Gaming", least_seconds: int = 480, since: str = "2020-01-01") -> DataFrame:
    """Rows of the category that are long enough, not live, and have a valid date from ``since`` on."""
    day = F.try_to_date(F.when(F.col("upload_date").rlike(r"^\d{8}$"), F.col("upload_date")), "yyyyMMdd")
    return exclude_live(df.where((F.col("category") == category) & (F.col("duration") >= least_seconds) & (day >= F.lit(since).cast("date"))))
