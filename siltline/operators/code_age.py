"""Age of the lines at HEAD by the last change of their file. ``now`` is a parameter, in seconds since 1970."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltline.functions.dates import instant

from .history import exclude_prefix, module_of

YEAR_SECONDS = 31557600.0


def epochs(commits: DataFrame) -> DataFrame:
    return commits.select("seq", "commit_id", F.unix_seconds(instant(F.col("date_raw"))).alias("author_epoch"))


def file_last_modified(commits: DataFrame, numstat: DataFrame) -> DataFrame:
    dated = epochs(commits).where("author_epoch IS NOT NULL").select("commit_id", "author_epoch")
    return numstat.select("path", "commit_id").join(dated, "commit_id").groupBy("path").agg(F.max("author_epoch").alias("last_epoch"))


def mode(commits: DataFrame, now: int) -> DataFrame:
    """One row: days from the oldest commit to now, and how ages are grouped."""
    days = F.floor((F.lit(now) - F.min("author_epoch")) / 86400.0)
    out = epochs(commits).agg(days.alias("repo_span_days"))
    return out.withColumn("grouping_mode", F.when(F.col("repo_span_days") < 183, F.lit("week")).when(F.col("repo_span_days") < 730, F.lit("month")).otherwise(F.lit("year")))


def bucket(epoch: Column, kind: Column, now: int) -> Column:
    """(kind, a, b): ISO year and week, year and month, or years since (24 at most)."""
    at = F.timestamp_seconds(epoch)
    years = F.least(F.floor(F.greatest(F.lit(0.0), (F.lit(now) - epoch) / YEAR_SECONDS)), F.lit(24)).cast("int")
    a = F.when(kind == "week", F.expr("1") * F.extract(F.lit("YEAROFWEEK"), at)).when(kind == "month", F.year(at)).otherwise(years)
    b = F.when(kind == "week", F.weekofyear(at)).when(kind == "month", F.month(at)).otherwise(F.lit(0))
    return F.struct(kind.alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"))


def label(key: Column) -> Column:
    week = F.format_string("ISO week %d-W%02d (last change)", key["a"], key["b"])
    month = F.format_string("%d-%02d (last change)", key["a"], key["b"])
    years = F.when(key["a"] < 24, F.format_string("%d\u2013%d years since last change", key["a"], key["a"] + 1)).otherwise(F.lit("24+ years since last change"))
    return F.when(key["kind"] == "week", week).when(key["kind"] == "month", month).otherwise(years)


def aged(commits: DataFrame, numstat: DataFrame, head: DataFrame, now: int, exclude: list[str]) -> DataFrame:
    """(path, line_count, key): files with lines; the key is null where no date is known."""
    files = exclude_prefix(head, exclude, directories=True).where("line_count > 0")
    last = files.join(file_last_modified(commits, numstat), "path", "left").withColumn("epoch", F.coalesce("last_epoch", "fallback_epoch"))
    return last.crossJoin(F.broadcast(mode(commits, now))).select("path", "line_count", F.when(F.col("epoch").isNotNull(), bucket(F.col("epoch"), F.col("grouping_mode"), now)).alias("key"))  # one row


def buckets(commits: DataFrame, numstat: DataFrame, head: DataFrame, now: int, exclude: list[str] = ()) -> DataFrame:
    """Lines of each bucket in order of its key, and of files without a date ("unknown", last), with the share of all lines."""
    sums = aged(commits, numstat, head, now, list(exclude)).groupBy("key").agg(F.sum("line_count").alias("lines"))
    share = F.col("lines") / F.sum("lines").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("key")))
    return sums.select(place.alias("place"), F.coalesce(F.when(F.col("key").isNotNull(), label(F.col("key"))), F.lit("unknown")).alias("label"), "lines", share.alias("share"))


def top_modules(commits: DataFrame, numstat: DataFrame, head: DataFrame, now: int, n: int = 5, exclude: list[str] = ()) -> DataFrame:
    """The modules with most lines of each bucket; n of 0 or less gives none."""
    sums = aged(commits, numstat, head, now, list(exclude)).where("key IS NOT NULL").groupBy("key", module_of(F.col("path")).alias("module")).agg(F.sum("line_count").alias("lines"), F.min("path").alias("first"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("lines"), F.asc("first")))
    share = F.col("lines") / F.sum("lines").over(Window.partitionBy("key"))
    return sums.withColumn("place", place).withColumn("share_of_bucket", share).where(F.col("place") <= n).select(label(F.col("key")).alias("label"), "place", "module", "lines", "share_of_bucket")
