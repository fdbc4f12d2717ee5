"""Log statements in source files: which lines, at what level, by which API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.functions.config import LEVELS, LOG_C_STYLE
from siltline.functions.lines import Order, matches, split_lines
from siltline.functions.logcalls import LOG_CALLS

from .complexity import by_lang


def log_call(s: Column, lang: str) -> Column:
    """(level, category) of the first pattern that matches, or null."""
    out = F.lit(None).cast("struct<level: string, category: string>")
    for pattern, level, category in reversed(LOG_CALLS[lang]):
        out = F.when(matches(s, pattern), F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"))).otherwise(out)
    return out


def marked_lines(files: DataFrame) -> DataFrame:
    """Lines of files(path, lang, content) that count: not blank, not in a block comment; with commented and call (or null)."""
    s, order = F.col("s"), Order("path")
    lines = split_lines(files.where(F.col("lang").isin(sorted(LOG_CALLS))).select("path", "lang", "content"))
    c_style = F.col("lang").isin(LOG_C_STYLE)
    opens, closes, slashes = s.contains("/*"), s.contains("*/"), s.startswith("//")
    event = F.when(c_style & opens & ~closes & ~slashes, F.lit(1)).when(c_style & closes, F.lit(0))
    commented = F.when(c_style, slashes | (s.startswith("/*") & closes)).otherwise(s.startswith("#"))
    none = F.lit(None).cast("struct<level: string, category: string>")
    call = by_lang(lambda lang: log_call(s, lang), sorted(LOG_CALLS), none)
    # all that a line says by itself comes before the shuffle; of the text, only that of calls is shuffled
    flags = lines.select("path", "lang", "line_no", event.alias("event"), ((s == "") | (c_style & s.startswith("/*") & ~closes)).alias("out"), commented.alias("commented"), call.alias("call"), F.substring(s, 1, 120).alias("text"))
    flags = flags.withColumn("text", F.when(F.col("call").isNotNull(), F.col("text")))
    return flags.withColumn("inside", order.state_before(F.col("event")) == 1).where(~F.col("out") & ~F.col("inside")).drop("event", "out", "inside")


def log_lines(files: DataFrame) -> DataFrame:
    return marked_lines(files).where("call IS NOT NULL").select("path", "lang", "line_no", "call.level", "call.category", F.col("commented").alias("is_commented"), "text")


def log_metrics(files: DataFrame) -> DataFrame:
    """A row for each file, also one without any counted line; active calls by level."""
    active = F.col("call").isNotNull() & ~F.col("commented")
    sums = marked_lines(files).groupBy("path").agg(
        F.count_if(~F.col("commented")).alias("code_lines"), F.count_if(F.col("call").isNotNull()).alias("total_log_lines"), F.count_if(active).alias("active_log_lines"),
        F.count_if(F.col("call").isNotNull() & F.col("commented")).alias("commented_log_lines"), *(F.count_if(active & (F.col("call.level") == v)).alias(f"n_{v}") for v in LEVELS),
    )
    counts = [c for c in sums.columns if c != "path"]
    out = files.select("path", "lang").join(sums, "path", "left").select("path", "lang", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts))
    return out.withColumn("density", F.coalesce(F.try_divide(F.col("active_log_lines") * 100.0, F.col("code_lines")), F.lit(0.0)))
