"""Project-level figures from file metrics: totals, bands, medians, health, tops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.functions.config import BAND_NAMES, BANDS, CATEGORIES, LEVELS
from siltline.functions.paths import category, label_of

from .history import ranked, shares

COLUMN = {"cc": "cyclomatic", "cog": "cognitive", "nest": "max_nesting", "fn": "functions"}
MARKUP = "lang != 'html'"


def band(value: Column, limits: tuple[int, ...]) -> Column:
    """low, moderate, high, very_high or extreme; a limit belongs to the lower band."""
    return reduce(lambda rest, x: F.when(value <= x[0], F.lit(x[1])).otherwise(rest), reversed(list(zip(limits, BAND_NAMES))), F.lit(BAND_NAMES[-1]))


def bands(metrics: DataFrame, name: str) -> DataFrame:
    """Files of each band of a measure, with zeros, and their share; markup is left out."""
    value = band(F.col(COLUMN[name]), BANDS[name])
    row = metrics.where(MARKUP).agg(F.count("*").alias("all"), *(F.count_if(value == b).alias(b) for b in BAND_NAMES))
    out = row.select("all", F.explode(F.array(*(F.struct(F.lit(i + 1).alias("place"), F.lit(b).alias("band"), F.col(b).alias("files")) for i, b in enumerate(BAND_NAMES)))).alias("x"))
    return out.select("x.*", F.coalesce(F.try_divide(F.col("x.files"), F.col("all")), F.lit(0.0)).alias("share"))


def _mean(column: str, where: str = "TRUE") -> Column:
    return F.coalesce(F.expr(f"avg({column}) FILTER (WHERE {where})"), F.lit(0.0))


def _sum(column: str, where: str = "TRUE") -> Column:
    return F.coalesce(F.expr(f"sum({column}) FILTER (WHERE {where})"), F.lit(0).cast("bigint"))


def summary(metrics: DataFrame) -> DataFrame:
    """One row of totals and means; sizes are of all files, complexity of all but markup."""
    return metrics.agg(
        F.count("*").alias("files"), F.count_if(F.expr(MARKUP)).alias("files_measured"), *(_sum(c).alias(c) for c in ("total_lines", "code_lines", "comment_lines", "blank_lines")),
        F.coalesce(F.try_divide(F.sum("comment_lines") * 100.0, F.sum("code_lines")), F.lit(0.0)).alias("comment_ratio_pct"),
        _sum("cyclomatic", MARKUP).alias("cyclomatic_total"), _mean("cyclomatic", MARKUP).alias("cyclomatic_avg"), _sum("cognitive", MARKUP).alias("cognitive_total"), _mean("cognitive", MARKUP).alias("cognitive_avg"),
        F.coalesce(F.expr(f"max(max_nesting) FILTER (WHERE {MARKUP})"), F.lit(0).cast("bigint")).alias("max_nesting"), F.expr(f"count(*) FILTER (WHERE {MARKUP} AND max_nesting >= 4)").alias("deep_files"),
        _sum("functions", MARKUP).alias("total_functions"), _mean("functions", MARKUP).alias("functions_avg"),
    )


def medians(metrics: DataFrame) -> DataFrame:
    """Upper medians (of an even number the greater middle one) of the four measures."""
    return metrics.where(MARKUP).agg(*(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)").cast("bigint").alias(f"{n}_median") for n, c in COLUMN.items()))


def health(metrics: DataFrame) -> DataFrame:
    """A score from 5 (best) to 1, with its stars and a verdict."""
    one = metrics.agg(
        F.count_if(F.expr(MARKUP)).alias("n"), _mean("cyclomatic", MARKUP).alias("cc"), _mean("cognitive", MARKUP).alias("cog"), F.expr(f"count(*) FILTER (WHERE {MARKUP} AND cyclomatic > 50)").alias("over50"),
        F.expr(f"count(*) FILTER (WHERE {MARKUP} AND cyclomatic > 100)").alias("over100"), F.coalesce(F.expr(f"max(max_nesting) FILTER (WHERE {MARKUP})"), F.lit(0)).alias("nest"),
        F.coalesce(F.try_divide(F.sum("comment_lines") * 100.0, F.sum("code_lines")), F.lit(0.0)).alias("comments"), F.count("*").alias("files"),
    )

    def off(value: Column, *steps: tuple[float, float], low: bool = False) -> Column:
        out = F.lit(0.0)
        for limit, minus in reversed(steps):
            out = F.when(value < limit if low else value > limit, F.lit(minus)).otherwise(out)
        return out

    share = F.coalesce(F.try_divide(F.col("over50").cast("double"), F.col("n")), F.lit(0.0))
    minus = (
        off(F.col("cc"), (20, 1.5), (10, 0.75), (5, 0.25)) + off(F.col("cog"), (30, 1.5), (15, 0.75), (8, 0.25)) + off(share, (0.10, 0.5), (0.05, 0.25))
        + F.when(F.col("over100") >= F.greatest(F.lit(1.0), F.col("n") * 0.02), F.lit(0.25)).otherwise(F.lit(0.0)) + off(F.col("nest"), (9, 0.5), (6, 0.25)) + off(F.col("comments"), (2, 0.5), (5, 0.25), low=True)
    )
    score = F.when(F.col("files") == 0, F.lit(5.0)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.lit(5.0) - minus)))
    out = one.select(F.bround(score, 1).alias("health_score"))
    verdict = F.when(F.col("health_score") >= 4, "good").when(F.col("health_score") >= 3, "fair").when(F.col("health_score") >= 2, "poor").otherwise("bad")
    return out.select("health_score", F.bround("health_score", 0).cast("int").alias("stars"), verdict.alias("verdict"))


def files_by_language(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy(label_of(F.col("lang")).alias("language")).agg(F.count("*").alias("files"))


def file_categories(metrics: DataFrame) -> DataFrame:
    """All six categories, with zeros."""
    domain = metrics.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counted = metrics.groupBy(category(F.col("path"), F.col("lang")).alias("category")).agg(F.count("*").alias("files"))
    return domain.join(counted, "category", "left").select("category", F.coalesce("files", F.lit(0)).alias("files"))


def business_summary(metrics: DataFrame) -> DataFrame:
    some = metrics.where(category(F.col("path"), F.col("lang")) == "business")
    return some.agg(F.count("*").alias("files"), _sum("code_lines").alias("code_lines"), _mean("cyclomatic").alias("cyclomatic_avg"), _mean("cognitive").alias("cognitive_avg"))


def top(rows: DataFrame, column: str, *shown: str, n: int = 10) -> DataFrame:
    """The first n by a measure, ties by place in the tree."""
    ties = [F.asc(c) for c in ("path", "start_line") if c in rows.columns]
    return ranked(rows, F.desc(column), *ties, limit=n).select("rank", *shown)


def log_summary(metrics: DataFrame) -> DataFrame:
    active, code = F.sum("active_log_lines"), F.sum("code_lines")
    return metrics.agg(
        F.count("*").alias("files"), F.count_if(F.col("active_log_lines") > 0).alias("files_with_active"), F.count_if(F.col("total_log_lines") > 0).alias("files_with_any"), F.count_if(F.col("commented_log_lines") > 0).alias("files_with_commented"),
        *(_sum(c).alias(c) for c in ("code_lines", "active_log_lines", "commented_log_lines")), F.coalesce(F.try_divide(active * 100.0, code), F.lit(0.0)).alias("density_pct"),
        F.coalesce(F.floor(F.try_divide(code.cast("double"), active)), F.lit(0)).alias("lines_per_log"),
    )


def logs_by_level(metrics: DataFrame) -> DataFrame:
    row = metrics.agg(*(_sum(f"n_{v}").alias(v) for v in LEVELS))
    out = row.select(F.explode(F.array(*(F.struct(F.lit(v).alias("level"), F.col(v).alias("logs")) for v in LEVELS))).alias("x")).select("x.*")
    total = row.select(reduce(lambda a, b: a + b, map(F.col, LEVELS)).alias("total"))
    return out.crossJoin(F.broadcast(total)).select("level", "logs", F.coalesce(F.try_divide(F.col("logs"), F.col("total")), F.lit(0.0)).alias("share"))  # one row


def logs_by_category(lines: DataFrame) -> DataFrame:
    return shares(lines.where("NOT is_commented").groupBy("category").agg(F.count("*").alias("logs")), "logs")


def logs_by_language(metrics: DataFrame) -> DataFrame:
    out = metrics.groupBy(label_of(F.col("lang")).alias("language")).agg(F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("code_lines", "active_log_lines", "commented_log_lines")))
    return out.withColumn("density_pct", F.coalesce(F.try_divide(F.col("active_log_lines") * 100.0, F.col("code_lines")), F.lit(0.0)))


def density_verdict(metrics: DataFrame) -> DataFrame:
    d = F.col("density_pct")
    words = F.when(d < 0.5, "very_low").when(d < 2, "low").when(d < 5, "moderate").when(d < 10, "high").otherwise("very_high")
    return log_summary(metrics).select("density_pct", words.alias("verdict"))


def densest(metrics: DataFrame) -> DataFrame:
    """Files whose density says something: with active logs and at least ten lines of code."""
    return metrics.where("active_log_lines > 0 AND code_lines >= 10")
