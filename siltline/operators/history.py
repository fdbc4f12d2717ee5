"""Analyses of version-control history over commits(seq, commit_id, author, date_raw, message) and numstat(seq, commit_id, adds, dels, path).

Ties are broken by what came first in the log, which ``seq`` keeps. All are aggregations with map-side combine; only the ranks over whole results need one task, after a limit where there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltline.functions.config import BUG, COMMIT_CATEGORIES, FEATURE, MONTHS, REFACTOR
from siltline.functions.dates import month_of, year_of


def module_of(path: Column) -> Column:
    """The directory of a path, "(root)" if it has none."""
    return F.when(path.contains("/"), F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)).otherwise(F.lit("(root)"))


def category_of(message: Column) -> Column:
    """bug_fix, feature, refactoring or other, by the first keyword; of bug and feature the earlier decides."""
    low = F.lower(F.coalesce(message, F.lit("")))
    places = F.array(F.struct(*(F.regexp_instr(low, F.lit(p)).alias(n) for n, p in (("bug", BUG), ("feature", FEATURE)))))

    def decide(x: Column) -> Column:  # bound by a lambda, so that each place is looked for once
        bug, feature = x["bug"], x["feature"]
        return F.when((bug > 0) & ((feature == 0) | (bug <= feature)), F.lit("bug_fix")).when(feature > 0, F.lit("feature")).when(low.rlike(REFACTOR), F.lit("refactoring")).otherwise(F.lit("other"))

    return F.get(F.transform(places, decide), F.lit(0))


def normal_prefixes(patterns: list[str]) -> list[str]:
    """Exclusion prefixes as they are compared: dots and slashes at the beginning go, so "./" excludes everything."""
    return [p.strip().lstrip("./") for p in patterns if p.strip()]


def exclude_prefix(rows: DataFrame, patterns: list[str], directories: bool = False) -> DataFrame:
    """Rows whose path doesn't begin with one of the patterns (nor is the directory itself, if so wanted)."""
    for p in normal_prefixes(patterns):
        rows = rows.where(~(F.col("path").startswith(p) | (F.lit(directories) & (F.col("path") == p.rstrip("/")))))
    return rows


def ranked(rows: DataFrame, *order: Column, limit: int | None = None) -> DataFrame:
    """Rows with their place, from 1; with a limit the first ones only, chosen before anything is gathered."""
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def shares(rows: DataFrame, count: str) -> DataFrame:
    """With each row's share of the total, which is one row."""
    total = rows.agg(F.sum(count).alias("__total"))
    return rows.crossJoin(F.broadcast(total)).withColumn("share", F.col(count) / F.col("__total")).drop("__total")


def ranked_shares(rows: DataFrame, count: str, *order: Column) -> DataFrame:
    """All rows with place and share. They are gathered for their places, so the total is taken there too; for one of its own, they would be made a second time."""
    return ranked(rows, *order).withColumn("share", F.col(count) / F.sum(count).over(Window.partitionBy()))


def totals(commits: DataFrame, numstat: DataFrame) -> DataFrame:
    return commits.agg(F.count_distinct("commit_id").alias("total_commits")).crossJoin(numstat.agg(F.count_distinct("path").alias("total_files")))  # one row each


def file_commits(numstat: DataFrame) -> DataFrame:
    """Different commits of each file, in two steps that share a partitioning by path."""
    once = numstat.groupBy("path", "commit_id").agg(F.min("seq").alias("seq"))
    return once.groupBy("path").agg(F.count("*").alias("commits"), F.min("seq").alias("first_seen"))


def top_files_by_commits(numstat: DataFrame, n: int = 20) -> DataFrame:
    return ranked(file_commits(numstat), F.desc("commits"), F.asc("first_seen"), F.asc("path"), limit=n).select("rank", "path", "commits")


def top_files_by_churn(numstat: DataFrame, n: int = 20) -> DataFrame:
    sums = numstat.groupBy("path").agg(F.sum("adds").alias("adds"), F.sum("dels").alias("dels"), F.min("seq").alias("first_seen")).withColumn("churn", F.col("adds") + F.col("dels"))
    return ranked(sums.where("churn > 0"), F.desc("churn"), F.asc("first_seen"), F.asc("path"), limit=n).select("rank", "path", "adds", "dels", "churn")


def churn_per_commit(numstat: DataFrame) -> DataFrame:
    return numstat.groupBy("commit_id").agg(F.sum("adds").alias("adds"), F.sum("dels").alias("dels"))


def commits_per_author(commits: DataFrame) -> DataFrame:
    return commits.where("author IS NOT NULL").groupBy("author").agg(F.count("*").alias("commits"), F.min("seq").alias("first_seen"))


def top_authors(commits: DataFrame, n: int = 20) -> DataFrame:
    return ranked(shares(commits_per_author(commits), "commits"), F.desc("commits"), F.asc("first_seen"), limit=n).select("rank", "author", "commits", "share")


def categories(commits: DataFrame) -> DataFrame:
    return commits.select("seq", "commit_id", "date_raw", "message", category_of(F.col("message")).alias("category"))


def category_counts(commits: DataFrame) -> DataFrame:
    """All four categories, with zeros."""
    domain = commits.sparkSession.createDataFrame([(c,) for c in COMMIT_CATEGORIES], "category string")
    counted = domain.join(categories(commits).groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("commits"))
    total = F.sum("commits").over(Window.partitionBy())
    return counted.withColumn("share", F.when(total > 0, F.col("commits") / total).otherwise(F.lit(0.0)))


def category_examples(commits: DataFrame, n: int = 3) -> DataFrame:
    """The first messages of each category, cut to 100 characters: n of each partial sort, not of the whole log."""
    place = F.row_number().over(Window.partitionBy("category").orderBy("seq"))
    return categories(commits).withColumn("place", place).where(F.col("place") <= n).select("category", "place", F.substring("message", 1, 100).alias("example"))


def by_year(commits: DataFrame, numstat: DataFrame) -> DataFrame:
    dated = commits.select("commit_id", year_of(F.col("date_raw")).alias("year")).where("year IS NOT NULL")
    joined = dated.join(churn_per_commit(numstat), "commit_id", "left")
    zero = F.lit(0).cast("bigint")
    out = joined.groupBy("year").agg(F.count("*").alias("commits"), F.coalesce(F.sum("adds"), zero).alias("adds"), F.coalesce(F.sum("dels"), zero).alias("dels"))
    return out.withColumn("churn", F.col("adds") + F.col("dels"))


def by_month(commits: DataFrame) -> DataFrame:
    """Bug fixes and features of each month that has any."""
    rows = categories(commits).select(year_of(F.col("date_raw")).alias("year"), month_of(F.col("date_raw")).alias("month"), "category").where("year IS NOT NULL AND month IS NOT NULL AND category IN ('bug_fix', 'feature')")
    out = rows.groupBy("year", "month").agg(F.count_if(F.col("category") == "bug_fix").alias("bug_fixes"), F.count_if(F.col("category") == "feature").alias("features"))
    names = F.element_at(F.array(*map(F.lit, MONTHS)), F.col("month").cast("int"))
    return out.withColumn("label", F.concat_ws("-", "year", names))


def by_year_of_months(commits: DataFrame) -> DataFrame:
    out = by_month(commits).groupBy("year").agg(F.sum("bug_fixes").alias("bug_fixes"), F.sum("features").alias("features"))
    return out.withColumn("ratio", F.when(F.col("features") > 0, F.format_string("%.2f", F.col("bug_fixes") / F.col("features"))).otherwise(F.lit("N/A")))


def module_commits(numstat: DataFrame) -> DataFrame:
    """Each commit of each module once, with its first place in the log."""
    return numstat.groupBy(module_of(F.col("path")).alias("module"), "commit_id").agg(F.min("seq").alias("seq"))


def commits_per_module(numstat: DataFrame) -> DataFrame:
    """Shares are of the sum over modules, so a commit in two modules counts twice."""
    counted = module_commits(numstat).groupBy("module").agg(F.count("*").alias("commits"), F.min("seq").alias("first_seen"))
    return ranked_shares(counted, "commits", F.desc("commits"), F.asc("first_seen"), F.asc("module")).select("rank", "module", "commits", "share")


def category_per_module(commits: DataFrame, numstat: DataFrame, category: str) -> DataFrame:
    """Commits of a category in each module that has any; its place is that of its first commit of any category. Rows are shuffled once by commit, where they become different and meet their category, and then only sums by module."""
    rows = numstat.select(module_of(F.col("path")).alias("module"), "commit_id", "seq").repartition("commit_id")
    once = rows.groupBy("module", "commit_id").agg(F.min("seq").alias("seq"))
    wanted = commits.select("commit_id", (category_of(F.col("message")) == category).alias("wanted"))
    counted = once.join(wanted, "commit_id").groupBy("module").agg(F.count_if("wanted").alias("commits"), F.min("seq").alias("first_seen")).where("commits > 0")
    return ranked_shares(counted, "commits", F.desc("commits"), F.asc("first_seen"), F.asc("module")).select("rank", "module", "commits", "share")
