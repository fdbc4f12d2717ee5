"""Modules of paths and their commits of a category."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltline.operators import history as h


def test_modules_of_a_category(spark):
    commits = spark.createDataFrame([(1, "c1", "", "Fix it"), (2, "c2", "", "Add a"), (3, "c3", "", "Add b"), (4, "c4", "", "Docs")], "seq bigint, commit_id string, date_raw string, message string")
    numstat = spark.createDataFrame([(5, "gone", "b/x"), (10, "c2", "a/x"), (11, "c2", "a/y"), (12, "c3", "b/x"), (13, "c4", "a/z"), (14, "c1", "c/d/x"), (15, "c3", "x\n"), (16, "c2", "/y")], "seq bigint, commit_id string, path string")
    got = h.category_per_module(commits, numstat, "feature")
    # a change of a commit that isn't known makes no module earlier, as in the SQL
    assert [tuple(r)[:3] for r in got.orderBy("rank").collect()] == [(1, "a", 1), (2, "b", 1), (3, "(root)", 1), (4, "", 1)]
    plan = h.category_per_module(commits.repartition(2), numstat.repartition(2), "feature")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring_index(") == 1  # modules are made once for commits, first places and the total


def test_module_of(spark):
    rows = spark.createDataFrame([(p,) for p in ["a", "a/b", "/a", "a/", "é/ü/x", "a//b", "a/b\n", "a\n/b", "", None]], "p string")
    want = F.when(F.col("p").contains("/"), F.regexp_extract("p", r"(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit("(root)"))
    assert rows.where(~h.module_of(F.col("p")).eqNullSafe(want)).count() == 0
