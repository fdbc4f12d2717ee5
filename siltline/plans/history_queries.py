"""Queries over version-control history, with their SQL for DuckDB."""

from __future__ import annotations

from siltline.functions.config import BUG, COMMIT_CATEGORIES, FEATURE, MONTHS, REFACTOR
from siltline.operators import code_age as age
from siltline.operators import history as h
from siltline.sources import adapters as a
from siltline.sources import gitlog

EXCLUDED = ["./docs/", " .github/ ", "vendor"]

CATEGORY = f"""CASE WHEN b > 0 AND (f = 0 OR b <= f) THEN 'bug_fix' WHEN f > 0 THEN 'feature' WHEN regexp_matches(low, '{REFACTOR}') THEN 'refactoring' ELSE 'other' END"""
# the position of the first match: what comes before it, taken off
_FIRST = "CASE WHEN regexp_matches(low, '{0}') THEN length(regexp_extract(low, '^((?s:.*?)){0}', 1)) + 1 ELSE 0 END"
CATEGORIES = f"""categorized AS (SELECT *, {CATEGORY} AS category FROM (SELECT *, {_FIRST.format(BUG)} AS b, {_FIRST.format(FEATURE)} AS f FROM (SELECT *, lower(coalesce(message, '')) AS low FROM commits)))"""
MODULE = "CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '(root)' END"
MODULES = f"modules AS (SELECT {MODULE} AS module, commit_id, min(seq) AS seq FROM numstat GROUP BY 1, 2)"
YEAR = "nullif(regexp_extract(date_raw, '(\\d{4})', 1), '')"
MONTH = "CASE lower(regexp_extract(date_raw, '\\b(" + "|".join(MONTHS) + ")', 1)) " + " ".join(f"WHEN '{m.lower()}' THEN '{i + 1:02d}'" for i, m in enumerate(MONTHS)) + " END"
EPOCH = """CASE WHEN o.o_orderkey % 61 = 0 OR o.o_orderkey % 67 = 0 THEN NULL ELSE CAST(epoch(o.o_orderdate) AS BIGINT) - CAST(epoch(o.o_orderdate) AS BIGINT) % 86400 + (o.o_orderkey % 24) * 3600 + 1815
  - CASE o.o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 19800 ELSE -28800 END END"""
EPOCHS = f"epochs AS (SELECT o.o_orderkey AS seq, 'c' || o.o_orderkey AS commit_id, {EPOCH} AS author_epoch FROM orders o)"
LAST = "last_mod AS (SELECT path, max(author_epoch) AS last_epoch FROM numstat JOIN epochs USING (commit_id) WHERE author_epoch IS NOT NULL GROUP BY path)"


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([a.WITH, *ctes]) + " " + body


def _category_per_module(category: str) -> str:
    return sql(
        f"""SELECT CAST(row_number() OVER (ORDER BY n DESC, first_seen, module) AS INTEGER) AS rank, module, n AS commits, n / sum(n) OVER () AS share FROM
        (SELECT module, count(*) FILTER (WHERE category = '{category}') AS n, min(m.seq) AS first_seen FROM modules m JOIN categorized c USING (commit_id) GROUP BY module) WHERE n > 0""",
        CATEGORIES, MODULES,
    )


MONTHLY = f"""monthly AS (SELECT year, month, count(*) FILTER (WHERE category = 'bug_fix') AS bug_fixes, count(*) FILTER (WHERE category = 'feature') AS features FROM
  (SELECT {YEAR} AS year, {MONTH} AS month, category FROM categorized) WHERE year IS NOT NULL AND month IS NOT NULL AND category IN ('bug_fix', 'feature') GROUP BY 1, 2)"""


def _age_sql(kind: str, now: int, commits: str, exclude: str = "TRUE") -> dict[str, str]:
    key = {"year": f"CAST(least(floor(greatest(0.0, ({now} - e) / 31557600.0)), 24) AS INTEGER)", "month": "year(t) * 100 + month(t)", "week": "isoyear(t) * 100 + week(t)"}[kind]
    label = {
        "year": "CASE WHEN k IS NULL THEN NULL WHEN k < 24 THEN k || '–' || (k + 1) || ' years since last change' ELSE '24+ years since last change' END",
        "month": "(k // 100) || '-' || lpad('' || (k % 100), 2, '0') || ' (last change)'", "week": "'ISO week ' || (k // 100) || '-W' || lpad('' || (k % 100), 2, '0') || ' (last change)'",
    }[kind]
    base = f"""{commits}, aged AS (SELECT path, line_count, CASE WHEN e IS NOT NULL THEN {key} END AS k FROM (SELECT h.path, line_count, coalesce(last_epoch, fallback_epoch) AS e, make_timestamp(CAST(coalesce(last_epoch, fallback_epoch) AS BIGINT) * 1000000) AS t
      FROM heads h LEFT JOIN last_mod USING (path) WHERE line_count > 0 AND {exclude}))"""
    return {
        "buckets": f"WITH {base} SELECT CAST(row_number() OVER (ORDER BY k NULLS LAST) AS INTEGER) AS place, coalesce({label}, 'unknown') AS label, CAST(sum(line_count) AS BIGINT) AS lines, sum(line_count) / sum(sum(line_count)) OVER () AS share FROM aged GROUP BY k",
        "modules": f"""WITH {base} SELECT {label} AS label, CAST(place AS INTEGER) AS place, module, CAST(lines AS BIGINT) AS lines, share_of_bucket FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lines DESC, first) AS place, lines / sum(lines) OVER (PARTITION BY k) AS share_of_bucket FROM
          (SELECT k, {MODULE} AS module, sum(line_count) AS lines, min(path) AS first FROM aged WHERE k IS NOT NULL GROUP BY 1, 2)) WHERE place <= 5""",
    }


_KEEP = "NOT (starts_with(path, 'docs/') OR path = 'docs' OR starts_with(path, 'github/') OR path = 'github' OR starts_with(path, 'vendor') OR path = 'vendor')"
_YEARS = _age_sql("year", a.NOW_EPOCH, f"{a.WITH}, {EPOCHS}, {LAST}, heads AS (SELECT * FROM head_files WHERE {_KEEP.replace('path', 'head_files.path')})")
_LATE = f"epochs AS (SELECT * FROM (SELECT o.o_orderkey AS seq, 'c' || o.o_orderkey AS commit_id, {EPOCH} AS author_epoch FROM orders o WHERE o.o_orderdate >= TIMESTAMP '{a.MONTH_FROM} 00:00:00'))"
_MONTHS = _age_sql("month", a.NOW_EPOCH, f"{a.WITH}, {_LATE}, {LAST}, heads AS (SELECT * FROM head_files)")
_EVENTS = f"""event_commits AS ({a.duck(a.EVENT_COMMITS)}), last_mod AS (SELECT path, max(CAST(epoch(date_trunc('minute', e.ts)) AS BIGINT)) AS last_epoch FROM event_commits c JOIN events e ON e.event_id = c.seq GROUP BY path),
  heads AS (SELECT path, CAST(count(*) AS BIGINT) AS line_count, CAST(NULL AS BIGINT) AS fallback_epoch FROM event_commits GROUP BY path)"""
_WEEKS = _age_sql("week", a.WEEK_NOW_EPOCH, _EVENTS)


def _late(spark, sf_dir):
    orders = a.tables(spark, sf_dir, "orders", "customer")
    return spark.sql(a.COMMITS, orders=orders["orders"].where(f"o_orderdate >= TIMESTAMP '{a.MONTH_FROM} 00:00:00'"), customer=orders["customer"])


def _weekly(make):
    def run(spark, sf_dir):
        from pyspark.sql import functions as F

        rows = a.event_commits(spark, sf_dir)
        head = rows.groupBy("path").agg(F.count("*").alias("line_count")).withColumn("fallback_epoch", F.lit(None).cast("bigint"))
        return make(rows.select("seq", "commit_id", "author", "date_raw", "message"), rows.select("seq", "commit_id", F.lit(1).alias("adds"), F.lit(0).alias("dels"), "path"), head, a.WEEK_NOW_EPOCH)

    return run


def _c(make):
    return lambda spark, sf_dir: make(a.commits(spark, sf_dir))


def _n(make):
    return lambda spark, sf_dir: make(a.numstat(spark, sf_dir))


def _cn(make):
    return lambda spark, sf_dir: make(a.commits(spark, sf_dir), a.numstat(spark, sf_dir))


_COUNTS = "SELECT path, count(DISTINCT commit_id) AS commits, min(seq) AS first_seen FROM numstat GROUP BY path"

# name: (query, SQL or None)
PLANS = {
    "history_totals": (_cn(h.totals), sql("SELECT (SELECT count(DISTINCT commit_id) FROM commits) AS total_commits, (SELECT count(DISTINCT path) FROM numstat) AS total_files")),
    "file_commit_counts": (_n(h.file_commits), sql(_COUNTS)),
    "top_files_by_commits": (_n(h.top_files_by_commits), sql(f"SELECT CAST(row_number() OVER (ORDER BY commits DESC, first_seen, path) AS INTEGER) AS rank, path, commits FROM ({_COUNTS}) ORDER BY rank LIMIT 20")),
    "top_files_by_churn": (_n(h.top_files_by_churn), sql("""SELECT CAST(row_number() OVER (ORDER BY adds + dels DESC, first_seen, path) AS INTEGER) AS rank, path, adds, dels, adds + dels AS churn FROM
      (SELECT path, CAST(sum(adds) AS BIGINT) AS adds, CAST(sum(dels) AS BIGINT) AS dels, min(seq) AS first_seen FROM numstat GROUP BY path) WHERE adds + dels > 0 ORDER BY rank LIMIT 20""")),
    "churn_per_commit": (_n(h.churn_per_commit), sql("SELECT commit_id, CAST(sum(adds) AS BIGINT) AS adds, CAST(sum(dels) AS BIGINT) AS dels FROM numstat GROUP BY 1")),
    "commits_per_author": (_c(h.commits_per_author), sql("SELECT author, count(*) AS commits, min(seq) AS first_seen FROM commits WHERE author IS NOT NULL GROUP BY 1")),
    "top_authors": (_c(h.top_authors), sql("SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, min(seq)) AS INTEGER) AS rank, author, count(*) AS commits, count(*) / sum(count(*)) OVER () AS share FROM commits WHERE author IS NOT NULL GROUP BY author) WHERE rank <= 20")),
    "commit_categories": (lambda s, d: h.categories(a.commits(s, d)).select("seq", "commit_id", "category"), sql("SELECT seq, commit_id, category FROM categorized", CATEGORIES)),
    "commit_category_counts": (_c(h.category_counts), sql(f"""SELECT category, count(commit_id) AS commits, count(commit_id) / sum(count(commit_id)) OVER () AS share FROM (VALUES {", ".join(f"('{c}')" for c in COMMIT_CATEGORIES)}) v(category) LEFT JOIN categorized USING (category) GROUP BY category""", CATEGORIES)),
    "category_examples": (_c(h.category_examples), sql("SELECT category, CAST(place AS INTEGER) AS place, substr(message, 1, 100) AS example FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seq) AS place FROM categorized) WHERE place <= 3", CATEGORIES)),
    "commits_by_year": (_cn(h.by_year), sql(f"""SELECT year, count(*) AS commits, CAST(coalesce(sum(adds), 0) AS BIGINT) AS adds, CAST(coalesce(sum(dels), 0) AS BIGINT) AS dels, CAST(coalesce(sum(adds), 0) + coalesce(sum(dels), 0) AS BIGINT) AS churn FROM
      (SELECT commit_id, {YEAR} AS year FROM commits) LEFT JOIN (SELECT commit_id, sum(adds) AS adds, sum(dels) AS dels FROM numstat GROUP BY 1) USING (commit_id) WHERE year IS NOT NULL GROUP BY 1""")),
    "bugs_vs_features_monthly": (_c(h.by_month), sql("SELECT *, year || '-' || (CASE month " + " ".join(f"WHEN '{i + 1:02d}' THEN '{m}'" for i, m in enumerate(MONTHS)) + " END) AS label FROM monthly", CATEGORIES, MONTHLY)),
    "bugs_vs_features_yearly": (_c(h.by_year_of_months), sql("SELECT year, CAST(sum(bug_fixes) AS BIGINT) AS bug_fixes, CAST(sum(features) AS BIGINT) AS features, CASE WHEN sum(features) > 0 THEN printf('%.2f', CAST(sum(bug_fixes) AS DOUBLE) / sum(features)) ELSE 'N/A' END AS ratio FROM monthly GROUP BY 1", CATEGORIES, MONTHLY)),
    "module_of": (lambda s, d: _modules(s, d), sql(f"SELECT DISTINCT path, {MODULE} AS module FROM numstat")),
    "commits_per_module": (_n(h.commits_per_module), sql("SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, min(seq), module) AS INTEGER) AS rank, module, count(*) AS commits, count(*) / sum(count(*)) OVER () AS share FROM modules GROUP BY module", MODULES)),
    "bugs_per_module": (lambda s, d: h.category_per_module(a.commits(s, d), a.numstat(s, d), "bug_fix"), _category_per_module("bug_fix")),
    "features_per_module": (lambda s, d: h.category_per_module(a.commits(s, d), a.numstat(s, d), "feature"), _category_per_module("feature")),
    "exclude_prefix": (lambda s, d: h.exclude_prefix(a.numstat(s, d), EXCLUDED).groupBy("path").count().withColumnRenamed("count", "changes"), sql("SELECT path, count(*) AS changes FROM numstat WHERE NOT (starts_with(path, 'docs/') OR starts_with(path, 'github/') OR starts_with(path, 'vendor')) GROUP BY 1")),
    "commit_timestamps": (lambda s, d: age.epochs(a.commits(s, d)).where("author_epoch IS NOT NULL").select("commit_id", "author_epoch"), f"WITH {EPOCHS} SELECT commit_id, author_epoch FROM epochs WHERE author_epoch IS NOT NULL"),
    "file_last_modified": (_cn(age.file_last_modified), sql("SELECT * FROM last_mod", EPOCHS, LAST)),
    "code_age_mode": (lambda s, d: age.mode(a.commits(s, d), a.NOW_EPOCH), f"WITH {EPOCHS}, m AS (SELECT CAST(floor(({a.NOW_EPOCH} - min(author_epoch)) / 86400.0) AS BIGINT) AS repo_span_days FROM epochs) SELECT repo_span_days, CASE WHEN repo_span_days < 183 THEN 'week' WHEN repo_span_days < 730 THEN 'month' ELSE 'year' END AS grouping_mode FROM m"),
    "code_age_buckets": (lambda s, d: age.buckets(a.commits(s, d), a.numstat(s, d), a.head_files(s, d), a.NOW_EPOCH, EXCLUDED), _YEARS["buckets"]),
    "code_age_top_modules": (lambda s, d: age.top_modules(a.commits(s, d), a.numstat(s, d), a.head_files(s, d), a.NOW_EPOCH, 5, EXCLUDED), _YEARS["modules"]),
    "code_age_by_month": (lambda s, d: age.buckets(_late(s, d), a.numstat(s, d), a.head_files(s, d), a.NOW_EPOCH), _MONTHS["buckets"]),
    "code_age_by_month_top_modules": (lambda s, d: age.top_modules(_late(s, d), a.numstat(s, d), a.head_files(s, d), a.NOW_EPOCH), _MONTHS["modules"]),
    "code_age_by_week": (_weekly(age.buckets), _WEEKS["buckets"]),
    "code_age_by_week_top_modules": (_weekly(age.top_modules), _WEEKS["modules"]),
    "gitlog_parse_commits": (lambda s, d: gitlog.parse_commits(gitlog.rendered(a.commits(s, d), a.numstat(s, d))).drop("seq"),
        sql("SELECT commit_id, author, date_raw, message FROM commits")),
    "gitlog_parse_numstat": (lambda s, d: gitlog.parse_numstat(gitlog.rendered(a.commits(s, d), a.numstat(s, d))).drop("seq"),
        sql("SELECT commit_id, adds, dels, path FROM numstat WHERE commit_id IN (SELECT commit_id FROM commits)")),
}


def _modules(spark, sf_dir):
    rows = a.numstat(spark, sf_dir).select("path").distinct()
    return rows.withColumn("module", h.module_of(rows["path"]))
