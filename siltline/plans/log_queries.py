"""Queries over log statements, with their SQL for DuckDB."""

from __future__ import annotations

from siltline.functions.config import LEVELS, LOG_C_STYLE, LOGGING_EXTS, LOGGING_SKIP_DIRS
from siltline.functions.logcalls import LOG_CALLS
from siltline.functions.paths import chosen
from siltline.operators import logs as L
from siltline.operators import rollups as R
from siltline.sources import adapters as a

from .tree_queries import _BEFORE, LABEL, LANG, _by_lang, _chosen, _q, lines_cte


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _call(lang: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(s, {_literal(p)}) THEN '{level}|{category}'" for p, level, category in LOG_CALLS[lang]) + " END"


_C = f"lang IN ({_q(LOG_C_STYLE)})"
CTES = f"""{a.SOURCE_WITH}, files AS (SELECT path, fname, ext, content, {LANG} AS lang FROM source_files WHERE {_chosen(LOGGING_EXTS, LOGGING_SKIP_DIRS)}), {lines_cte()},
g_1 AS (SELECT *, coalesce(last_value(CASE WHEN {_C} AND contains(s, '/*') AND NOT contains(s, '*/') AND s NOT LIKE '//%' THEN 1 WHEN {_C} AND contains(s, '*/') THEN 0 END IGNORE NULLS) {_BEFORE}, 0) = 1 AS inside FROM lines),
g_2 AS (SELECT path, lang, line_no, CASE WHEN {_C} THEN s LIKE '//%' OR (s LIKE '/*%' AND contains(s, '*/')) ELSE s LIKE '#%' END AS commented, {_by_lang(_call, sorted(LOG_CALLS), 'NULL')} AS call, substr(s, 1, 120) AS text FROM g_1 WHERE s <> '' AND NOT inside AND NOT ({_C} AND s LIKE '/*%' AND NOT contains(s, '*/'))),
log_lines AS (SELECT path, lang, line_no, split_part(call, '|', 1) AS level, split_part(call, '|', 2) AS category, commented AS is_commented, text FROM g_2 WHERE call IS NOT NULL),
per_file AS (SELECT path, count(*) FILTER (WHERE NOT commented) AS code_lines, count(call) AS total_log_lines, count(call) FILTER (WHERE NOT commented) AS active_log_lines, count(call) FILTER (WHERE commented) AS commented_log_lines, {", ".join(f"count(*) FILTER (WHERE NOT commented AND call LIKE '{v}|%') AS n_{v}" for v in LEVELS)} FROM g_2 GROUP BY path),
metrics AS (SELECT f.path, f.lang, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("code_lines", "total_log_lines", "active_log_lines", "commented_log_lines", *(f"n_{v}" for v in LEVELS)))}, CASE WHEN coalesce(code_lines, 0) = 0 THEN 0.0 ELSE active_log_lines * 100.0 / code_lines END AS density FROM files f LEFT JOIN per_file USING (path))"""


def sql(body: str) -> str:
    return f"WITH {CTES} {body}"


def files(spark, sf_dir):
    return chosen(a.source_files(spark, sf_dir), True)


def metrics(spark, sf_dir):
    return L.log_metrics(files(spark, sf_dir))


def _m(make):
    return lambda spark, sf_dir: make(metrics(spark, sf_dir))


def _top(column: str, where: str, shown: str) -> str:
    return sql(f"SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY {column} DESC, path) AS INTEGER) AS rank, {shown} FROM metrics WHERE {where}) WHERE rank <= 10")


_SHOWN = ["path", "lang", "code_lines", "active_log_lines", "commented_log_lines", "density"]
_SUMMARY = """SELECT count(*) AS files, count(*) FILTER (WHERE active_log_lines > 0) AS files_with_active, count(*) FILTER (WHERE total_log_lines > 0) AS files_with_any, count(*) FILTER (WHERE commented_log_lines > 0) AS files_with_commented, CAST(sum(code_lines) AS BIGINT) AS code_lines,
  CAST(sum(active_log_lines) AS BIGINT) AS active_log_lines, CAST(sum(commented_log_lines) AS BIGINT) AS commented_log_lines, sum(active_log_lines) * 100.0 / sum(code_lines) AS density_pct, CAST(floor(sum(code_lines) / sum(active_log_lines)) AS BIGINT) AS lines_per_log FROM metrics"""

PLANS = {
    "log_lines": (lambda s, d: L.log_lines(files(s, d)), sql("SELECT * FROM log_lines")),
    "log_metrics_by_file": (metrics, sql("SELECT * FROM metrics")),
    "all_files_logging": (lambda s, d: metrics(s, d).where("total_log_lines > 0").select(*_SHOWN), sql(f"SELECT {', '.join(_SHOWN)} FROM metrics WHERE total_log_lines > 0")),
    "log_summary": (_m(R.log_summary), sql(_SUMMARY)),
    "logs_by_level": (_m(R.logs_by_level), sql("SELECT level, logs, logs / total AS share FROM (" + " UNION ALL ".join(f"SELECT '{v}' AS level, CAST(sum(n_{v}) AS BIGINT) AS logs, sum({' + '.join(f'n_{x}' for x in LEVELS)}) AS total FROM metrics" for v in LEVELS) + ")")),
    "logs_by_category": (lambda s, d: R.logs_by_category(L.log_lines(files(s, d))), sql("SELECT category, count(*) AS logs, count(*) / sum(count(*)) OVER () AS share FROM log_lines WHERE NOT is_commented GROUP BY 1")),
    "logs_by_language": (_m(R.logs_by_language), sql(f"SELECT {LABEL} AS language, count(*) AS files, CAST(sum(code_lines) AS BIGINT) AS code_lines, CAST(sum(active_log_lines) AS BIGINT) AS active_log_lines, CAST(sum(commented_log_lines) AS BIGINT) AS commented_log_lines, CASE WHEN sum(code_lines) = 0 THEN 0.0 ELSE sum(active_log_lines) * 100.0 / sum(code_lines) END AS density_pct FROM metrics GROUP BY 1")),
    "top_files_by_logs": (lambda s, d: R.top(metrics(s, d).where("active_log_lines > 0"), "active_log_lines", *_SHOWN), _top("active_log_lines", "active_log_lines > 0", ", ".join(_SHOWN))),
    "top_files_by_log_density": (lambda s, d: R.top(R.densest(metrics(s, d)), "density", *_SHOWN), _top("density", "active_log_lines > 0 AND code_lines >= 10", ", ".join(_SHOWN))),
    "top_files_by_commented_logs": (lambda s, d: R.top(metrics(s, d).where("commented_log_lines > 0"), "commented_log_lines", *_SHOWN), _top("commented_log_lines", "commented_log_lines > 0", ", ".join(_SHOWN))),
    "log_density_verdict": (_m(R.density_verdict), sql(f"SELECT density_pct, CASE WHEN density_pct < 0.5 THEN 'very_low' WHEN density_pct < 2 THEN 'low' WHEN density_pct < 5 THEN 'moderate' WHEN density_pct < 10 THEN 'high' ELSE 'very_high' END AS verdict FROM ({_SUMMARY})")),
}
