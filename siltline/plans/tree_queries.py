"""Queries over source trees and markup, with their SQL for DuckDB.

The SQL says the same in another way: nesting braces that don't count are found by a join of each such line with the first later line that closes it, and look-arounds, which RE2 lacks, are counted by subtraction.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siltline.functions import patterns as P
from siltline.functions.config import BAND_NAMES, BANDS, BRACE_LANGS, CATEGORIES, GENERATED, INDENT_LANGS, LABELS, LANG_OF_EXT, LOGGING_EXTS, LOGGING_SKIP_DIRS, SKIP_DIRS
from siltline.functions.lines import sequences, split_lines
from siltline.functions.paths import chosen, excluded, known_extension, lang_of, outside_skipped
from siltline.operators import complexity as C
from siltline.operators import functions as E
from siltline.operators import rollups as R
from siltline.sources import adapters as a
from siltline.sources import gitlog

EXCLUDES = ["*.min.js", "core", "SRC/Types/", ".kt", "f3_1.ts", "app/l", "s?c/[!a]*page.go"]


def _q(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _cnt(pattern: str) -> str:
    """Matches of a pattern on s, in SQL."""

    def n(p: str) -> str:
        return f"len(regexp_extract_all(s, '{p}'))"

    special = {
        P.COALESCE: f"({n(r'\?\?')} - {n(r'\?\?=')})", P.LONE_IF: f"({n(r'\bif\s*\(')} - {n(r'\belse\sif\s*\(')})", P.LONE_ELSE: f"({n(r'\belse\b')} - {n(r'\belse\b\s+if')})",
        P.PLAIN_IF: f"({n(r'\bif\b')} - {n(r'\bif\b\s+.+\s+else')})", r"(?<!\bel)" + P.PLAIN_IF: f"({n(r'\bif\b')} - {n(r'\bif\b\s+.+\s+else')})", r"(?<!\bels)\bif\b": n(r"\bif\b"),
    }
    return special.get(pattern) or n(pattern)


def _by_lang(make, langs, default: str = "0") -> str:
    return "CASE lang " + " ".join(f"WHEN '{lang}' THEN {make(lang)}" for lang in langs) + f" ELSE {default} END"


def _lists(which: int, langs) -> str:
    return _by_lang(lambda lang: " + ".join(map(_cnt, P.COMPLEXITY[lang][which])), langs)


def _is_function(langs) -> str:
    def one(lang: str) -> str:
        if lang == "cs":
            return f"CAST(regexp_matches(s, '{P.FUNCTION['cs'].removesuffix(r'(?!.*;\s*$)')}') AND NOT regexp_matches(s, ';\\s*$') AS INT)"
        return f"CAST(regexp_matches(s, '{P.FUNCTION[lang]}') AS INT)"

    return _by_lang(one, [x for x in langs if x in P.FUNCTION])


_RUNS = "(CASE WHEN len({0}) = 0 THEN 0 ELSE 1 + len(list_filter(range(2, len({0}) + 1), lambda i: {0}[i] <> {0}[i - 1])) END)"


def _runs(operators: str) -> str:
    return _RUNS.format(f"regexp_extract_all(s, '{operators}')")


LANG = "CASE lower(ext) " + " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in LANG_OF_EXT.items()) + " ELSE 'unknown' END"
LABEL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " ELSE lang END"
_TAIL = "NOT (" + " OR ".join(f"ends_with(fname, '{t}')" for t in GENERATED) + ")"


def _chosen(exts, dirs) -> str:
    return f"lower(ext) IN ({_q(exts)}) AND {_TAIL} AND NOT list_has_any(string_split(path, '/')[:-2], [{_q(dirs)}])"


FILES = f"files AS (SELECT path, fname, ext, content, {LANG} AS lang FROM source_files WHERE {_chosen(sorted(LANG_OF_EXT), SKIP_DIRS)})"
_WIN = "OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND {})"
_BEFORE, _UNTIL = _WIN.format("1 PRECEDING"), _WIN.format("CURRENT ROW")


def lines_cte(source: str = "files", text: str = "content", name: str = "lines") -> str:
    return f"""{name} AS (SELECT path, lang, line_no, raw, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT path, lang, unnest(string_split({text}, chr(10))) AS raw, CAST(generate_subscripts(string_split({text}, chr(10)), 1) AS INTEGER) AS line_no FROM {source}))"""


def brace_ctes(lines: str, out: str) -> str:
    """CTEs from lines(path, lang, line_no, s) to the metrics of each path."""
    n = out
    return f"""{n}_1 AS (SELECT *, coalesce(last_value(CASE WHEN s LIKE '/*%' AND NOT contains(s, '*/') THEN 1 WHEN contains(s, '*/') THEN 0 END IGNORE NULLS) {_BEFORE}, 0) = 1 AS inside FROM {lines}),
{n}_2 AS (SELECT *, s = '' AS blank, s <> '' AND (inside OR s LIKE '//%' OR s LIKE '/*%' OR (lang = 'php' AND s LIKE '#%')) AS comment FROM {n}_1),
{n}_3 AS (SELECT path, lang, line_no, length(s) - length(replace(s, '{{', '')) AS o, length(s) - length(replace(s, '}}', '')) AS c, {_lists(0, BRACE_LANGS)} AS cc, {_lists(1, BRACE_LANGS)} AS struct, {_lists(2, BRACE_LANGS)} + {_runs(P.BRACE_OPERATORS)} AS flat,
  {_is_function(BRACE_LANGS)} AS fn, regexp_matches(s, '{P.NO_NESTING}') AS plain FROM {n}_2 WHERE NOT blank AND NOT comment),
{n}_4 AS (SELECT *, sum(step) {_UNTIL} AS total FROM (SELECT *, coalesce(lag(o) OVER (PARTITION BY path ORDER BY line_no), 0) - c AS step FROM {n}_3)),
{n}_5 AS (SELECT *, total - least(0, min(total) {_UNTIL}) AS depth FROM {n}_4),
{n}_6 AS (SELECT f.path, f.line_no AS opened, (SELECT min(l.line_no) FROM {n}_5 l WHERE l.path = f.path AND l.line_no > f.line_no AND l.depth <= f.depth) AS closed FROM {n}_5 f WHERE f.plain AND f.o > 0),
{n}_7 AS (SELECT l.path, l.line_no, l.struct * count(*) AS less FROM {n}_5 l JOIN {n}_6 p ON l.path = p.path AND l.line_no > p.opened AND (p.closed IS NULL OR l.line_no < p.closed) WHERE l.struct > 0 GROUP BY l.path, l.line_no, l.struct),
{n}_8 AS (SELECT path, count(*) AS code_lines, 1 + sum(cc) AS cyclomatic, sum(struct * (1 + depth) + flat) AS cog, max(depth + o) AS max_nesting, sum(fn) AS functions FROM {n}_5 GROUP BY path),
{n} AS (SELECT path, t.lang, t.total_lines, coalesce(code_lines, 0) AS code_lines, t.comment_lines, t.blank_lines, CAST(coalesce(cyclomatic, 1) AS BIGINT) AS cyclomatic, CAST(coalesce(cog, 0) - coalesce(less, 0) AS BIGINT) AS cognitive, CAST(coalesce(max_nesting, 0) AS BIGINT) AS max_nesting, CAST(coalesce(functions, 0) AS BIGINT) AS functions
  FROM (SELECT path, lang, count(*) AS total_lines, count(*) FILTER (WHERE comment) AS comment_lines, count(*) FILTER (WHERE blank) AS blank_lines FROM {n}_2 GROUP BY path, lang) t LEFT JOIN {n}_8 USING (path) LEFT JOIN (SELECT path, sum(less) AS less FROM {n}_7 GROUP BY path) USING (path))"""


_TRIPLE = "(contains(s, '\"\"\"') OR contains(s, ''''''''))"
_STARTS = "(s LIKE '\"\"\"%' OR s LIKE '''''''%')"
_TOGGLE = f"(lang = 'py' AND {_STARTS} AND NOT {_TRIPLE.replace('(s,', '(substr(s, 4),')})"
INDENT = f"""i_1 AS (SELECT *, CAST({_TOGGLE} AS INT) AS t, lang = 'py' AND {_TRIPLE} AND NOT {_TOGGLE} AS r FROM lines WHERE lang IN ({_q(INDENT_LANGS)})),
i_2 AS (SELECT *, coalesce(sum(CAST(r AS INT)) {_BEFORE}, 0) AS g FROM i_1),
i_3 AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY path, g ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS doc,
  coalesce(last_value(CASE WHEN lang = 'ruby' AND s LIKE '=begin%' THEN 1 WHEN lang = 'ruby' AND s LIKE '=end%' THEN 0 END IGNORE NULLS) {_BEFORE}, 0) = 1 AS block FROM i_2),
i_4 AS (SELECT *, s = '' AS blank, s <> '' AND (doc OR block OR s LIKE '#%' OR (lang = 'py' AND {_STARTS}) OR (lang = 'ruby' AND s LIKE '=begin%')) AS comment FROM i_3),
i_5 AS (SELECT *, length(raw) - length(regexp_replace(raw, '^\\s+', '')) AS ind FROM i_4 WHERE NOT blank AND NOT comment),
i_6 AS (SELECT *, coalesce(ind // first_value(nullif(ind, 0) IGNORE NULLS) {_UNTIL}, 0) AS nest FROM i_5),
i_7 AS (SELECT path, count(*) AS code_lines, 1 + sum({_lists(0, INDENT_LANGS)}) AS cyclomatic, sum(({_lists(1, INDENT_LANGS)}) * (1 + nest) + {_lists(2, INDENT_LANGS)} + {_by_lang(lambda x: _runs(P.OPERATORS[x]), P.OPERATORS)}) AS cognitive, max(nest) AS max_nesting, sum({_is_function(INDENT_LANGS)}) AS functions FROM i_6 GROUP BY path),
indented AS (SELECT path, t.lang, t.total_lines, coalesce(code_lines, 0) AS code_lines, t.comment_lines, t.blank_lines, CAST(coalesce(cyclomatic, 1) AS BIGINT) AS cyclomatic, CAST(coalesce(cognitive, 0) AS BIGINT) AS cognitive, CAST(coalesce(max_nesting, 0) AS BIGINT) AS max_nesting, CAST(coalesce(functions, 0) AS BIGINT) AS functions
  FROM (SELECT path, lang, count(*) AS total_lines, count(*) FILTER (WHERE comment) AS comment_lines, count(*) FILTER (WHERE blank) AS blank_lines FROM i_4 GROUP BY path, lang) t LEFT JOIN i_7 USING (path))"""


def html_ctes(lines: str, out: str) -> str:
    void = "|".join(C.VOID)
    return f"""h_1 AS (SELECT *, coalesce(last_value(CASE WHEN contains(s, '<!--') AND NOT contains(s, '-->') THEN 1 WHEN contains(s, '-->') THEN 0 END IGNORE NULLS) {_BEFORE}, 0) = 1 AS inside FROM {lines}),
h_2 AS (SELECT *, s = '' AS blank, s <> '' AND (inside OR (contains(s, '<!--') AND NOT contains(s, '-->'))) AS comment FROM h_1),
h_3 AS (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(s, '(?i)</script>') THEN 0 WHEN regexp_matches(s, '(?i)<script[^>]*>') THEN 1 END IGNORE NULLS) {_UNTIL}, 0) = 1 AS script,
  sum(len(list_filter(regexp_extract_all(s, '<\\w+[^>]*>'), lambda x: NOT ends_with(x, '/>') AND NOT regexp_matches(x, '(?i)^<({void})(?:\\W|$)'))) - len(regexp_extract_all(s, '</\\w+>'))) {_UNTIL} AS total FROM h_2 WHERE NOT blank AND NOT comment),
h_4 AS (SELECT *, total - least(0, min(total) {_UNTIL}) AS depth FROM h_3),
h_js AS (SELECT path, 'js' AS lang, line_no, s FROM h_4 WHERE script),
{brace_ctes("h_js", "h_b")},
{out} AS (SELECT t.path, t.lang, t.total_lines, coalesce(d.code_lines, 0) AS code_lines, t.comment_lines, t.blank_lines, coalesce(b.cyclomatic, 0) AS cyclomatic, coalesce(b.cognitive, 0) AS cognitive, CAST(coalesce(d.max_nesting, 0) AS BIGINT) AS max_nesting, CAST(0 AS BIGINT) AS functions
  FROM (SELECT path, lang, count(*) AS total_lines, count(*) FILTER (WHERE comment) AS comment_lines, count(*) FILTER (WHERE blank) AS blank_lines FROM h_2 GROUP BY path, lang) t
  LEFT JOIN (SELECT path, count(*) AS code_lines, max(depth) AS max_nesting FROM h_4 GROUP BY path) d USING (path) LEFT JOIN h_b b USING (path))"""


METRICS = f"""{a.SOURCE_WITH}, {FILES}, {lines_cte()}, b_lines AS (SELECT * FROM lines WHERE lang NOT IN ({_q([*INDENT_LANGS, 'html'])})), {brace_ctes("b_lines", "braced")}, {INDENT}, h_lines AS (SELECT * FROM lines WHERE lang = 'html'), {html_ctes("h_lines", "marked")},
metrics AS (SELECT * FROM braced UNION ALL SELECT * FROM indented UNION ALL SELECT * FROM marked)"""


def sql(body: str) -> str:
    return f"WITH {METRICS} {body}"


CATEGORY = """CASE WHEN regexp_matches(lower(path), '_test\\.|\\.test\\.|/test/|/__tests__/|test\\.java|tests\\.cs') THEN 'test' WHEN lang = 'html' THEN 'markup' WHEN regexp_matches(lower(path), 'types\\.tsx?$|/types/') THEN 'types'
  WHEN regexp_matches(lower(path), '(config\\.(tsx?|m?js|cs)|startup\\.cs|program\\.cs)$|setup') THEN 'config' WHEN contains(lower(path), '/ui/') THEN 'ui' ELSE 'business' END"""
_OUT = "lang <> 'html'"


def _bands(name: str) -> str:
    limits = [-1, *BANDS[name], 1 << 40]
    rows = " UNION ALL ".join(f"SELECT {i + 1} AS place, '{b}' AS band, count(*) FILTER (WHERE v > {limits[i]} AND v <= {limits[i + 1]}) AS files, count(*) AS n FROM v" for i, b in enumerate(BAND_NAMES))
    return f"WITH {METRICS}, v AS (SELECT {R.COLUMN[name]} AS v FROM metrics WHERE {_OUT}) SELECT place, band, files, CASE WHEN n = 0 THEN 0.0 ELSE files / n END AS share FROM ({rows})"


def _top(column: str, shown: str, where: str = _OUT) -> str:
    return sql(f"SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY {column} DESC, path) AS INTEGER) AS rank, {shown} FROM metrics WHERE {where}) WHERE rank <= 10")


def files(spark, sf_dir):
    return chosen(a.source_files(spark, sf_dir))


def metrics(spark, sf_dir):
    return C.file_metrics(files(spark, sf_dir))


def _lines(spark, sf_dir, where: str):
    return split_lines(files(spark, sf_dir).where(where).select("path", "lang", "content"))


def pages(spark, sf_dir):
    return spark.sql("SELECT url || '#' || page_id AS path, 'html' AS lang, html AS content FROM {pages}", **a.tables(spark, sf_dir, "pages"))


PAGES = "pages_in AS (SELECT url || '#' || page_id AS path, 'html' AS lang, html AS content FROM pages)"


def functions_found(spark, sf_dir):
    return E.function_metrics(files(spark, sf_dir))


def _m(make):
    return lambda spark, sf_dir: make(metrics(spark, sf_dir))


def _sequence_counts(spark, sf_dir):
    lines = split_lines(files(spark, sf_dir).select("path", "lang", "content"))
    return lines.select("path", "line_no", sequences(lines["s"], P.BRACE_OPERATORS).alias("brace"), sequences(lines["s"], P.OPERATORS["py"]).alias("python"), sequences(lines["s"], P.OPERATORS["ruby"]).alias("ruby"))


def _line_counts(spark, sf_dir):
    docs = a.tables(spark, sf_dir, "documents")["documents"].select("doc_id", "text")
    lines = split_lines(docs, "text")
    return lines.groupBy("doc_id").agg(F.count("*").alias("total_lines"), F.count_if(F.col("s") == "").alias("blank_lines"))


def _function_counts(spark, sf_dir):
    lines = split_lines(files(spark, sf_dir).select("path", "lang", "content"))
    return lines.withColumn("f", C._is_function([*BRACE_LANGS, *INDENT_LANGS])).groupBy("path", "lang").agg(F.sum("f").cast("bigint").alias("declarations"))


def _py_nesting(spark, sf_dir):
    lines = split_lines(files(spark, sf_dir).where("lang = 'py'").select("path", "lang", "content"))
    return C.indent_lines(lines, "path").where("code").select("path", "line_no", F.col("nest").cast("bigint").alias("nest"))


def _html(spark, sf_dir):
    return C.html_lines(split_lines(pages(spark, sf_dir)), "path")


_TOP = "path, lang, cyclomatic, cognitive, max_nesting, functions"
_COLS = "path, lang, total_lines, code_lines, comment_lines, blank_lines, cyclomatic, cognitive, max_nesting, functions"


def _tops(column: str, markup: bool = False):
    return lambda s, d: R.top(metrics(s, d) if markup else metrics(s, d).where(_OUT), column, *(["path", "lang", "total_lines", "code_lines"] if markup else _TOP.split(", ")))


_SUMMARY = f"""SELECT count(*) AS files, count(*) FILTER (WHERE {_OUT}) AS files_measured, CAST(sum(total_lines) AS BIGINT) AS total_lines, CAST(sum(code_lines) AS BIGINT) AS code_lines, CAST(sum(comment_lines) AS BIGINT) AS comment_lines, CAST(sum(blank_lines) AS BIGINT) AS blank_lines,
  sum(comment_lines) * 100.0 / sum(code_lines) AS comment_ratio_pct, CAST(sum(cyclomatic) FILTER (WHERE {_OUT}) AS BIGINT) AS cyclomatic_total, avg(cyclomatic) FILTER (WHERE {_OUT}) AS cyclomatic_avg, CAST(sum(cognitive) FILTER (WHERE {_OUT}) AS BIGINT) AS cognitive_total,
  avg(cognitive) FILTER (WHERE {_OUT}) AS cognitive_avg, max(max_nesting) FILTER (WHERE {_OUT}) AS max_nesting, count(*) FILTER (WHERE {_OUT} AND max_nesting >= 4) AS deep_files, CAST(sum(functions) FILTER (WHERE {_OUT}) AS BIGINT) AS total_functions, avg(functions) FILTER (WHERE {_OUT}) AS functions_avg FROM metrics"""
_HEALTH = f"""SELECT least(5.0, greatest(1.0, round_even(5.0 - (CASE WHEN cc > 20 THEN 1.5 WHEN cc > 10 THEN 0.75 WHEN cc > 5 THEN 0.25 ELSE 0 END) - (CASE WHEN cog > 30 THEN 1.5 WHEN cog > 15 THEN 0.75 WHEN cog > 8 THEN 0.25 ELSE 0 END)
  - (CASE WHEN over50 > n * 0.1 THEN 0.5 WHEN over50 > n * 0.05 THEN 0.25 ELSE 0 END) - (CASE WHEN over100 >= greatest(1, n * 0.02) THEN 0.25 ELSE 0 END) - (CASE WHEN nest > 9 THEN 0.5 WHEN nest > 6 THEN 0.25 ELSE 0 END) - (CASE WHEN ratio < 2 THEN 0.5 WHEN ratio < 5 THEN 0.25 ELSE 0 END), 1)))::DOUBLE AS health_score FROM
  (SELECT count(*) FILTER (WHERE {_OUT}) AS n, avg(cyclomatic) FILTER (WHERE {_OUT}) AS cc, avg(cognitive) FILTER (WHERE {_OUT}) AS cog, count(*) FILTER (WHERE {_OUT} AND cyclomatic > 50) AS over50, count(*) FILTER (WHERE {_OUT} AND cyclomatic > 100) AS over100, max(max_nesting) FILTER (WHERE {_OUT}) AS nest, sum(comment_lines) * 100.0 / sum(code_lines) AS ratio FROM metrics)"""

PLANS = {
    "lang_classify": (lambda s, d: a.source_files(s, d).select("path", lang_of(F.col("ext")).alias("lang")), f"WITH {a.SOURCE_WITH} SELECT path, {LANG} AS lang FROM source_files"),
    "filter_extensions": (lambda s, d: a.source_files(s, d).where(known_extension()).select("path"), f"WITH {a.SOURCE_WITH} SELECT path FROM source_files WHERE lower(ext) IN ({_q(LANG_OF_EXT)}) AND {_TAIL}"),
    "filter_skip_dirs": (lambda s, d: a.source_files(s, d).where(outside_skipped()).select("path"), f"WITH {a.SOURCE_WITH} SELECT path FROM source_files WHERE NOT list_has_any(string_split(path, '/')[:-2], [{_q(SKIP_DIRS)}])"),
    "filter_logging_files": (lambda s, d: chosen(a.source_files(s, d), True).select("path"), f"WITH {a.SOURCE_WITH} SELECT path FROM source_files WHERE {_chosen(LOGGING_EXTS, LOGGING_SKIP_DIRS)}"),
    "exclude_rules": (lambda s, d: a.source_files(s, d).where(~excluded(EXCLUDES)).select("path"), f"""WITH {a.SOURCE_WITH} SELECT path FROM source_files WHERE NOT (regexp_matches(lower(path), '(?s)^.*\\.min\\.js$') OR contains('/' || lower(path), '/core/') OR lower(fname) = 'core'
      OR contains('/' || lower(path) || '/', '/src/types/') OR ends_with(lower(fname), '.kt') OR lower(fname) = 'f3_1.ts' OR contains(lower(path), 'app/l') OR regexp_matches(lower(path), '(?s)^s.c/[^a].*page\\.go$'))"""),
    "files_by_language": (lambda s, d: R.files_by_language(files(s, d)), f"WITH {a.SOURCE_WITH}, {FILES} SELECT {LABEL} AS language, count(*) AS files FROM files GROUP BY 1"),
    "file_categories": (lambda s, d: R.file_categories(files(s, d)), f"WITH {a.SOURCE_WITH}, {FILES} SELECT category, count(path) AS files FROM (VALUES {', '.join(f"('{c}')" for c in CATEGORIES)}) v(category) LEFT JOIN (SELECT path, {CATEGORY} AS category FROM files) USING (category) GROUP BY 1"),
    "line_counts": (_line_counts, "SELECT doc_id, count(*) AS total_lines, count(*) FILTER (WHERE regexp_matches(line, '^\\s*$')) AS blank_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1"),
    "head_line_counts": (lambda s, d: gitlog.head_line_counts(a.tables(s, d, "documents")["documents"], "doc_id"), "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE CAST(len(string_split_regex(regexp_replace(text, '(\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e])$', ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e]')) AS INTEGER) END AS line_count FROM documents"),
    "logical_sequences": (_sequence_counts, f"WITH {a.SOURCE_WITH}, {FILES}, {lines_cte()} SELECT path, line_no, {_runs(P.BRACE_OPERATORS)} AS brace, {_runs(P.OPERATORS['py'])} AS python, {_runs(P.OPERATORS['ruby'])} AS ruby FROM lines"),
    "function_counts": (_function_counts, f"WITH {a.SOURCE_WITH}, {FILES}, {lines_cte()} SELECT path, lang, CAST(sum({_is_function([*BRACE_LANGS, *INDENT_LANGS])}) AS BIGINT) AS declarations FROM lines GROUP BY 1, 2"),
    "cyclomatic_by_file": (lambda s, d: metrics(s, d).select("path", "cyclomatic"), sql("SELECT path, cyclomatic FROM metrics")),
    "complexity_by_file": (lambda s, d: C.brace_metrics(_lines(s, d, f"lang NOT IN ({_q([*INDENT_LANGS, 'html'])})"), "path"), sql(f"SELECT {_COLS} FROM braced")),
    "complexity_indent_langs": (lambda s, d: C.indent_metrics(_lines(s, d, f"lang IN ({_q(INDENT_LANGS)})"), "path"), sql(f"SELECT {_COLS} FROM indented")),
    "all_files_complexity": (metrics, sql(f"SELECT {_COLS} FROM metrics")),
    "py_nesting": (_py_nesting, sql("SELECT path, line_no, CAST(nest AS BIGINT) AS nest FROM i_6 WHERE lang = 'py'")),
    "html_metrics": (lambda s, d: C.html_metrics(split_lines(pages(s, d)), "path"), f"WITH {PAGES}, {lines_cte('pages_in')}, {html_ctes('lines', 'marked')} SELECT {_COLS} FROM marked"),
    "html_nesting": (lambda s, d: _html(s, d).where("code").selectExpr("path", "line_no", "CAST(depth AS BIGINT) AS depth"), f"WITH {PAGES}, {lines_cte('pages_in')}, {html_ctes('lines', 'marked')} SELECT path, line_no, CAST(depth AS BIGINT) AS depth FROM h_4"),
    "html_script_lines": (lambda s, d: C.html_lines(split_lines(files(s, d).where("lang = 'html'").select("path", "lang", "content")), "path").where("script").select("path", "line_no", "s"), sql("SELECT path, line_no, s FROM h_js")),
    "functions": (lambda s, d: E.functions(files(s, d)), None),
    "function_complexity": (functions_found, None),
    "complexity_summary": (_m(R.summary), sql(_SUMMARY)),
    "complexity_medians": (_m(R.medians), sql("SELECT " + ", ".join(f"CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC) AS BIGINT) AS {n}_median" for n, c in R.COLUMN.items()) + f" FROM metrics WHERE {_OUT}")),
    **{f"{n}_bands": ((lambda n: lambda s, d: R.bands(metrics(s, d), n))(n), _bands(n)) for n in BANDS},
    "business_summary": (_m(R.business_summary), sql(f"SELECT count(*) AS files, CAST(sum(code_lines) AS BIGINT) AS code_lines, avg(cyclomatic) AS cyclomatic_avg, avg(cognitive) AS cognitive_avg FROM metrics WHERE {CATEGORY} = 'business'")),
    "health_score": (lambda s, d: R.health(metrics(s, d)).select("health_score"), sql(_HEALTH)),
    "health_verdict": (_m(R.health), sql(f"SELECT health_score, CAST(round_even(health_score, 0) AS INTEGER) AS stars, CASE WHEN health_score >= 4 THEN 'good' WHEN health_score >= 3 THEN 'fair' WHEN health_score >= 2 THEN 'poor' ELSE 'bad' END AS verdict FROM ({_HEALTH})")),
    "top_by_cc": (_tops("cyclomatic"), _top("cyclomatic", _TOP)),
    "top_by_cog": (_tops("cognitive"), _top("cognitive", _TOP)),
    "top_by_nest": (_tops("max_nesting"), _top("max_nesting", _TOP)),
    "top_by_functions": (_tops("functions"), _top("functions", _TOP)),
    "top_by_size": (_tops("code_lines", True), _top("code_lines", "path, lang, total_lines, code_lines", "TRUE")),
    **{f"top_functions_by_{n}": ((lambda c: lambda s, d: R.top(functions_found(s, d), c, "path", "name", "start_line", "end_line", "cyclomatic", "cognitive", "max_nesting"))(R.COLUMN[n]), None) for n in ("cc", "cog", "nest")},
}
