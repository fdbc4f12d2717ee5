"""The domain's relations, derived from the supplied tables. The same SQL text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.functions.config import MONTHS
from siltline.sources.snippets import SNIPPETS

NOW_EPOCH = 999302400  # 2001-09-01, after the last order
WEEK_NOW_EPOCH = 1706745600  # 2024-02-01, after the last event
MONTH_FROM = "2000-06-01"

_MESSAGES = [
    "Fix crash in the parser", "Add support for exports", "Fix and add retries", "Add fix for login", "Refactor to a new facade", "Remove unused imports", "rewrote the function", "issues with features", "HOTFIX: Broken build",
    "Set up the CI pipeline", "Renamed modules", "", "Update docs", "cleanup and optimization", "Prefix address handling",
]
_MONTH = "CASE month(o.o_orderdate) " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(MONTHS)) + " END"
_ZONES = "CASE o.o_orderkey % 3 WHEN 0 THEN ' +0000' WHEN 1 THEN ' +0530' ELSE ' -0800' END"

COMMITS = f"""
SELECT o.o_orderkey AS seq, 'c' || o.o_orderkey AS commit_id,
  CASE WHEN o.o_orderkey % 53 = 0 THEN NULL ELSE c.c_name END AS author,
  CASE WHEN o.o_orderkey % 61 = 0 THEN NULL WHEN o.o_orderkey % 67 = 0 THEN 'some day in ' || year(o.o_orderdate)
    ELSE 'Thu ' || {_MONTH} || ' ' || day(o.o_orderdate) || ' ' || lpad('' || (o.o_orderkey % 24), 2, '0') || ':30:15 ' || year(o.o_orderdate) || {_ZONES} END AS date_raw,
  CASE o.o_orderkey % {len(_MESSAGES)} {" ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MESSAGES))} END AS message
FROM {{orders}} o LEFT JOIN {{customer}} c ON c.c_custkey = o.o_custkey
"""

_EXT = "CASE p.p_partkey % 6 WHEN 0 THEN '.js' WHEN 1 THEN '.cs' WHEN 2 THEN '.java' WHEN 3 THEN '.py' WHEN 4 THEN '.html' ELSE '.md' END"
_PATH = f"""CASE WHEN p.p_partkey % 37 = 0 THEN replace(p.p_name, ' ', '_') || {_EXT}
  ELSE CASE WHEN p.p_partkey % 29 = 0 THEN '.github/' WHEN p.p_partkey % 23 = 0 THEN 'docs/' ELSE '' END || lower(p.p_type) || '/' || replace(p.p_brand, '#', '') || '/' || replace(p.p_name, ' ', '_') || '_' || (p.p_partkey % 7) || {_EXT} END"""

NUMSTAT = f"""
SELECT l.l_orderkey * 8 + l.l_linenumber AS seq, 'c' || l.l_orderkey AS commit_id,
  CASE WHEN p.p_partkey % 41 = 0 THEN 0 ELSE CAST(l.l_quantity AS BIGINT) END AS adds,
  CASE WHEN p.p_partkey % 41 = 0 THEN 0 ELSE CAST(l.l_linenumber * (p.p_partkey % 5) AS BIGINT) END AS dels,
  {_PATH} AS path
FROM {{lineitem}} l JOIN {{part}} p ON p.p_partkey = l.l_partkey
"""

HEAD_FILES = f"""
SELECT path, CASE WHEN min(k) % 31 = 0 THEN 0 ELSE sum(n) END AS line_count, min(k) % 31 = 0 AS is_binary,
  CASE WHEN min(k) % 5 = 0 THEN 900000000 + min(k) END AS fallback_epoch
FROM (SELECT p.p_partkey AS k, CAST(p.p_size * 10 AS BIGINT) AS n, CASE WHEN p.p_partkey % 43 < 3 THEN 'new/' ELSE '' END || {_PATH} AS path FROM {{part}} p) x
GROUP BY path
"""

EVENT_COMMITS = """
SELECT e.event_id AS seq, 'e' || e.event_id AS commit_id, 'u' || e.user_id AS author,
  CAST(e.ts AS DATE) || 'T' || lpad('' || hour(e.ts), 2, '0') || ':' || lpad('' || minute(e.ts), 2, '0') || ':00Z' AS date_raw, 'Track ' || e.event_type AS message,
  e.event_type || '/user_' || (e.user_id % 40) || '.log' AS path
FROM {events} e
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(COMMITS, **tables(spark, sf_dir, "orders", "customer"))


def numstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NUMSTAT, **tables(spark, sf_dir, "lineitem", "part"))


def head_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HEAD_FILES, **tables(spark, sf_dir, "part"))


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENT_COMMITS, **tables(spark, sf_dir, "events"))


def duck(text: str) -> str:
    """The text for DuckDB, where the tables have their own names."""
    return text.format(**{t: t for t in ("orders", "customer", "lineitem", "part", "events", "supplier", "nation", "pages", "documents")})


WITH = f"""commits AS ({duck(COMMITS)}), numstat AS ({duck(NUMSTAT)}), head_files AS ({duck(HEAD_FILES)})"""

_DIRS = ["src/app", "src/components/ui", "test", "lib/test", "web/node_modules/pkg", "src/types", "setup", "bin", "src", "app/lib", "src/__tests__", "core"]
_TAILS = ["", "_test", ".min", "Config", ".d", ".g", "Page"]
_TREE = """
SELECT path, fname, ext, content FROM (
  SELECT 'f' || s.s_suppkey || '_' || t.i || CASE s.s_suppkey % {n_tails} {tails} END || '.' || t.ext AS fname, t.ext AS ext,
    repeat(t.content, CAST(1 + s.s_suppkey % 3 AS INT)) AS content,
    CASE (s.s_suppkey + t.i) % {n_dirs} {dirs} END || '/f' || s.s_suppkey || '_' || t.i || CASE s.s_suppkey % {n_tails} {tails} END || '.' || t.ext AS path
  FROM {{supplier}} s CROSS JOIN {{snippets}} t) x
"""
_CASES = {"n_dirs": len(_DIRS), "dirs": " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(_DIRS)), "n_tails": len(_TAILS), "tails": " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TAILS))}
SOURCE_FILES = _TREE.format(**_CASES)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(path, fname, ext, content): each snippet once for each supplier, one to three times over, in directories and under names of all kinds."""
    snippets = spark.createDataFrame([(i, ext, text) for i, (ext, text) in enumerate(SNIPPETS)], "i bigint, ext string, content string")
    supplier = tables(spark, sf_dir, "supplier")["supplier"]
    # a supplier's files are many times its row, so its rows are dealt out to all cores (into a set number of tasks, which isn't coalesced) before each meets the few snippets
    tasks = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 36), 2 * spark.sparkContext.defaultParallelism)
    return spark.sql(SOURCE_FILES, snippets=F.broadcast(snippets), supplier=supplier.repartition(tasks, "s_suppkey"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SNIPPET_ROWS = ", ".join(f"({i}, {_quoted(ext)}, {_quoted(text)})" for i, (ext, text) in enumerate(SNIPPETS))
SOURCE_WITH = f"snippets(i, ext, content) AS (VALUES {_SNIPPET_ROWS}), source_files AS ({SOURCE_FILES.format(supplier='supplier', snippets='snippets')})"

