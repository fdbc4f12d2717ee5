"""Reports of the three analyses as JSON objects and as text. Only small results are collected here."""

from __future__ import annotations

import datetime
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.functions.config import BAND_NAMES, BANDS, LEVELS
from siltline.functions.paths import excluded, lang_of
from siltline.operators import code_age, complexity, functions, history, logs, rollups
from siltline.sources import gitlog, tree

_NAMES = {"cc": "cyclomatic", "cog": "cognitive", "nest": "nesting", "fn": "functions_per_file"}
_SOURCES = {"cc": "SEI risk bands", "cog": "bands from the usual limit of 15 a method", "nest": "bands from the usual limits of depth", "fn": "heuristic bands of file size"}
MARKUP_LANGUAGES = {"html"}
DENSE_LINES = 10  # of code, for a file's density to say something
_ADVICE = {
    "cc": ("cyclomatic complexity", "to be refactored first", "hotspots, break them up"),
    "cog": ("cognitive complexity (of the file)", "control flow to be simplified", "targets of refactoring"),
    "nest": ("nesting depth", "to be flattened, or given helpers", "flatten without mercy"),
    "fn": ("functions", "modules to be split", "files that do everything, split by responsibility"),
}


# sections of the text of which the reference prints the first only; the others are printed whole
_SHOWN = {"top_files": 20, "top_files_by_churn": 20, "authors": 20, "module_bugs": 20, "module_features": 20, "files": 20}
_WIDE = {"label": 40, "module": 48}  # characters shown


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _files(spark: SparkSession, root: str, exclude: list[str], logging: bool) -> DataFrame:
    tree.register(spark)
    found = spark.read.format("source_tree").option("logging", str(logging).lower()).load(root).where("content IS NOT NULL")
    return found.where(~excluded(exclude)).withColumn("lang", lang_of(F.col("ext"), logging)).persist()


def distribution(counts: dict[str, int], name: str) -> dict:
    """Files of each band under a key that tells its limits, with the limits and where they come from."""
    limits, low = BANDS[name], int(name == "cc")
    out = {f"{b}_{a}_to_{z}": counts.get(b, 0) for b, a, z in zip(BAND_NAMES, (low, *(x + 1 for x in limits)), limits)}
    out[f"extreme_{limits[-1] + 1}_plus" if name == "nest" else f"extreme_above_{limits[-1]}"] = counts.get(BAND_NAMES[-1], 0)
    return out | {"thresholds": {f"{b}_max": x for b, x in zip(BAND_NAMES, limits)}, "reference": f"{_SOURCES[name]}; without markup files"}


def advisories(summary: dict) -> list[str]:
    """A line for each measure whose band below the highest, or highest band, holds a file; in the order of the measures."""
    out = []
    for name, (what, many, most) in _ADVICE.items():
        values, limits = list(summary[f"{_NAMES[name]}_distribution"].values()), BANDS[name]
        if values[3]:
            out.append(f"{values[3]} file(s) with {what} from {limits[2] + 1} to {limits[3]}: {many}")
        if values[4]:
            out.append(f"{values[4]} file(s) with {what} above {limits[3]}: {most}")
    return out


def complexity_sections(report: dict, verdict: dict, top: int = 10, verbose: bool = False) -> dict:
    """The text report's sections in order. Markup files have a place in the list of sizes only. top: rows of each list."""
    plain = [{k: v for k, v in f.items() if k != "function_detail"} for f in report["files"]]
    code = [f for f in plain if f["language"] not in MARKUP_LANGUAGES]
    own = [f for r in report["files"] if r["language"] not in MARKUP_LANGUAGES for f in r["function_detail"]]

    def most(rows: list[dict], column: str) -> list[dict]:
        return sorted(rows, key=lambda r: -r[column])[:top]

    out = {"summary": report["summary"]}
    out |= {f"top_{top}_files_by_{c}": most(code, c) for c in ("cyclomatic", "cognitive", "max_nesting", "functions")} | {f"top_{top}_files_by_code_lines": most(plain, "code_lines")}
    out |= {f"top_{top}_functions_by_{c}": most(own, c) for c in ("cyclomatic", "cognitive", "max_nesting")}
    return out | ({"all_files": plain} if verbose else {}) | {"health": verdict, "advisories": advisories(report["summary"])}


def logging_sections(report: dict, verdict: dict, top: int = 10, verbose: bool = False) -> dict:
    """The text report's sections in order. top: rows of each list; densities count for files of some size only, as in the summary."""
    active, dense = [f for f in report["files"] if f["active_log_lines"]], [f for f in report["files"] if f["code_lines"] >= DENSE_LINES and f["active_log_lines"]]
    commented = sorted((f for f in report["files"] if f["commented_log_lines"]), key=lambda f: -f["commented_log_lines"])
    by_language: dict[str, int] = {}
    for f in active:
        by_language[f["language"]] = by_language.get(f["language"], 0) + f["active_log_lines"]
    out = {"summary": report["summary"]} | ({"by_language": by_language} if len(by_language) > 1 else {})
    out |= {f"top_{top}_files_by_log_lines": active[:top], f"top_{top}_files_by_density": sorted(dense, key=lambda f: -f["log_density_pct"])[:top]} | ({"commented": commented[:top]} if commented else {})
    return out | ({"all_files": report["files"]} if verbose else {}) | {"verdict": verdict}


HISTORY_FILE = "commit_analysis_results.json"


def history_json(report: dict) -> dict:
    """The history report under the 11 keys of its JSON file: pairs of name and count for files, authors and modules, and lines by age."""
    pairs = lambda rows, name: [[r[name], r["commits"]] for r in rows]
    age = report["code_age"]
    if age is not None:
        unknown = sum(b["lines"] for b in age["buckets"] if b["label"] == "unknown")
        total = sum(b["lines"] for b in age["buckets"])
        buckets = [{"label": b["label"], "lines": b["lines"], "pct": round(100 * b["share"], 1), "top_modules": [m for m in age["top_modules"] if m["label"] == b["label"]]} for b in age["buckets"] if b["label"] != "unknown"]
        age = {"total_lines": total, "unknown_lines": unknown, "unknown_pct": round(100 * unknown / total, 1) if total else 0.0, "buckets": buckets, **{k: age[k] for k in ("reference_time_utc", "grouping_mode", "repo_span_days", "oldest_commit_utc")}}
    return {
        "total_unique_commits": report["total_commits"], "total_files": report["total_files"], "top_20_files": pairs(report["top_files"], "path"), "categories": {r["category"]: r["commits"] for r in report["categories"] if r["commits"]}, "authors": pairs(report["authors"], "author"),
        "year_distribution": {str(r["year"]): r["commits"] for r in report["years"]}, "monthly_bugs_vs_features": [{k: r[k] for k in ("year", "month", "label", "bug_fixes", "features")} for r in report["monthly_bugs_vs_features"]],
        "modules": pairs(report["modules"], "module"), "module_bugs": pairs(report["module_bugs"], "module"), "module_features": pairs(report["module_features"], "module"), "code_age_by_lines": age,
    }


def complexity_report(spark: SparkSession, root: str, exclude: list[str] = ()) -> dict:
    """summary and files, as the JSON report has them, and the verdict."""
    files = _files(spark, root, list(exclude), False)
    metrics, own = complexity.file_metrics(files).persist(), functions.function_metrics(files)
    total, middle, verdict = rows(rollups.summary(metrics))[0], rows(rollups.medians(metrics))[0], rows(rollups.health(metrics))[0]
    summary = {
        "files": total["files"], "files_in_complexity_summaries": total["files_measured"], **{k: total[k] for k in ("total_lines", "code_lines", "comment_lines", "blank_lines")}, "comment_ratio_pct": round(total["comment_ratio_pct"], 1),
        **{k: total[k] if k.endswith("total") else round(total[k], 1) for k in ("cyclomatic_total", "cyclomatic_avg", "cognitive_total", "cognitive_avg")},
        **{f"{_NAMES[n]}_distribution": distribution({r["band"]: r["files"] for r in rows(rollups.bands(metrics, n))}, n) for n in BANDS},
        "nesting_median": middle["nest_median"] or 0, "max_nesting": total["max_nesting"], "total_functions": total["total_functions"], "functions_avg_per_file": round(total["functions_avg"], 1), "functions_median_per_file": middle["fn_median"] or 0,
        "health_score": verdict["health_score"],
    }
    detail = own.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start_line", "name", "end_line", "code_lines", "cyclomatic", "cognitive", "max_nesting"))).alias("function_detail"))
    listed = rows(metrics.join(detail, "path", "left").orderBy(F.desc("cyclomatic"), "path"))
    columns = ("total_lines", "code_lines", "comment_lines", "blank_lines", "cyclomatic", "cognitive", "max_nesting", "functions")
    files = [{"path": r["path"], "language": r["lang"], **{c: r[c] for c in columns}, "function_detail": [{"name": f["name"], "file": r["path"], **f} for f in r["function_detail"] or []]} for r in listed]
    return {"summary": summary, "files": files, "verdict": verdict}


def logging_report(spark: SparkSession, root: str, exclude: list[str] = ()) -> dict:
    """summary and files, as the JSON report has them, and the verdict."""
    files = _files(spark, root, list(exclude), True)
    metrics, calls = logs.log_metrics(files).persist(), logs.log_lines(files).persist()
    total = rows(rollups.log_summary(metrics))[0]
    by_category = {r["category"]: r["logs"] for r in rows(rollups.logs_by_category(calls).orderBy(F.desc("logs"), "category"))}
    of_file: dict[str, dict] = {}
    for r in rows(calls.where("NOT is_commented").groupBy("path", "category").count()):
        of_file.setdefault(r["path"], {})[r["category"]] = r["count"]
    summary = {
        "files_analyzed": total["files"], "files_with_logging": total["files_with_any"], "code_lines": total["code_lines"], "active_log_lines": total["active_log_lines"], "commented_log_lines": total["commented_log_lines"],
        "log_density_pct": round(total["density_pct"], 2), "by_level": {r["level"]: r["logs"] for r in rows(rollups.logs_by_level(metrics))}, "by_category": by_category,
    }
    listed = [
        {"path": r["path"], "language": r["lang"], **{k: r[k] for k in ("code_lines", "total_log_lines", "active_log_lines", "commented_log_lines")}, "log_density_pct": round(r["density"], 2), "by_level": {v: r[f"n_{v}"] for v in LEVELS}, "by_category": of_file.get(r["path"], {})}
        for r in rows(metrics.where("total_log_lines > 0").orderBy(F.desc("active_log_lines"), "path"))
    ]
    return {"summary": summary, "files": listed, "verdict": rows(rollups.density_verdict(metrics))[0]}


def history_report(spark: SparkSession, repository: str | None, log_file: str | None = None, exclude: list[str] = (), ages: bool = True, top_modules: int = 5, now: int | None = None) -> dict:
    tree.register(spark)
    chunks = (gitlog.read(spark, log_file) if log_file else spark.read.format("gitlog").load(repository)).persist()
    commits = gitlog.ordered(gitlog.parse_commits(chunks)).persist()
    numstat = gitlog.ordered(history.exclude_prefix(gitlog.parse_numstat(chunks), list(exclude))).persist()
    out = {
        **rows(history.totals(commits, numstat))[0], "top_files": rows(history.top_files_by_commits(numstat)), "top_files_by_churn": rows(history.top_files_by_churn(numstat)), "categories": rows(history.category_counts(commits)),
        "authors": rows(history.top_authors(commits)), "years": rows(history.by_year(commits, numstat).orderBy("year")), "monthly_bugs_vs_features": rows(history.by_month(commits).orderBy("year", "month")), "modules": rows(history.commits_per_module(numstat)),
        "module_bugs": rows(history.category_per_module(commits, numstat, "bug_fix")), "module_features": rows(history.category_per_module(commits, numstat, "feature")), "code_age": None,
    }
    if ages and repository:
        now = now or int(time.time())
        head = spark.read.format("gittree").load(repository).persist()
        oldest = rows(code_age.epochs(commits).agg(F.min("author_epoch").alias("at")))[0]["at"]
        iso = lambda at: datetime.datetime.fromtimestamp(at, datetime.UTC).isoformat()
        out["code_age"] = rows(code_age.mode(commits, now))[0] | {"reference_time_utc": iso(now), "oldest_commit_utc": None if oldest is None else iso(oldest)} | {"buckets": rows(code_age.buckets(commits, numstat, head, now, list(exclude)).orderBy("place")), "top_modules": rows(code_age.top_modules(commits, numstat, head, now, top_modules, list(exclude)))}
    return out


def _cut(text: str, width: int) -> str:
    return text if len(text) <= width else text[: width - 1] + "\u2026"


def as_text(report: dict, title: str) -> str:
    """Headed sections: plain values as a list, lists of rows as tables with bars for shares."""
    out = [title, "=" * len(title)]

    def show(name: str, value, depth: int = 0) -> None:
        pad = "  " * depth
        if isinstance(value, dict):
            out.append(f"{pad}{name}")
            for k, v in value.items():
                show(k, v, depth + 1)
        elif isinstance(value, list) and value and isinstance(value[0], dict):
            out.append(f"\n{pad}{name.upper().replace('_', ' ')}")
            columns = [c for c in value[0] if not isinstance(value[0][c], (list, dict))]
            out.append(pad + "  " + "  ".join(columns))
            for r in value[: _SHOWN.get(name)]:
                cells = [f"{r[c]:.3f}" if isinstance(r[c], float) else _cut(str(r[c]), _WIDE.get(c, 60)) for c in columns]
                out.append(pad + "  " + "  ".join(cells) + ("  " + "#" * int(50 * r["share"]) if "share" in r else ""))
        elif isinstance(value, list):
            out.extend([f"\n{pad}{name.upper()}", *(f"{pad}  {x}" for x in value)] if value else [])
        else:
            out.append(f"{pad}{name}: {value}")

    if not report.get("summary", {"files": 1}).get("files", report.get("summary", {}).get("files_analyzed", 1)):
        return "No files found to analyze."
    for name, value in report.items():
        show(name, value)
    return "\n".join(out)


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False, default=str)


