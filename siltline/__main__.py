"""Command line: ``python -m siltline history|complexity|logging PATH``."""

from __future__ import annotations

import argparse
import os
import pathlib
import sys

from pyspark.sql import SparkSession

from siltline.plans import report
from siltline.sources import gitlog, tree


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltline", description=__doc__)
    kinds = parser.add_subparsers(dest="kind", required=True)
    for kind in ("complexity", "logging"):
        p = kinds.add_parser(kind)
        p.add_argument("directory", nargs="?", default=".")
        p.add_argument("-e", "--exclude", action="extend", nargs="+", default=[])
        p.add_argument("-t", "--top", type=int, default=10, help="rows of each list of the text report")
        p.add_argument("-v", "--verbose", action="store_true", help="also list all files")
        p.add_argument("-j", "--json", action="store_true")
    p = kinds.add_parser("history")
    p.add_argument("repository", nargs="?", default=".")
    p.add_argument("-H", "--history-file", help="a log made before, instead of the repository's")
    p.add_argument("-E", "--export", nargs="?", const="commit-history.txt", help="write the log to a file (not with -H)")
    p.add_argument("-o", "--output", default=report.HISTORY_FILE, help="the JSON file that is written")
    p.add_argument("--exclude", action="extend", nargs="+", default=[])
    p.add_argument("--code-age-top-modules", default=5, type=int, help="0: none")
    for flags in (["--no-code-age"], ["-j", "--json"]):
        p.add_argument(*flags, action="store_true")
    given = parser.parse_args(args)
    if given.kind != "history" and not os.path.isdir(given.directory):
        print(f"{given.directory} is not a directory", file=sys.stderr)
        return 1
    if given.kind == "history" and given.history_file and given.export:
        parser.error("-E exports what is read from a repository; it can't be used with -H")
    if given.kind == "history" and not given.history_file and (problem := gitlog.problem(given.repository)):
        print(problem, file=sys.stderr)
        return 1
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    if given.kind == "history":
        if given.export:
            tree.register(spark)
            text = spark.read.format(gitlog.GitLog.name()).load(given.repository).first().text
            pathlib.Path(given.export).write_text(text, "utf-8", newline="\n")
        made = report.history_report(spark, given.repository, given.history_file, given.exclude, not given.no_code_age, given.code_age_top_modules)
        whole = report.as_json(report.history_json(made))
        pathlib.Path(given.output).write_text(whole + "\n", "utf-8")
        print(whole if given.json else report.as_text(made, f"History of {given.repository}"))
        return 0
    made = {"complexity": report.complexity_report, "logging": report.logging_report}[given.kind](spark, given.directory, given.exclude)
    verdict = made.pop("verdict")
    if given.json:
        print(report.as_json(made))
    elif not made["summary"].get("files", made["summary"].get("files_analyzed")):
        print("No files found to analyze.")
    else:
        sections = {"complexity": report.complexity_sections, "logging": report.logging_sections}[given.kind]
        print(report.as_text(sections(made, verdict, given.top, given.verbose), f"{given.kind.capitalize()} of {given.directory}"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
