from __future__ import annotations

import fnmatch
import json
import random
import re
import subprocess

from pyspark.sql import functions as F

from siltline.__main__ import main
from siltline.functions.dates import instant, month_of, year_of
from siltline.functions.logcalls import LOG_CALLS
from siltline.functions.paths import _glob, excluded
from siltline.operators import code_age, history, logs
from siltline.plans import report
from siltline.sources import gitlog, tree
from siltline.streaming import ingest


def example(pattern: str) -> str:
    """A text that a pattern of the table matches."""
    s = pattern.replace(r"\b\$", "$").replace(r"\b\w*", "my").replace(r"\b", "").replace(r"^\s*", "").replace(r"\s*", "").replace("[Ll]", "l").replace(r"\w*", "my").replace("[\"']", '"')
    s = re.sub(r"\(\?:([^)|]*)(\|[^)]*)*\)\??", r"\1", s)
    return re.sub(r"\\s$", " ", s).replace("\\", "")


def test_every_log_pattern(spark):
    rows = [(f"{lang}{i}", lang, example(p), p) for lang, calls in LOG_CALLS.items() for i, (p, _, _) in enumerate(calls) if r"\b\$" not in p]
    got = {r.path: (r.level, r.category) for r in logs.log_lines(spark.createDataFrame([r[:3] for r in rows], "path string, lang string, content string")).collect()}
    for path, lang, text, pattern in rows:
        s = text.strip()
        want = next(((level, c) for p, level, c in LOG_CALLS[lang] if re.search(p, s)), None)
        assert want is not None or pattern.endswith(r"\s"), (pattern, text)
        assert got.get(path) == want, (pattern, text)


def test_no_log_calls(spark):
    files = spark.createDataFrame([("a", "js", "catalog.find(x);\nvar dialogRef = open();"), ("b", "java", "catalog.find(x);"), ("c", "cs", "/* Console.Write(1)\nConsole.Write(2)\n*/")], "path string, lang string, content string")
    assert logs.log_lines(files).count() == 0
    r = {x.path: x for x in logs.log_metrics(files).collect()}
    assert r["a"].code_lines == 2 and r["c"].code_lines == 0 and r["c"].density == 0


def test_commented_logs(spark):
    files = spark.createDataFrame([("a", "js", "// console.log(1)\n/* console.log(2) */\nconsole.log(3); /* open\nconsole.log(4)\n*/\nconsole.warn(5)")], "path string, lang string, content string")
    r = logs.log_metrics(files).first()
    assert (r.code_lines, r.active_log_lines, r.commented_log_lines, r.n_warn) == (2, 2, 2, 1)


def test_categories(spark):
    cases = [("Fix crash", "bug_fix"), ("Add support", "feature"), ("Fix and add", "bug_fix"), ("Add fix", "feature"), ("Refactor to a new facade", "feature"), ("Remove imports", "refactoring"), ("rewrote it", "other"), ("issues", "other"), ("", "other"), (None, "other"), ("set up", "feature")]
    rows = spark.createDataFrame(cases, "m string, want string").withColumn("got", history.category_of(F.col("m")))
    assert all(r.want == r.got for r in rows.collect())


def test_dates(spark):
    cases = [("Thu Mar 18 14:42:51 2021 +0100", 1616074971, "2021", "03"), ("2021-03-18T13:42:51Z", 1616074971, "2021", None), ("2021-03-18 14:42:51+01:00", 1616074971, "2021", None), ("nonsense", None, None, None), ("someday in May 1999", None, "1999", "05"), (None, None, None, None)]
    rows = spark.createDataFrame(cases, "d string, e bigint, y string, m string")
    for r in rows.select("*", F.unix_seconds(instant(F.col("d"))).alias("ge"), year_of(F.col("d")).alias("gy"), month_of(F.col("d")).alias("gm")).collect():
        assert (r.e, r.y, r.m) == (r.ge, r.gy, r.gm), r.d


def test_iso_week_at_the_turn_of_a_year(spark):
    row = spark.range(1).select(code_age.label(code_age.bucket(F.lit(1609632000), F.lit("week"), 1700000000)).alias("w"), code_age.label(code_age.bucket(F.lit(0), F.lit("year"), 1700000000)).alias("y")).first()
    assert row.w == "ISO week 2020-W53 (last change)" and row.y == "24+ years since last change"


def test_grouping_modes(spark):
    now = 1_600_000_000
    for days, mode in ((0, "week"), (182, "week"), (183, "month"), (729, "month"), (730, "year")):
        commits = spark.createDataFrame([(1, "c", f"{i}") for i in [0]], "seq bigint, commit_id string, x string").withColumn("date_raw", F.date_format(F.timestamp_seconds(F.lit(now - days * 86400)), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        r = code_age.mode(commits, now).first()
        assert (r.repo_span_days, r.grouping_mode) == (days, mode)


def test_log_text(spark):
    text = "commit aa (HEAD -> main)\nAuthor: Ann Lee <a@x>\nDate:   Thu Mar 18 14:42:51 2021 +0100\n\n    First line\n    \n    more\n\n3\t1\tsrc/a.py\n-\t-\tlogo.png\n1\t2\tsrc/{a => b}/c.py\nno\ttab\n\ncommit bb\nMerge: x y\nAuthor: Bo\n\n    Only\n"
    chunks = spark.createDataFrame([(1, text)], "chunk_id bigint, text string")
    commits = [(r.commit_id, r.author, r.date_raw, r.message) for r in gitlog.parse_commits(chunks).orderBy("seq").collect()]
    assert commits == [("aa", "Ann Lee", "Thu Mar 18 14:42:51 2021 +0100", "First line  more"), ("bb", "Bo", None, "Only")]
    changes = [(r.commit_id, r.adds, r.dels, r.path) for r in gitlog.parse_numstat(chunks).orderBy("seq").collect()]
    assert changes == [("aa", 3, 1, "src/a.py"), ("aa", 0, 0, "logo.png"), ("aa", 1, 2, "src/{a => b}/c.py")]


def test_exclusion(spark):
    assert history.normal_prefixes(["./docs/", " .github/ ", "./", ""]) == ["docs/", "github/", ""]
    paths = ["src/App.cs", "old/x.js", "a/old/y.js", "a/older/z.js", "web/x.min.js", "foo.cs"]
    rows = spark.createDataFrame([(p, p.rsplit("/", 1)[-1]) for p in paths], "path string, fname string")
    for pattern, gone in ((".min.js", {"web/x.min.js"}), ("old/", {"old/x.js", "a/old/y.js"}), ("FOO.cs", {"foo.cs"}), ("old", {"old/x.js", "a/old/y.js"}), ("*/z.*", {"a/older/z.js"}), ("c/app", {"src/App.cs"}), (" ", set())):
        assert {r.path for r in rows.where(excluded([pattern])).collect()} == gone, pattern
    random.seed(3)
    for _ in range(300):
        glob, name = "".join(random.choice("ab*?[]!-.") for _ in range(random.randint(1, 6))), "".join(random.choice("ab-.]") for _ in range(random.randint(0, 5)))
        try:
            found = re.match(_glob(glob).replace(r"\z", r"\Z"), name)
        except re.error:
            continue
        if "[" not in glob:
            assert bool(found) == fnmatch.fnmatchcase(name, glob), (glob, name)


def test_text_has_all_rows_but_of_limited_sections():
    listed = [{"label": f"row {i:02}", "n": i} for i in range(50)]
    for name, n in (("years", 50), ("monthly_bugs_vs_features", 50), ("modules", 50), ("buckets", 50), ("top_modules", 50), ("authors", 20), ("module_bugs", 20), ("module_features", 20)):
        assert report.as_text({name: listed}, "t").count("row ") == n


def test_tree_git_and_reports(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, text in (("pkg/__init__.py", "print(1)\n"), ("pkg/.h.py", "x = 1\r\ny = 2\n"), ("a.js", "if (x) {\n console.log(1);\n}\n"), ("b.min.js", "x"), ("node_modules/c.js", "x"), ("page.html", "<p>\n</p>\n"), ("n.md", "x")):
        (tmp_path / name).write_bytes(text.encode())
    tree.register(spark)
    got = {r.path: r.content for r in spark.read.format("source_tree").load(str(tmp_path)).collect()}
    assert set(got) == {"pkg/__init__.py", "pkg/.h.py", "a.js", "page.html"} and got["pkg/.h.py"] == "x = 1\ny = 2\n"
    found = report.complexity_report(spark, str(tmp_path))
    assert found["summary"]["files"] == 4 and found["summary"]["files_in_complexity_summaries"] == 3 and found["files"][0]["path"] == "a.js"
    assert report.logging_report(spark, str(tmp_path), [".py"])["summary"]["active_log_lines"] == 1
    git = ["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=a@x"]
    for args in (["init", "-q"], ["add", "a.js", "page.html"], ["commit", "-q", "-m", "Fix bug"]):
        subprocess.run([*git, *args], check=True, capture_output=True)
    made = report.history_report(spark, str(tmp_path))
    assert made["total_commits"] == 1 and made["total_files"] == 2 and made["authors"][0]["author"] == "Ann" and made["code_age"]["buckets"][0]["lines"] == 5
    assert "TOP FILES" in report.as_text(made, "t") and "Fix" not in report.as_json(made)
    whole = report.history_json(made)
    assert list(whole) == "total_unique_commits total_files top_20_files categories authors year_distribution monthly_bugs_vs_features modules module_bugs module_features code_age_by_lines".split()
    assert whole["authors"] == [["Ann", 1]] and whole["categories"] == {"bug_fix": 1} and whole["code_age_by_lines"]["total_lines"] == 5 and len(whole["code_age_by_lines"]["buckets"][0]["top_modules"]) > 0
    assert report.history_json(report.history_report(spark, str(tmp_path), ages=False))["code_age_by_lines"] is None
    file = found["files"][0]
    assert list(file) == "path language total_lines code_lines comment_lines blank_lines cyclomatic cognitive max_nesting functions function_detail".split() and len(found["summary"]) == 21
    logged = report.logging_report(spark, str(tmp_path))
    assert len(logged["summary"]) == 8 and len(logged["files"][0]) == 9
    text = report.as_text(report.logging_sections(logged, logged["verdict"], 1), "t")
    assert "TOP 1 FILES BY LOG LINES" in text and "verdict" in text


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text("def f(x):\n    if x:\n        return 1\n\n\ndef g():\n    return 2\n")
    (tmp_path / "b.js").write_text("function f(x) {\n  if (x) {\n    return 1;\n  }\n}\nfunction g() {\n  return 2;\n}\n")
    (tmp_path / "c.html").write_text("<p>\n</p>\n" * 9)
    assert main(["complexity", str(tmp_path), "-t", "1", "-v"]) == 0
    text = capsys.readouterr().out
    sizes, functions = text.split("TOP 1 FILES BY CODE LINES")[1].split("\n\n")[0], text.split("TOP 1 FUNCTIONS BY CYCLOMATIC")[1].split("\n\n")[0]
    assert "c.html" in sizes and "a.py" not in sizes and " f " in functions and " g " not in functions and "ALL FILES" in text and "verdict: " in text
    assert main(["complexity", str(tmp_path), "-j", "--exclude", ".py", ".html"]) == 0
    made = json.loads(capsys.readouterr().out)
    assert set(made) == {"summary", "files"} and [f["path"] for f in made["files"]] == ["b.js"] and set(made["files"][0]["function_detail"][0]) == {"name", "file", "start_line", "end_line", "code_lines", "cyclomatic", "cognitive", "max_nesting"}
    assert main(["logging", str(tmp_path), "-e", ".py", ".js", ".html"]) == 0 and "No files found" in capsys.readouterr().out
    assert main(["logging", str(tmp_path / "none")]) == 1 and main(["history", str(tmp_path)]) == 1 and capsys.readouterr().err
    log = tmp_path / "log.txt"
    log.write_text("commit " + "a" * 40 + "\nAuthor: Ann <a@x>\nDate:   Mon Jan 5 10:00:00 2026 +0000\n\n    add x\n\n1\t0\ta.py\n")
    assert main(["history", str(tmp_path), "-H", str(log), "--no-code-age", "-o", str(tmp_path / "out.json")]) == 0
    assert json.loads((tmp_path / "out.json").read_text())["total_unique_commits"] == 1


def test_advisories_and_distributions():
    counts = {"low": 3, "very_high": 2, "extreme": 1}
    made = {f"{n}_distribution": report.distribution(counts if k in ("cc", "nest") else {}, k) for k, n in (("cc", "cyclomatic"), ("cog", "cognitive"), ("nest", "nesting"), ("fn", "functions_per_file"))}
    assert list(made["cyclomatic_distribution"])[:5] == ["low_1_to_10", "moderate_11_to_20", "high_21_to_50", "very_high_51_to_100", "extreme_above_100"]
    assert list(made["nesting_distribution"])[:5] == ["low_0_to_2", "moderate_3_to_4", "high_5_to_6", "very_high_7_to_9", "extreme_10_plus"]
    assert made["cyclomatic_distribution"]["thresholds"] == {"low_max": 10, "moderate_max": 20, "high_max": 50, "very_high_max": 100} and "reference" in made["cognitive_distribution"]
    assert [a.split(" file")[0] for a in report.advisories(made)] == ["2", "1", "2", "1"] and "above 9" in report.advisories(made)[3]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.log").write_text(f"commit c{i}\nAuthor: A\nDate: x\n\n    Add {i}\n\n1\t{i}\tf{i}.py\n")
    ingest.append(ingest.numstat(spark, str(tmp_path / "in")).drop("seq"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    want = gitlog.parse_numstat(gitlog.read(spark, str(tmp_path / "in"))).drop("seq")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))


def test_empty_inputs(spark):
    commits = spark.createDataFrame([], "seq bigint, commit_id string, author string, date_raw string, message string")
    numstat = spark.createDataFrame([], "seq bigint, commit_id string, adds bigint, dels bigint, path string")
    assert history.totals(commits, numstat).first().asDict() == {"total_commits": 0, "total_files": 0}
    assert history.by_month(commits).count() == 0 and [r.commits for r in history.category_counts(commits).collect()] == [0] * 4
    assert history.top_files_by_churn(numstat).count() == 0 and code_age.mode(commits, 0).first().grouping_mode == "year"
