"""Logs of git (with numstat) as text: reading, parsing and writing them."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_BREAK = "\ncommit "
_GAP = r"\s+"
_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, text): whole files, in UTF-8 with other bytes replaced, line ends as "\\n"."""
    text = F.regexp_replace("value", "\r\n?", "\n")
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("chunk_id"), text.alias("text"))


def records(chunks: DataFrame) -> DataFrame:
    """(chunk_id, record, lines): each commit of the chunks, in its place; lines from the one with the id on."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), "text"), _BREAK, -1), 2, 1 << 30)
    found = chunks.select("chunk_id", F.posexplode(parts).alias("record", "body"))
    return found.select("chunk_id", "record", F.split("body", "\n", -1).alias("lines"))


def _id():
    return F.regexp_extract(F.element_at("lines", 1), r"^\s*(\S+)", 1)


def parse_commits(chunks: DataFrame) -> DataFrame:
    """(seq, commit_id, author, date_raw, message): header lines up to the first that is blank, indented or has a tab; then the indented lines, joined by blanks."""
    rest = F.slice("lines", 2, 1 << 30)
    ends = F.transform(rest, lambda x: (F.trim(x) == "") | x.startswith("    ") | x.contains("\t"))
    size = F.array_position(ends, F.lit(True))
    heads = F.when(size > 0, F.slice("rest", F.lit(1), F.greatest(size - 1, F.lit(0)).cast("int"))).otherwise(F.col("rest"))
    body = F.filter("rest", lambda x: x.startswith("    "))
    rows = records(chunks).withColumn("rest", rest)

    def head(name: str, pattern: str):
        lines = F.filter(heads, lambda x: x.startswith(name + ":"))
        found = F.regexp_extract(F.element_at(lines, -1), pattern, 1)
        return F.when((F.size(lines) > 0) & (found != ""), found)

    return rows.select(
        F.struct("chunk_id", "record").alias("seq"), _id().alias("commit_id"), head("Author", f"^Author:{_GAP}(.+?)(?:{_GAP}<.*>)?$").alias("author"), head("Date", r"^Date:\s+(.+?)\s*$").alias("date_raw"),
        F.array_join(F.transform(body, lambda x: F.regexp_replace(x, _STRIP, "")), " ").alias("message"),
    )


def parse_numstat(chunks: DataFrame) -> DataFrame:
    """(seq, commit_id, adds, dels, path): lines of three fields between tabs; a count that is no number (of a binary file) is 0."""
    rows = records(chunks).select("chunk_id", "record", _id().alias("commit_id"), F.posexplode("lines").alias("line", "text"))
    fields = F.split("text", "\t", -1)
    some = rows.where(~F.col("text").startswith("    ")).withColumn("f", fields).where(F.size("f") == 3)

    def number(i: int):
        return F.coalesce(F.col("f")[i].try_cast("bigint"), F.lit(0).cast("bigint"))

    return some.select(F.struct("chunk_id", "record", "line").alias("seq"), "commit_id", number(0).alias("adds"), number(1).alias("dels"), F.col("f")[2].alias("path"))


def rendered(commits: DataFrame, numstat: DataFrame, chunk: int = 1000) -> DataFrame:
    """(chunk_id, text): the log that such commits and changes would have; so many commits a chunk."""
    change = F.concat_ws("\t", F.col("adds").cast("string"), F.col("dels").cast("string"), "path")
    changes = numstat.groupBy("commit_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", change.alias("x")))), lambda s: s["x"]), "\n").alias("changes"))
    text = F.concat(
        F.lit("commit "), "commit_id", F.coalesce(F.concat(F.lit("\nAuthor: "), "author", F.lit(" <a@example.com>")), F.lit("")), F.coalesce(F.concat(F.lit("\nDate:   "), "date_raw"), F.lit("")),
        F.lit("\n\n    "), F.coalesce("message", F.lit("")), F.lit("\n\n"), F.coalesce("changes", F.lit("")), F.lit("\n"),
    )
    one = commits.join(changes, "commit_id", "left").select("seq", F.floor(F.col("seq") / chunk).alias("chunk_id"), text.alias("x"))
    return one.groupBy("chunk_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x"))), lambda s: s["x"]), "").alias("text"))


def ordered(rows: DataFrame) -> DataFrame:
    """With seq as a number that keeps the order; for the analyses, which break ties by it."""
    return rows.withColumn("seq", F.row_number().over(Window.orderBy("seq")).cast("bigint"))


def _git(path: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", path, *args], capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed in {path}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def problem(path: str) -> str | None:
    """Why there is no log to read in this folder, if so."""
    try:
        _git(path, "rev-parse", "HEAD")
    except (RuntimeError, OSError) as e:
        return str(e)
    return None


class _LogReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def read(self, partition: InputPartition):
        text = _git(self.path, *"log --numstat --no-merges".split()).decode(errors="replace").replace("\r\n", "\n").replace("\r", "\n")
        yield (0, text)


class GitLog(DataSource):
    """``spark.read.format("gitlog").load(repository)``: its log as (chunk_id, text)."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "chunk_id bigint, text string"

    def reader(self, schema) -> _LogReader:
        return _LogReader(self.options["path"])


_EOL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


class _HeadPartition(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _HeadReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_HeadPartition]:
        paths = [p for p in _git(self.path, "ls-files", "-z").decode(errors="replace").split("\0") if p.strip()]
        return [_HeadPartition(paths[i : i + 500]) for i in range(0, len(paths), 500)] or [_HeadPartition([])]

    def read(self, partition: _HeadPartition):
        for path in partition.paths:
            try:
                data = _git(self.path, "show", f"HEAD:{path}")
            except RuntimeError:
                data = b""
            binary = b"\0" in data[:65536]
            last = _git(self.path, *"log -1 --format=%ct --".split(), path).decode().strip()
            yield (path, 0 if binary else len(data.decode(errors="replace").splitlines()), binary, int(last) if last else None)


class GitTree(DataSource):
    """``spark.read.format("gittree").load(repository)``: the files at HEAD as (path, line_count, is_binary, fallback_epoch), a task for each 500."""

    @classmethod
    def name(cls) -> str:
        return "gittree"

    def schema(self) -> str:
        return "path string, line_count bigint, is_binary boolean, fallback_epoch bigint"

    def reader(self, schema) -> _HeadReader:
        return _HeadReader(self.options["path"])


def head_line_counts(texts: DataFrame, *key: str, text: str = "text") -> DataFrame:
    """Lines of each text as they are counted at HEAD: by any line end, and without an empty last one."""
    t = F.coalesce(F.col(text), F.lit(""))
    body = F.when(t.rlike(f"(?s)(?:{_EOL})\\z"), F.regexp_replace(t, f"(?s)(?:{_EOL})\\z", "")).otherwise(t)
    return texts.select(*key, F.when(t == "", F.lit(0)).when(F.contains(F.substring(t, 1, 65536), F.lit("\0")), F.lit(0)).otherwise(F.size(F.split(body, _EOL, -1))).alias("line_count"))
