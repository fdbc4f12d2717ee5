"""Source trees as a Spark data source: ``spark.read.format("source_tree").load(directory)``.

Spark's own file index passes over names that begin with "_" or ".", so trees are walked here. The walk prunes directories and compares names and endings before any file is opened; a task reads
200 files. Bytes that are no UTF-8 are dropped, line ends become "\\n". A file that can't be read gives a row with its error and no content.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltline.functions.config import GENERATED, LANG_OF_EXT, LOGGING_EXTS, LOGGING_SKIP_DIRS, SKIP_DIRS


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def walk(root: str, logging: bool = False) -> Iterator[str]:
    """Paths, relative and with "/", of the files of a tree that are analysed."""
    skipped, exts = (LOGGING_SKIP_DIRS, LOGGING_EXTS) if logging else (SKIP_DIRS, LANG_OF_EXT)
    for folder, below, names in os.walk(root):
        below[:] = sorted(d for d in below if d not in skipped)
        for name in sorted(names):
            if os.path.splitext(name)[1].lstrip(".").lower() in exts and not name.endswith(tuple(GENERATED)):
                yield os.path.relpath(os.path.join(folder, name), root).replace(os.sep, "/")


class _Reader(DataSourceReader):
    def __init__(self, root: str, logging: bool) -> None:
        if not os.path.isdir(root):
            raise NotADirectoryError(f"{root} is not a directory")
        self.root, self.logging = root, logging

    def partitions(self) -> list[_Files]:
        paths = list(walk(self.root, self.logging))
        return [_Files(paths[i : i + 200]) for i in range(0, len(paths), 200)] or [_Files([])]

    def read(self, partition: _Files):
        for path in partition.paths:
            name = path.rsplit("/", 1)[-1]
            ext = os.path.splitext(name)[1].lstrip(".")
            try:
                with open(os.path.join(self.root, path), encoding="utf-8", errors="ignore", newline=None) as f:
                    yield (path, name, ext, f.read(), None)
            except OSError as e:
                yield (path, name, ext, None, str(e))


class SourceTree(DataSource):
    """Options: ``logging`` ("true": with the extensions and directories of the logging analyses)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, fname string, ext string, content string, error string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("logging", "false").lower() == "true")


def register(spark) -> None:
    """Make the data sources known to a session."""
    from .gitlog import GitLog, GitTree

    for source in (SourceTree, GitLog, GitTree):
        spark.dataSource.register(source)
