"""Functions of source files: where they begin and end, and their own metrics."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.functions.config import INDENT_LANGS
from siltline.functions.lines import split_lines
from siltline.functions.patterns import FUNCTION, NOT_NAMES

from .complexity import brace_metrics

_PATTERNS = {lang: re.compile(p) for lang, p in FUNCTION.items() if lang not in INDENT_LANGS}
_GENERIC_NAME = re.compile(r"\w*\Z")


def name_before(text: str) -> str:
    """The identifier at the end of what comes before a parenthesis, past blanks and one balanced <...>; "?" if it is none or a keyword."""
    left = text.rstrip(" ")
    if left.endswith(">"):
        depth, at = 0, len(left)
        while at > 0:
            at -= 1
            depth += {">": 1, "<": -1}.get(left[at], 0)
            if depth == 0:
                break
        left = left[:at]
    name = _GENERIC_NAME.search(left)[0]
    return "?" if not name or name in NOT_NAMES else name


def boundaries(text: str, lang: str) -> list[tuple[str, int, int]]:
    """(name, first line, last line), from 1, of each function; those inside another are not looked for.

    The end is the first closing brace that brings the depth back to where the declaration found it. Positions of closing braces are kept by depth, so each search is a bisection."""
    pattern = _PATTERNS.get(lang)
    if pattern is None:
        return []
    lines = text.split("\n")
    begins, depth_at, opening, closing, owner = [], [0], [], {}, []
    for number, line in enumerate(lines):
        begins.append(len(owner))
        for brace in re.findall("[{}]", line):
            depth_at.append(depth_at[-1] + (1 if brace == "{" else -1))
            if brace == "{":
                opening.append(len(owner))
            else:
                closing.setdefault(depth_at[-1], []).append(len(owner))
            owner.append(number)
    found, inside, i = [], False, 0
    while i < len(lines):
        s = lines[i].strip()
        at, i = i, i + 1
        if inside:
            inside = "*/" not in s
        elif s.startswith("/*"):
            inside = "*/" not in s
        elif not s.startswith("//") and (not s.startswith("[") or s.startswith("[Key")) and pattern.search(s):
            k = bisect_left(opening, begins[at])
            if k < len(opening):
                ends = closing.get(depth_at[begins[at]], [])
                j = bisect_left(ends, opening[k])
                if j < len(ends):
                    paren = s.find("(")
                    found.append((name_before(s[:paren]) if paren > 0 else "?", at + 1, owner[ends[j]] + 1))
                    i = owner[ends[j]] + 1
    return found


_FOUND = "path string, lang string, name string, start_line int, end_line int"


def _find(bodies: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "lang", "name", "start_line", "end_line", *(["content"] if bodies else [])]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for path, lang, text in zip(*(batch.column(c).to_pylist() for c in ("path", "lang", "content"))):
                found = boundaries(text or "", lang)
                if found:
                    lines = text.split("\n") if bodies else None
                    rows = [(path, lang, *f, *(["\n".join(lines[f[1] - 1 : f[2]])] if bodies else [])) for f in found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def functions(files: DataFrame, bodies: bool = False) -> DataFrame:
    """(path, lang, name, start_line, end_line) of all functions of files(path, lang, content); with their lines as content, if wanted.

    The search is sequential within a file, so it runs in Python, a batch of files at a time."""
    some = files.where(F.col("lang").isin(sorted(_PATTERNS))).select("path", "lang", "content")
    return some.mapInArrow(_find(bodies), _FOUND + (", content string" if bodies else ""))


def function_metrics(files: DataFrame) -> DataFrame:
    """Each function analysed on its own; its own braces are not a level of nesting. The search hands on the functions' lines, so that files are searched once and not joined with their lines."""
    metrics = brace_metrics(split_lines(functions(files, True)), "path", "name", "start_line", "end_line")
    return metrics.select("path", "name", "start_line", "end_line", "code_lines", "cyclomatic", "cognitive", F.greatest(F.lit(0), F.col("max_nesting") - 1).alias("max_nesting"))
