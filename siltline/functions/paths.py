"""Predicates and classes of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import GENERATED, LANG_OF_EXT, LABELS, LOGGING_EXTS, LOGGING_SKIP_DIRS, SKIP_DIRS


def mapped(value: Column, table: dict[str, str], default: Column) -> Column:
    keys = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(keys, value), default)


def lang_of(ext: Column, logging: bool = False) -> Column:
    known = {e: lang for e, lang in LANG_OF_EXT.items() if not logging or lang != "html"}
    return mapped(F.lower(ext), known, F.lit("unknown"))


def label_of(lang: Column) -> Column:
    return mapped(lang, LABELS, lang)


def known_extension(logging: bool = False) -> Column:
    """An extension of the list, and not the name of a generated file."""
    out = F.lower("ext").isin(LOGGING_EXTS if logging else sorted(LANG_OF_EXT))
    for tail in GENERATED:
        out = out & ~F.col("fname").endswith(tail)
    return out


def outside_skipped(logging: bool = False) -> Column:
    """No directory of the path is one that is never looked into; names are compared exactly."""
    parts = F.split("path", "/")
    return ~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, LOGGING_SKIP_DIRS if logging else SKIP_DIRS)))


def chosen(files: DataFrame, logging: bool = False) -> DataFrame:
    """The files that are analysed, with their language. Only path columns decide, so contents of other files are never touched."""
    return files.where(known_extension(logging) & outside_skipped(logging)).withColumn("lang", lang_of(F.col("ext"), logging))


def excluded(patterns: list[str]) -> Column:
    """Whether one of the user's patterns fits: ending, directory, file name, directory name, glob or part of the path; in any case of letters."""
    path, name = F.lower("path"), F.lower("fname")
    out = F.lit(False)
    for p in (x.strip().lower() for x in patterns):
        if not p:
            continue
        if p.startswith("."):
            out = out | name.endswith(p)
        if p.endswith("/"):
            out = out | F.contains(F.concat(F.lit("/"), path, F.lit("/")), F.lit("/" + p)) | path.startswith(p)
        out = out | (name == p)
        if not ("/" in p or p.startswith(".")):
            out = out | F.contains(F.concat(F.lit("/"), path), F.lit(f"/{p}/"))
        out = out | path.rlike(_glob(p))
        if "/" in p:
            out = out | path.contains(p)
    return out


def _glob(pattern: str) -> str:
    """fnmatch as a Java pattern: its own translation, without what only Python writes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            inner = pattern[i:end].replace("\\", "\\\\").replace("&", "\\&").replace("[", "\\[")
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else "\\" + inner if inner.startswith("^") else inner) + "]"
            i = end + 1
        else:
            out += c if c.isalnum() or c in "_ " else "\\" + c if ord(c) < 128 else c
    return f"(?s)^{out}\\z"


def category(path: Column, lang: Column) -> Column:
    """test, markup, types, config, ui or business: the first that fits."""
    p = F.lower(path)

    def any_of(test, words: str) -> Column:
        out = F.lit(False)
        for w in words.split():
            out = out | test(w)
        return out

    test = any_of(p.contains, "_test. .test. /test/ /__tests__/ test.java tests.cs")
    types = any_of(p.endswith, "types.ts types.tsx") | p.contains("/types/")
    config = any_of(p.endswith, "config.ts config.tsx config.js config.mjs config.cs startup.cs program.cs") | p.contains("setup")
    ui = p.contains("/ui/")  # and so /components/ui/
    return F.when(test, F.lit("test")).when(lang == "html", F.lit("markup")).when(types, F.lit("types")).when(config, F.lit("config")).when(ui, F.lit("ui")).otherwise(F.lit("business"))


