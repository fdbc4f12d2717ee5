"""Line-level functions: splitting, stripping, counting, and running state over the lines of a file."""

from __future__ import annotations

import re._parser as parser
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAGS = "(?Ud)"  # Unicode classes and "\\n" as the only line end, for all patterns
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))  # Unicode's white space and the four separators


def stripped(raw: Column) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.trim(raw, F.lit(WHITE))


def indent(raw: Column) -> Column:
    """The number of white characters before the first other; a tab counts as one."""
    return F.length(raw) - F.length(F.ltrim(raw, F.lit(WHITE)))


def needles(pattern: str) -> list[str]:
    """Texts of which any match of the pattern contains at least one; none if that can't be told, as where letters match in any case."""
    parsed = parser.parse(pattern)
    return [] if parsed.state.flags & parser.SRE_FLAG_IGNORECASE else sorted(_needles(parsed))


def _needles(parsed) -> set[str]:
    found, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        if op is parser.LITERAL and arg < 128:
            run += chr(arg)
            continue
        found.append({run} - {""})
        run = ""
        if op is parser.BRANCH:
            each = [_needles(x) for x in arg[1]]
            found.append(set().union(*each) if all(each) else set())
        elif op is parser.SUBPATTERN and not arg[1] & parser.SRE_FLAG_IGNORECASE:
            found.append(_needles(arg[-1]))
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and arg[0] > 0:
            found.append(_needles(arg[2]))
    return max(found, key=lambda x: min(map(len, x), default=0))


def _may_match(text: Column, pattern: str) -> Column:
    """False only where the pattern can't match: to look for a plain text costs a small part of what a pattern costs, and most lines hold none."""
    return reduce(lambda a, b: a | b, (text.contains(x) for x in needles(pattern)), F.lit(False)) if needles(pattern) else F.lit(True)


def count(text: Column, patterns: list[str]) -> Column:
    """How often the patterns match, taken one after the other."""
    out = F.lit(0)
    for p in patterns:
        out = out + F.when(~_may_match(text, p), F.lit(0)).otherwise(F.regexp_count(text, F.lit(FLAGS + p)))
    return out


def matches(text: Column, pattern: str, made=lambda text: text) -> Column:
    """Whether the pattern is found in the text, or in what is made of it by a function that leaves the pattern's needles as they are."""
    return _may_match(text, pattern) & made(text).rlike(FLAGS + pattern)


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank: the declaration patterns match the same, and can't run out of stack."""
    return F.regexp_replace(text, f"{FLAGS}\\s{{2,}}", " ")


def sequences(text: Column, operators: str) -> Column:
    """The number of runs of equal operators in the text."""
    ops = F.regexp_extract_all(text, F.lit(f"{FLAGS}({operators})"), F.lit(1))
    return F.when(~_may_match(text, operators), F.lit(0)).otherwise(F.size(F.filter(ops, lambda x, i: (i == 0) | (x != F.element_at(ops, F.greatest(i, F.lit(1)))))))


def tags_opened(text: Column, void: list[str]) -> Column:
    """Opening tags that stay open: not self-closed, not of a kind that has no content."""
    found = F.regexp_extract_all(text, F.lit(FLAGS + r"<(\w+)[^>]*>"), F.lit(0))
    names = F.transform(found, lambda t: F.struct(t.alias("t"), F.lower(F.regexp_extract(t, FLAGS + r"^<(\w+)", 1)).alias("n")))
    return F.size(F.filter(names, lambda s: ~F.endswith(s["t"], F.lit("/>")) & ~s["n"].isin(void)))


def split_lines(files: DataFrame, text: str = "content") -> DataFrame:
    """A row for each line, numbered from 1: all columns but the text, with raw and s, the stripped line. A final line end makes an empty last line."""
    others = [c for c in files.columns if c != text]
    lines = files.select(*others, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "raw"))
    return lines.withColumn("line_no", F.col("line_no") + 1).withColumn("s", stripped(F.col("raw")))


class Order:
    """Windows over the lines of a file."""

    def __init__(self, *key: str) -> None:
        order = Window.partitionBy(*key).orderBy("line_no")
        self.all = Window.partitionBy(*key)
        self.next = order
        self.until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.before = order.rowsBetween(Window.unboundedPreceding, -1)

    def state_before(self, event: Column) -> Column:
        """The last event before the line; 0 if there was none."""
        return F.coalesce(F.last(event, ignorenulls=True).over(self.before), F.lit(0))

    def state(self, event: Column) -> Column:
        return F.coalesce(F.last(event, ignorenulls=True).over(self.until), F.lit(0))

    def floored(self, total: Column) -> Column:
        """What a running sum becomes if it is never let under 0."""
        return total - F.least(F.lit(0), F.min(total).over(self.until))
