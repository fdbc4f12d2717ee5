"""Cyclomatic and cognitive complexity, nesting and line counts of source files, by window functions over their lines.

All that a line says by itself is counted first; one shuffle by file then brings these numbers together (of markup, also the lines, which may belong to a script), and all windows share its partitioning and order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltline.functions.config import BRACE_LANGS, INDENT_LANGS
from siltline.functions.lines import Order, count, indent, matches, sequences, split_lines, squeezed, tags_opened
from siltline.functions.patterns import BRACE_OPERATORS, COMPLEXITY, FUNCTION, NO_NESTING, OPERATORS

VOID = "area base br col embed hr img input link meta param source track wbr".split()
METRICS = ["total_lines", "code_lines", "comment_lines", "blank_lines", "cyclomatic", "cognitive", "max_nesting", "functions"]


def by_lang(make, langs: list[str], default: Column) -> Column:
    """make(lang) for each language, chosen by the column lang."""
    return reduce(lambda rest, lang: F.when(F.col("lang") == lang, make(lang)).otherwise(rest), langs, default)


def _counts(which: int, langs: list[str]) -> Column:
    """Matches of one of the three pattern lists; each pattern is counted once, for the languages that have it."""
    out = F.lit(0)
    for p in dict.fromkeys(p for lang in langs for p in COMPLEXITY[lang][which]):
        own = [lang for lang in langs if p in COMPLEXITY[lang][which]]
        n = count(F.col("s"), [p])
        out = out + (n if own == langs else F.when(F.col("lang").isin(own), n).otherwise(F.lit(0)))
    return out


def _is_function(langs: list[str]) -> Column:
    """Declarations. White space isn't in what a declaration can't do without, so that is looked for before runs of it are squeezed."""
    return by_lang(lambda lang: matches(F.col("s"), FUNCTION[lang], squeezed).cast("int"), [x for x in langs if x in FUNCTION], F.lit(0))


def _code(value: Column) -> Column:
    return F.when(F.col("code"), value).otherwise(F.lit(0))


def _brace_flags() -> dict[str, Column]:
    """What a line of a brace language says of itself."""
    s = F.col("s")
    return {
        "blank": s == "", "event": F.when(s.startswith("/*") & ~s.contains("*/"), F.lit(1)).when(s.contains("*/"), F.lit(0)), "starts": s.startswith("//") | s.startswith("/*") | ((F.col("lang") == "php") & s.startswith("#")),
    }


def classify_brace(lines: DataFrame, *key: str) -> DataFrame:
    """Lines of brace languages, from their flags, with blank, comment and code."""
    out = lines.withColumn("comment", ~F.col("blank") & ((Order(*key).state_before(F.col("event")) == 1) | F.col("starts")))
    return out.withColumn("code", ~F.col("blank") & ~F.col("comment"))


def brace_lines(lines: DataFrame, *key: str) -> DataFrame:
    """Lines with their counts, and the depth of braces before (after the line's closing ones) and after. All is counted before the shuffle, which carries no text."""
    order, s = Order(*key), F.col("s")
    braces = {c: F.length("s") - F.length(F.replace("s", F.lit(c), F.lit(""))) for c in "{}"}
    counted = lines.select(
        *key, "lang", "line_no", *(c.alias(n) for n, c in _brace_flags().items()), braces["{"].alias("opened"), braces["}"].alias("closed"), _counts(0, BRACE_LANGS).alias("cc"), _counts(1, BRACE_LANGS).alias("struct"),
        (_counts(2, BRACE_LANGS) + sequences(s, BRACE_OPERATORS)).alias("flat"), _is_function(BRACE_LANGS).alias("is_function"), matches(s, NO_NESTING).alias("plain"),
    )
    out = classify_brace(counted, *key)
    out = out.select(*key, "lang", "line_no", "blank", "comment", "code", *(_code(F.col(c)).alias(c) for c in ("opened", "closed", "cc", "struct", "flat", "is_function")), (F.col("code") & F.col("plain")).alias("plain"))
    out = out.withColumn("step", F.lag("opened", 1, 0).over(order.next) - F.col("closed")).withColumn("total", F.sum("step").over(order.until))
    out = out.withColumn("depth", order.floored(F.col("total"))).drop("step", "total")
    return out.withColumn("after", F.col("depth") + F.col("opened"))


def _not_nesting(lines: Column) -> Column:
    """How often structural lines of lines(line_no, depth, opened, struct, plain) are inside braces that don't nest, the first ones of "plain" lines. The stack holds, for each open brace, how many of it and those around it don't."""

    def around(stack: Column, depth: Column) -> Column:
        return F.when(depth > 0, F.coalesce(F.get(stack, depth - 1), F.lit(0))).otherwise(F.lit(0))

    def read(state: Column, x: Column) -> Column:
        pushed = F.array_repeat(around(state["stack"], x["depth"]) + x["plain"].cast("int"), x["opened"])
        stack = F.when(x["opened"] > 0, F.concat(F.slice(state["stack"], 1, x["depth"]), pushed)).otherwise(state["stack"])
        return F.struct(stack.alias("stack"), (state["less"] + x["struct"] * around(state["stack"], x["depth"])).alias("less"))

    start = F.struct(F.array().cast("array<int>").alias("stack"), F.lit(0).alias("less"))
    return F.aggregate(F.array_sort(lines), start, read)["less"]


def brace_metrics(lines: DataFrame, *key: str) -> DataFrame:
    """Metrics of each file (or other unit) of brace languages. lines: key, lang, line_no, s. One shuffle, by the key."""
    marked = F.when((F.col("opened") > 0) | ((F.col("struct") > 0) & (F.col("depth") > 0)), F.struct("line_no", "depth", "opened", "struct", "plain"))
    base = brace_lines(lines, *key).groupBy(*key, "lang").agg(
        F.count("*").alias("total_lines"), F.count_if("code").alias("code_lines"), F.count_if("comment").alias("comment_lines"), F.count_if("blank").alias("blank_lines"),
        (F.lit(1) + F.sum("cc")).alias("cyclomatic"), F.sum(F.col("struct") * (1 + F.col("depth")) + F.col("flat")).alias("cog"), F.max("after").alias("max_nesting"), F.sum("is_function").alias("functions"),
        F.collect_list(marked).alias("marked"), F.bool_or(F.col("plain") & (F.col("opened") > 0)).alias("any_plain"),
    )
    out = base.withColumn("cognitive", F.col("cog") - F.when(F.col("any_plain"), _not_nesting(F.col("marked"))).otherwise(F.lit(0)))
    return out.select(*key, "lang", *(F.col(m).cast("bigint").alias(m) for m in METRICS))


def indent_lines(lines: DataFrame, *key: str) -> DataFrame:
    """Lines of indentation languages with kinds, nesting and counts, which are made before the shuffle."""
    s, order = F.col("s"), Order(*key)
    triple = s.contains('"""') | s.contains("'''")
    starts = s.startswith('"""') | s.startswith("'''")
    rest = F.substring(s, 4, 1 << 30)
    toggles = (F.col("lang") == "py") & starts & ~(rest.contains('"""') | rest.contains("'''"))
    resets = (F.col("lang") == "py") & triple & ~toggles
    ruby = F.when(F.col("lang") == "ruby", F.when(s.startswith("=begin"), F.lit(1)).when(s.startswith("=end"), F.lit(0)))
    opens = s.startswith("#") | ((F.col("lang") == "py") & starts) | ((F.col("lang") == "ruby") & s.startswith("=begin"))
    runs = by_lang(lambda lang: sequences(s, OPERATORS[lang]), list(OPERATORS), F.lit(0))
    out = lines.select(
        *key, "lang", "line_no", (s == "").alias("blank"), toggles.cast("int").alias("toggles"), resets.alias("resets"), ruby.alias("event"), opens.alias("opens"), indent(F.col("raw")).alias("indent"),
        _counts(0, INDENT_LANGS).alias("cc"), _counts(1, INDENT_LANGS).alias("struct"), (_counts(2, INDENT_LANGS) + runs).alias("flat"), _is_function(INDENT_LANGS).alias("is_function"),
    )
    out = out.withColumn("sum_t", F.sum("toggles").over(order.until))
    at_reset = F.coalesce(F.last(F.when(F.col("resets"), F.col("sum_t")), ignorenulls=True).over(order.before), F.lit(0))
    doc = F.pmod(F.col("sum_t") - F.col("toggles") - at_reset, F.lit(2)) == 1
    begin = order.state_before(F.col("event")) == 1
    out = out.withColumn("inside", F.when(F.col("lang") == "py", doc).when(F.col("lang") == "ruby", begin).otherwise(F.lit(False)))
    out = out.withColumn("comment", ~F.col("blank") & (F.col("inside") | F.col("opens"))).withColumn("code", ~F.col("blank") & ~F.col("comment"))
    out = out.withColumn("indent", _code(F.col("indent")))
    unit = F.first(F.when(F.col("indent") > 0, F.col("indent")), ignorenulls=True).over(order.until)
    nest = F.coalesce(F.floor(F.col("indent") / unit), F.lit(0)).cast("int")
    return out.select(*key, "lang", "line_no", "blank", "comment", "code", nest.alias("nest"), *(_code(F.col(c)).alias(c) for c in ("cc", "struct", "flat", "is_function")))


def indent_metrics(lines: DataFrame, *key: str) -> DataFrame:
    rows = indent_lines(lines, *key)
    out = rows.groupBy(*key, "lang").agg(
        F.count("*").alias("total_lines"), F.count_if("code").alias("code_lines"), F.count_if("comment").alias("comment_lines"), F.count_if("blank").alias("blank_lines"),
        (F.lit(1) + F.sum("cc")).alias("cyclomatic"), F.sum(F.col("struct") * (1 + F.col("nest")) + F.col("flat")).alias("cognitive"), F.max(_code(F.col("nest"))).alias("max_nesting"), F.sum("is_function").alias("functions"),
    )
    return out.select(*key, "lang", *(F.col(m).cast("bigint").alias(m) for m in METRICS))


def html_lines(lines: DataFrame, *key: str) -> DataFrame:
    """Lines of markup with kinds, the depth of tags after the line, and whether they belong to a script."""
    s, order = F.col("s"), Order(*key)
    opens, closes = s.contains("<!--"), s.contains("-->")
    script = F.when(matches(s, r"(?i)</script>"), F.lit(0)).when(matches(s, r"(?i)<script[^>]*>"), F.lit(1))
    out = lines.drop("raw").withColumn("blank", s == "").withColumn("opens", opens & ~closes).withColumn("event", F.when(opens & ~closes, F.lit(1)).when(closes, F.lit(0)))
    out = out.withColumn("tag", script).withColumn("change", tags_opened(s, VOID) - count(s, [r"</(\w+)>"]))
    out = out.withColumn("comment", ~F.col("blank") & ((order.state_before(F.col("event")) == 1) | F.col("opens"))).withColumn("code", ~F.col("blank") & ~F.col("comment"))
    out = out.withColumn("script", F.col("code") & (order.state(F.when(F.col("code"), F.col("tag"))) == 1))
    out = out.withColumn("total", F.sum(_code(F.col("change"))).over(order.until))
    return out.withColumn("depth", order.floored(F.col("total")))


def html_metrics(lines: DataFrame, *key: str) -> DataFrame:
    """Metrics of markup; its script lines, joined, are analysed as JavaScript."""
    rows = html_lines(lines, *key)
    base = rows.groupBy(*key, "lang").agg(F.count("*").alias("total_lines"), F.count_if("code").alias("code_lines"), F.count_if("comment").alias("comment_lines"), F.count_if("blank").alias("blank_lines"), F.max(_code(F.col("depth"))).alias("max_nesting"))
    scripts = brace_metrics(rows.where("script").select(*key, F.lit("js").alias("lang"), "line_no", "s"), *key).select(*key, "cyclomatic", "cognitive")
    out = base.join(scripts, list(key), "left").withColumn("functions", F.lit(0))
    return out.select(*key, "lang", *(F.coalesce(F.col(m), F.lit(0)).cast("bigint").alias(m) for m in METRICS))


def file_metrics(files: DataFrame) -> DataFrame:
    """Metrics of files(path, lang, content) of all languages."""
    lines = split_lines(files.select("path", "lang", "content"))
    brace = brace_metrics(lines.where(~F.col("lang").isin([*INDENT_LANGS, "html"])), "path")
    return brace.unionByName(indent_metrics(lines.where(F.col("lang").isin(INDENT_LANGS)), "path")).unionByName(html_metrics(lines.where("lang = 'html'"), "path"))
