"""What keeps queries in proportion on large tables: work spread over tasks, cheap tests before patterns."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from siltline.functions import lines as L
from siltline.functions import patterns as P
from siltline.sources import adapters as a
from siltline.sources.snippets import SNIPPETS


def test_source_files_are_spread(spark, tmp_path):
    n = 400
    spark.range(1, n + 1).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    sizes = [r["count"] for r in a.source_files(spark, str(tmp_path)).groupBy(F.spark_partition_id(), "ext").count().where("ext = 'py'").collect()]
    assert sum(sizes) == n and len(sizes) >= 4 and max(sizes) < n / 2  # no language, which may be most of a tree, is one task's


def test_needles():
    assert L.needles(P.BRACE_OPERATORS) == ["&&", "||"] and L.needles(P.COALESCE) == ["??"] and L.needles(P.LONE_ELSE) == ["else"]
    assert L.needles(r"(?i)<script") == L.needles(r"(?i:ab)") == L.needles(r"a?|b") == L.needles(r"\s+(?:ab)?") == []
    texts = [t for _, text in SNIPPETS for t in text.split("\n")]
    for p in {p for lists in P.COMPLEXITY.values() for x in lists for p in x} | set(P.FUNCTION.values()) | {P.NO_NESTING, P.BRACE_OPERATORS, *P.OPERATORS.values()}:
        assert L.needles(p)
        assert all(any(x in t for x in L.needles(p)) for t in texts if re.search(p, t)), p


def test_counts_equal_patterns_alone(spark):
    random.seed(3)
    bits = ["if", "else", " ", "(", ")", "{", "&&", "||", "?", "??", "??=", ":", "while", "for", "case", "catch", "\t", "elif", "and", "or", "if let", "=>", "x", "\u00a0", "I\u017f", "IF"]
    rows = spark.createDataFrame([("".join(random.choice(bits) for _ in range(random.randint(0, 12))),) for _ in range(400)] + [(None,)], "s string")
    patterns = sorted({p for lists in P.COMPLEXITY.values() for x in lists for p in x})
    same = rows.select(F.array(*(L.count(rows["s"], [p]).eqNullSafe(F.regexp_count("s", F.lit(L.FLAGS + p))) & L.matches(rows["s"], p).eqNullSafe(F.col("s").rlike(L.FLAGS + p)) for p in patterns)).alias("same")).collect()
    assert len(same) == 401 and all(all(r.same) for r in same)


def test_white_space_at_the_ends(spark):
    chars = [c for c in range(1, 0x3100)] + [0xFEFF, 0x1F600]
    rows = spark.createDataFrame([(chr(c) + " \t" + chr(c) + "a" + chr(c) + "b\n" + chr(c),) for c in chars] + [("",), (" ",), ("\x1f\u3000",), (None,)], "s string")
    edge = r"[\s\x1c-\x1f]+"
    both, left = F.regexp_replace("s", f"{L.FLAGS}^{edge}|{edge}$", ""), F.length("s") - F.length(F.regexp_replace("s", f"{L.FLAGS}^{edge}", ""))
    assert rows.where(~L.stripped(F.col("s")).eqNullSafe(both) | ~L.indent(F.col("s")).eqNullSafe(left)).count() == 0
