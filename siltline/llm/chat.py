"""Operator 3: chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. The turns of a conversation are rendered prefix by prefix; where an output continues the one before it, what was
added is the new turn's span. Where it doesn't, the template rewrites history: the turn is marked, the spans of earlier turns that don't lie in
what both outputs begin with become unknown (null), and the new turn is taken to be as much of the end as it shares with its rendering alone.

Scale: one shuffle, by conversation, of whole turns, for all templates; one task needs to hold one conversation at a time. Rendering all prefixes takes time in the square of a conversation's turns, as
black-box rendering does.

Defined cases: turns are ordered by (turn, role, text), nulls first, which also places ties and repeated rows (each is a turn); a null role is rendered as "unknown", a null text as an empty
one (the columns stay null); a turn with a null conv_id is a conversation of its own; an empty table gives no rows; further columns are ignored, whatever their names.

Result, a row for each template and turn: template, conv_id, turn, role, span_start, span_end (characters of the rendered conversation), segment (that part of it), trainable (an assistant's turn), rewrites_history.
Where the template left the turn out or changed it, both ends of the span are -1 and the segment is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Messages = list[tuple[str, str]]


def chatml(messages: Messages) -> str:
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in messages)


def headed(messages: Messages) -> str:
    """Turns under headings, the system's text first of all."""
    return "<s>" + "".join(f"### {role.capitalize()}:\n{text.strip()}\n\n" for role, text in messages)


def last_four(messages: Messages) -> str:
    """For short contexts: the last four turns, so that it rewrites history from the fifth turn on."""
    return chatml(messages[-4:])


def forgetful(messages: Messages) -> str:
    """Drops what an assistant thought (<think>..</think>) from all but the last turn, so that it rewrites history."""
    import re

    return chatml([(role, text if k == len(messages) - 1 else re.sub(r"(?s)<think>.*?</think>\s*", "", text)) for k, (role, text) in enumerate(messages)])


TEMPLATES = {"chatml": chatml, "last_four": last_four}


def common(a: str, b: str) -> int:
    """The length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def locate(render: Callable[[Messages], str], messages: Messages) -> tuple[str, list[tuple[int, int] | None], list[bool]]:
    """(the rendered conversation, the span of each turn or None, whether each turn made the template rewrite history)."""
    before, spans, rewrites = render([]), [], []
    for k in range(1, len(messages) + 1):
        now = render(messages[:k])
        same = common(before, now)
        rewrites.append(same < len(before))
        if rewrites[-1]:
            spans = [s if s and s[1] <= same else None for s in spans]
            spans.append((len(now) - common(now[::-1], render(messages[k - 1 : k])[::-1]), len(now)))
        else:
            spans.append((len(before), len(now)))
        before = now
    return before, spans, rewrites


def _rows(templates: dict[str, Callable[[Messages], str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["template", "conv_id", "turn", "role", "span_start", "span_end", "segment", "trainable", "rewrites_history"]
        for batch in batches:
            kinds = [pa.string(), batch.schema.field(0).type, batch.schema.field(1).type.value_type.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
            rows: list[tuple] = []
            for key, turns in zip(batch.column(0), batch.column(1)):
                turns = turns.as_py()
                messages = [("unknown" if t["role"] is None else t["role"], t["text"] or "") for t in turns]
                for name, render in templates.items():
                    text, spans, rewrites = locate(render, messages)
                    for t, span, rewritten in zip(turns, spans, rewrites):
                        rows.append((name, key.as_py(), t["turn"], t["role"], *((-1, -1, "") if span is None else (*span, text[span[0] : span[1]])), t["role"] == "assistant", rewritten))
                if len(rows) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def formatted(turns: DataFrame, templates: dict[str, Callable[[Messages], str]] | None = None) -> DataFrame:
    """A row for each template (chatml alone, if none is given) and turn, with its place in the rendered conversation."""
    kinds = {n: turns.schema[n].dataType.simpleString() for n in ("conv_id", "turn")}
    said = turns.select("conv_id", F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    whole = said.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).unionByName(said.where("conv_id IS NULL").select("conv_id", F.array("t").alias("turns")))
    return whole.mapInArrow(_rows(templates or {"chatml": chatml}), f"template string, conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, span_start int, span_end int, segment string, trainable boolean, rewrites_history boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations"), TEMPLATES)


SQL = """
WITH made AS (SELECT *, row_number() OVER () AS r, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS s FROM conversations),
placed AS (SELECT *, sum(length(s)) OVER w AS upto, sum(length(s)) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS of_four, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id, CASE WHEN conv_id IS NULL THEN r END) AS turns
  FROM made WINDOW w AS (PARTITION BY conv_id, CASE WHEN conv_id IS NULL THEN r END ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST, r)),
ended AS (SELECT *, 'chatml' AS template, upto AS e, FALSE AS rewrites_history FROM placed
  UNION ALL SELECT *, 'last_four', CASE WHEN turns <= 4 THEN upto WHEN n = turns THEN of_four END, n > 4 FROM placed)
SELECT template, conv_id, turn, role, CAST(coalesce(e - length(s), -1) AS INTEGER) AS span_start, CAST(coalesce(e, -1) AS INTEGER) AS span_end, CASE WHEN e IS NULL THEN '' ELSE s END AS segment, coalesce(role = 'assistant', FALSE) AS trainable, rewrites_history FROM ended
"""
