"""Date functions of the history analyses. The session's time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import MONTHS

_MONTH_NAMES = "January February March April May June July August September October November December".split()


def year_of(raw: Column) -> Column:
    """The first four digits in a row, as text; null if there are none."""
    found = F.regexp_extract(raw, r"(\d{4})", 1)
    return F.when(found != "", found)


def month_of(raw: Column) -> Column:
    """The number, as two digits, of the first month named in the text; null if there is none."""
    name = F.lower(F.regexp_extract(raw, r"(?i)\b(" + "|".join(MONTHS) + r")", 1))
    out = F.lit(None).cast("string")
    for i, m in enumerate(MONTHS):
        out = F.when(name == m.lower(), F.lit(f"{i + 1:02d}")).otherwise(out)
    return out


def instant(raw: Column) -> Column:
    """The instant of a date in the default form of logs (with weekday and offset) or in ISO form; null otherwise."""
    default = F.try_to_timestamp(F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3}\s+", ""), F.lit("MMM d HH:mm:ss yyyy Z"))
    iso = F.when(F.trim(raw).rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$"), F.try_to_timestamp(F.trim(raw)))
    return F.when(raw.rlike(r"^\s*[A-Za-z]{3}\s+[A-Za-z]{3}\s"), default).otherwise(iso)
