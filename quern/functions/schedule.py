"""Cron: a five-field expression as a predicate over a timestamp column (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lowest and highest number of each field.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")


def _number(text: str, field: str) -> int:
    names = {"month": {m: k for k, m in enumerate(MONTHS, 1)}, "weekday": {d: k for k, d in enumerate(DAYS)}}.get(field, {})
    return names[text[:3].lower()] if text[:3].lower() in names else int(text)


def values(expression: str, field: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in expression.split(","):
        span, _, step = part.partition("/")
        if span in ("*", "?"):
            a, b = low, high
        elif "-" in span:
            a, b = (_number(x, field) for x in span.split("-", 1))
        else:
            a = _number(span, field)
            b = high if step else a
        if not low <= a <= b <= high or (step and int(step) < 1):
            raise ValueError(f"bad {field} in a cron expression: {part}")
        out |= set(range(a, b + 1, int(step or 1)))
    return {v % 7 for v in out} if field == "weekday" else out


def cron_match(ts: Column, expression: str) -> Column:
    """The minute of ts fits. All five fields must; weekdays are 0 to 7, 0 and 7 being Sunday."""
    parts = expression.split()
    if len(parts) != 5:
        raise ValueError("a cron expression has five fields")
    of = (F.minute(ts), F.hour(ts), F.dayofmonth(ts), F.month(ts), F.dayofweek(ts) - 1)
    out = F.lit(True)
    for part, column, (field, low, high) in zip(parts, of, FIELDS, strict=True):
        allowed = values(part, field, low, high)
        if len(allowed) < (7 if field == "weekday" else high - low + 1):
            out = out & column.isin(sorted(allowed))
    return out
