"""Event windows over days: range join by day expansion."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bounds import bounded_broadcast, span_days


def window_days(events: DataFrame, on: str, days: int, name: str = "day") -> DataFrame:
    """Distinct days within +/- ``days`` of any event."""
    near = F.sequence(F.date_sub(F.col(on), days), F.date_add(F.col(on), days))
    return events.select(F.explode(near).alias(name)).distinct()


def within_windows(
    rows: DataFrame, events: DataFrame, on: str, days: int, day: str, window: tuple[date, date]
) -> DataFrame:
    """Rows whose day lies within +/- ``days`` of an event, each kept once.

    The windows become days, so the range condition is an equi semi-join; overlapping windows
    do not repeat a row. ``window`` is the closed day range of the study: only its days can
    match, which bounds the day list.
    """
    first, last = window
    near = window_days(events, on, days, "_near").filter(
        F.col("_near").between(F.lit(first), F.lit(last))
    )
    near = bounded_broadcast(near, span_days(first, last), 16)
    kept = rows.filter(F.col(day).between(F.lit(first), F.lit(last)))
    return kept.join(near, kept[day] == near["_near"], "left_semi")
