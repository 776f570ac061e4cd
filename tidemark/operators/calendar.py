"""Trading-calendar operators: forward snap and the per-day impact table.

Every measure of the event study depends on an event's date only. So the snap and all
horizons are worked out once per calendar day (a grid of a few thousand rows, however many
events there are) and events pick up their row with one equi-join: no range join, no
shuffle of the event side.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import pct_move
from tidemark.operators.bounds import bounded_broadcast, span_days


def calendar_range(calendar: DataFrame, day: str) -> tuple[date, date]:
    """First and last day of a calendar; two values reach the driver."""
    row = calendar.agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    if row is None or row.a is None:
        raise ValueError("the trading calendar is empty")
    return row.a, row.b


def dense_days(spark: SparkSession, first: date, last: date, name: str = "day") -> DataFrame:
    """One row per calendar day of a closed range."""
    return spark.range(0, span_days(first, last), 1, 1).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias(name)
    )


def snap_map(
    calendar: DataFrame,
    day: str,
    first: date,
    last: date,
    carry: Sequence[str] = (),
    name: str = "day",
) -> DataFrame:
    """Each day of the range with the first calendar day at or after it (NULL past the end).

    ``carry`` columns of the snapped calendar row travel along. One running ``last`` over
    descending days does it in a single pass of a window whose size is the range in days.
    """
    grid = dense_days(calendar.sparkSession, first, last, name)
    marked = calendar.select(F.col(day).alias("_cal"), *carry).filter(
        F.col("_cal").between(F.lit(first), F.lit(last))
    )
    backwards = Window.orderBy(F.col(name).desc()).rowsBetween(Window.unboundedPreceding, 0)
    row = F.when(F.col("_cal").isNotNull(), F.struct(F.col("_cal").alias("d"), *carry))
    return grid.join(marked, F.col(name) == F.col("_cal"), "left").select(
        name,
        F.col("_cal").isNotNull().alias("is_calendar_day"),
        F.last(row, ignorenulls=True).over(backwards).alias("snap"),
    )


def fwd_snap(
    df: DataFrame,
    calendar: DataFrame,
    on: str,
    out: str,
    day: str = "d",
    window: tuple[date, date] | None = None,
    plus_days: int = 0,
) -> DataFrame:
    """Forward as-of: the first calendar day at or after ``on`` + ``plus_days``.

    ``window`` is the calendar's day range; it is read from the calendar when not given.
    Targets before the range snap to the first calendar day, targets past it give NULL.
    """
    first, last = window or calendar_range(calendar, day)
    days = calendar.select(day).distinct()
    lookup = snap_map(days, day, first, last, name="_day").select(
        "_day", F.col("snap.d").alias(out)
    )
    target = F.greatest(F.date_add(F.col(on), plus_days), F.lit(first))
    # greatest skips NULLs, so a missing date must not fall back to the first day
    keyed = df.withColumn("_target", F.when(F.col(on).isNotNull(), target))
    lookup = bounded_broadcast(lookup, span_days(first, last), 64)
    return keyed.join(lookup, F.col("_target") == F.col("_day"), "left").drop("_target", "_day")


def fwd_snap_by(df: DataFrame, calendar: DataFrame, by: str, on: str, out: str, day: str = "d"):
    """``fwd_snap`` with one calendar per ``by`` value, any number of them.

    The map is keyed (by, day), so a heavy ``by`` value is spread over its days.
    """
    ranges = calendar.groupBy(by).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    grid = ranges.select(
        by, F.explode(F.sequence("_first", "_last", F.expr("INTERVAL 1 DAY"))).alias("_day")
    )
    marked = calendar.select(by, F.col(day).alias("_day"), F.col(day).alias("_cal")).distinct()
    backwards = (
        Window.partitionBy(by)
        .orderBy(F.col("_day").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    lookup = grid.join(marked, [by, "_day"], "left").select(
        by, "_day", F.last("_cal", ignorenulls=True).over(backwards).alias(out)
    )
    keyed = df.join(ranges.select(by, "_first"), by, "left").withColumn(
        "_day", F.when(F.col(on).isNotNull(), F.greatest(F.col(on), F.col("_first")))
    )
    return keyed.join(lookup, [by, "_day"], "left").drop("_day", "_first")


def impact_table(
    panel: DataFrame,
    cols: Sequence[str],
    horizons: Sequence[int],
    window: tuple[date, date],
    day: str = "price_date",
    anchor: str = "event",
) -> DataFrame:
    """Per calendar day: t0, each horizon's snapped day, values and % moves (not rounded).

    ``panel`` holds one row per trading day of the anchor calendar. ``anchor='event'`` snaps
    day + k calendar days; ``anchor='t0'`` snaps t0 + k calendar days. The two differ for
    days that are no trading day.
    """
    if anchor not in ("event", "t0"):
        raise ValueError("anchor is 'event' or 't0'")
    first, last = window
    backwards = Window.orderBy(F.col("day").desc())
    running = backwards.rowsBetween(Window.unboundedPreceding, 0)
    days = snap_map(panel, day, first, last, carry=cols)
    # the grid has no gaps, so "k days later" is k rows up
    ahead = days.select(
        "day",
        "is_calendar_day",
        "snap",
        *[F.lag("snap", k).over(backwards).alias(f"_h{k}") for k in horizons],
    )
    if anchor == "t0":
        at_t0 = F.struct(*[F.col(f"_h{k}") for k in horizons])
        own = F.last(F.when(F.col("is_calendar_day"), at_t0), ignorenulls=True).over(running)
        ahead = ahead.select("day", "is_calendar_day", "snap", own.alias("_own")).select(
            "day", "is_calendar_day", "snap", *[F.col(f"_own._h{k}") for k in horizons]
        )
    out = [F.col("day"), F.col("is_calendar_day"), F.col("snap.d").alias("t0_date")]
    out += [F.col(f"snap.{c}").alias(f"{c}_t") for c in cols]
    for k in horizons:
        out.append(F.col(f"_h{k}.d").alias(f"t{k}_date"))
        for c in cols:
            out.append(F.col(f"_h{k}.{c}").alias(f"{c}_t{k}"))
            out.append(pct_move(F.col(f"snap.{c}"), F.col(f"_h{k}.{c}")).alias(f"{c}_move_{k}d"))
    return ahead.select(*out)


def attach_impacts(
    events: DataFrame, impacts: DataFrame, on: str, window: tuple[date, date]
) -> DataFrame:
    """Events with the impact row of their date: one equi-join on a per-day lookup."""
    first, last = window
    lookup = bounded_broadcast(
        impacts.drop("is_calendar_day").withColumnRenamed("day", "_day"), span_days(first, last)
    )
    # a day before the range has the same snaps as the first day only if every horizon still
    # ends before the range, so callers start the range max(horizons) days early
    target = F.when(F.col(on).isNotNull(), F.greatest(F.col(on), F.lit(first)))
    return (
        events.withColumn("_target", target)
        .join(lookup, F.col("_target") == F.col("_day"), "left")
        .drop("_target", "_day")
    )
