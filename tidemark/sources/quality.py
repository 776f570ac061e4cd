"""File-slot grids, gaps, per-day metrics, coverage and key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAMP_FORMAT = "yyyyMMddHHmmss"


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union by halves: a chain would analyse the first part once per further part."""
    if len(parts) == 1:
        return parts[0]
    half = len(parts) // 2
    return union_all(parts[:half]).unionByName(union_all(parts[half:]))


def expected_slots(bounds: DataFrame, start: str, end: str, minutes: int) -> DataFrame:
    """Every file slot from ``start`` to ``end`` inclusive, one row each.

    ``bounds`` is a one-row frame holding both ends as timestamps. The grid has
    (end - start) / minutes + 1 rows, whatever the data volume.
    """
    step = F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return bounds.select(
        F.explode(F.sequence(F.col(start), F.col(end), step)).alias("slot")
    ).select("slot", F.date_format("slot", STAMP_FORMAT).alias("stamp"))


def slot_grid(spark: SparkSession, start: str, end: str, minutes: int) -> DataFrame:
    """``expected_slots`` for literal bounds."""
    bounds = spark.range(1).select(
        F.lit(start).cast("timestamp_ntz").alias("s"), F.lit(end).cast("timestamp_ntz").alias("e")
    )
    return expected_slots(bounds, "s", "e", minutes)


def expected_files(slots: DataFrame, suffix: str = ".export.CSV") -> DataFrame:
    """Relative path each slot's file lands under: ``date=YYYY-MM-DD/<stamp><suffix>``."""
    folder = F.concat(F.lit("date="), F.date_format("slot", "yyyy-MM-dd"), F.lit("/"))
    return slots.withColumn("file", F.concat(folder, F.col("stamp"), F.lit(suffix)))


def landed_files(spark: SparkSession, path: str, glob: str = "*.export.CSV") -> DataFrame:
    """Files below ``path`` with day, stamp and size; a size of 0 marks a broken landing.

    Only the listing is read: the file contents are pruned from the scan.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    stamp = F.regexp_extract(name, r"^(\d{14})\.", 1)
    return listed.select(
        F.try_to_date(F.substring(stamp, 1, 8), "yyyyMMdd").alias("day"),
        stamp.alias("stamp"),
        name.alias("file"),
        F.col("length").alias("size"),
    )


def landed_metrics(files: DataFrame, rows: DataFrame, day: str) -> DataFrame:
    """Files and rows per landing day, empty files included."""
    counted = rows.groupBy(F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("event_count"))
    per_day = files.groupBy("day").agg(F.count(F.lit(1)).alias("file_count"))
    return per_day.join(counted, "day", "left").select(
        F.col("day").alias("date"),
        "file_count",
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
    )


def slot_of(ts, minutes: int):
    """Start of the slot a timestamp falls in."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    width = int(minutes) * 60
    seconds = F.unix_timestamp(ts.cast("timestamp"))
    floored = seconds - F.pmod(seconds, F.lit(width))
    return F.timestamp_seconds(floored).cast("timestamp_ntz")


def missing_slots(expected: DataFrame, present: DataFrame, key: str = "slot") -> DataFrame:
    """Expected slots with no file. ``present`` may hold a slot many times."""
    return expected.join(present.select(key).distinct(), key, "left_anti")


def file_metrics(rows: DataFrame, day: str, file: str) -> DataFrame:
    """Files and rows per day. Counting per (day, file) first keeps a heavy day spread out."""
    per_file = rows.groupBy(day, file).agg(F.count(F.lit(1)).alias("_n"))
    return per_file.groupBy(day).agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("_n").alias("event_count")
    )


def source_metrics(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row count, first and last day of each source: ``{name: (frame, day column)}``."""
    parts = [
        frame.agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(day).alias("first_date"),
            F.max(day).alias("last_date"),
        ).select(F.lit(name).alias("source"), "rows", "first_date", "last_date")
        for name, (frame, day) in sources.items()
    ]
    return union_all(parts)


def panel_metrics(panel: DataFrame, day: str, names: dict[str, str]) -> DataFrame:
    """``source_metrics`` of aligned series in one pass: ``{source: name}``, where the panel has
    ``has_<name>`` (see ``series.align``)."""
    entries = []
    for source, name in names.items():
        there = F.col(f"has_{name}")
        entries.append(
            F.struct(
                F.lit(source).alias("source"),
                F.count_if(there).alias("rows"),
                F.min(F.when(there, F.col(day))).alias("first_date"),
                F.max(F.when(there, F.col(day))).alias("last_date"),
            )
        )
    return panel.agg(F.array(*entries).alias("_m")).select(F.inline("_m"))


def column_profile(frames: dict[str, DataFrame]) -> DataFrame:
    """(object, column, type, n_rows, n_present) of every column; one pass over each frame."""
    parts = []
    for name, frame in frames.items():
        entries = [
            F.struct(
                F.lit(name).alias("object"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count(F.col(f"`{f.name}`")).alias("n_present"),
            )
            for f in frame.schema.fields
        ]
        parts.append(frame.agg(F.array(*entries).alias("_p")).select(F.inline("_p")))
    return union_all(parts)


def coverage(rows: DataFrame, day: str) -> DataFrame:
    """First and last day, distinct days, and the span they should fill.

    Days are made distinct first, so the final count sees at most one row per day.
    """
    days = rows.select(F.col(day).alias("_d")).filter(F.col("_d").isNotNull()).distinct()
    return days.agg(
        F.min("_d").alias("first_day"),
        F.max("_d").alias("last_day"),
        F.count(F.lit(1)).alias("distinct_days"),
        (F.date_diff(F.max("_d"), F.min("_d")) + 1).alias("span_days"),
    )


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Sanity sweep: rows of every table and view, flagged when empty."""
    parts = [
        frame.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("object"), "n_rows", (F.col("n_rows") == 0).alias("is_empty")
        )
        for name, frame in frames.items()
    ]
    return union_all(parts)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys held by more than one row; an event study needs one value per series and day."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
