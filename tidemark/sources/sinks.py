"""Sinks: partitioned columnar copies, CSV exports, and appends that skip known keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stamp_day(stamp: Column | str) -> Column:
    """Partition day of a ``yyyyMMddHHmmss`` stamp."""
    stamp = F.col(stamp) if isinstance(stamp, str) else stamp
    return F.try_to_date(F.substring(stamp, 1, 8), "yyyyMMdd")


def write_partitioned(df: DataFrame, path: str, by: str = "date", fmt: str = "parquet") -> None:
    """Write below ``by=value`` folders; a re-run replaces only the days it carries.

    The rebalance hint groups rows by day and lets adaptive execution split a heavy day
    into several tasks and merge light ones, so no task holds a whole hot day.
    """
    (
        df.hint("rebalance", by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .format(fmt)
        .save(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def contains_any(text: Column | str, tokens) -> Column:
    """True when the text holds at least one of the tokens (case-sensitive substring)."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.lit(False)
    for token in tokens:
        found = found | text.contains(token)
    return found


def ingest_filter(lines: DataFrame, tokens, field: int = 7, min_fields: int = 8) -> DataFrame:
    """Keep raw tab-separated lines whose field number ``field`` (from 0) holds a token.

    Lines with fewer than ``min_fields`` fields are dropped. ``lines`` has a ``value`` column,
    as ``spark.read.text`` gives; any other column (the partition day) is carried along.
    """
    parts = F.split("value", "\t", -1)
    return lines.filter(
        (F.size(parts) >= min_fields) & contains_any(F.get(parts, F.lit(field)), tokens)
    )


def unseen(candidates: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Candidates whose key is not among the existing rows."""
    return candidates.join(existing.select(key).distinct(), key, "left_anti")


def appended(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows followed by new ones, columns matched by name."""
    return existing.unionByName(new, allowMissingColumns=True)
