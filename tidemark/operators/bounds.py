"""Size-checked broadcasts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 << 20


def span_days(first: date, last: date) -> int:
    return (last - first).days + 1


def bounded_broadcast(
    df: DataFrame, max_rows: int, row_bytes: int = 512, limit: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """Broadcast hint when the proven row bound fits; otherwise leave the join to Spark.

    ``max_rows`` must follow from the plan, e.g. one row per day of a closed window, never
    from a guess about the data.
    """
    return F.broadcast(df) if max_rows * row_bytes <= limit else df
