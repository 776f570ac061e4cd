"""Row numbers over a whole table without one task that holds it.

A window without partitions sorts every row in one task. Here rows are dealt by ranges of the
order, sorted within their range and written once; a row's number is its place in its range
plus the sizes of the ranges before it. What the driver reads is one count a range.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import run_dir

#: A row's place: the range in the upper bits, the position within it in the lower 33.
POSITION_BITS = 33


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``frame`` has such a column."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(
    frame: DataFrame, order: list[Column | str], name: str = "number", start: int = 1
) -> DataFrame:
    """``frame`` with ``name``: 1, 2, 3... in ``order``, as a long.

    Rows that are equal in ``order`` lie in one range and get their numbers in any order; give a
    last key that tells them apart where reruns must agree or where many rows may be equal. The
    numbered table lies in the session's shared folder, so a lost executor cannot change it.
    """
    spark = frame.sparkSession
    at = free_name(frame, "_place")
    placed = (
        frame.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(at, F.monotonically_increasing_id())
    )
    path = run_dir(spark, "numbered")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    part = F.shiftright(at, POSITION_BITS)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())  # one row a range
    before = accumulate((n for _, n in sizes), initial=start)
    part_name, first = free_name(placed, "_range"), free_name(placed, "_first")
    offsets = spark.createDataFrame(
        [(p, f) for (p, _), f in zip(sizes, before)], f"{part_name} long, {first} long"
    )
    number = F.col(first) + F.col(at).bitwiseAND((1 << POSITION_BITS) - 1)
    return (
        placed.withColumn(part_name, part)
        .join(F.broadcast(offsets), part_name)
        .withColumn(name, number)
        .drop(part_name, first, at)
    )
