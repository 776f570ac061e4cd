"""Top-N per group, average ranks and exact quantiles.

Ranks and quantiles come in two forms. Without ``splits`` one window per group is used: right
for frames whose size is bounded by the calendar (one row per day or per event). With
``splits`` (a sorted list of cut values) the work is done on the histogram of distinct values
in ranges between the cuts, so neither a heavy value nor a heavy group lands in one task.
Any cuts give the exact result; they only steer how evenly the work is spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """First n rows of each group. ``order`` must be total, or ties are cut at random.

    Spark prunes each map task to n rows per group before the shuffle.
    """
    name = rank or "_rank"
    w = Window.partitionBy(*by).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def top_k(df: DataFrame, order: Sequence[Column], k: int, key: str) -> DataFrame:
    """The first k rows of a whole table in ``order``, ties by ``key``.

    Each task keeps a heap of k rows and the heaps are merged: no table is sorted.
    """
    return df.orderBy(*order, F.col(key)).limit(k)


def cut_values(
    df: DataFrame, cols: Sequence[str], buckets: int, error: float = 0.001
) -> dict[str, list[float]]:
    """``buckets`` - 1 cut values of about equal weight per column, found in one job; only they
    reach the driver."""
    probs = [i / buckets for i in range(1, buckets)]
    found = df.approxQuantile(list(cols), probs, error)
    return {col: sorted(set(cuts)) for col, cuts in zip(cols, found)}


def bucket_of(col: Column | str, splits: Sequence[float]) -> Column:
    """Number of cuts at or below the value: a monotone bucket number."""
    col = F.col(col) if isinstance(col, str) else col
    cuts = F.array(*[F.lit(float(s)) for s in splits])
    return F.size(F.filter(cuts, lambda cut: cut <= col))


def join_groups(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of which a NULL equals a NULL: a group may have no label."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(renamed, same, how).drop(*[f"_r_{c}" for c in on])


def ranked_values(
    df: DataFrame, value: str, by: Sequence[str] = (), splits: Sequence[float] = ()
) -> DataFrame:
    """Distinct non-NULL values per group with ``n`` (ties), ``before`` (rows below) and
    ``avg_rank`` (mean rank of the ties)."""
    hist = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if not splits:
        w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        ranked = hist.withColumn("before", F.sum("n").over(w) - F.col("n"))
    else:
        hist = hist.withColumn("_bucket", bucket_of(value, splits))
        w = (
            Window.partitionBy(*by, "_bucket")
            .orderBy(value)
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        inside = hist.withColumn("_inside", F.sum("n").over(w) - F.col("n"))
        over_buckets = (
            Window.partitionBy(*by)
            .orderBy("_bucket")
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        totals = hist.groupBy(*by, "_bucket").agg(F.sum("n").alias("_total"))
        offsets = totals.withColumn(
            "_offset", F.sum("_total").over(over_buckets) - F.col("_total")
        ).drop("_total")
        ranked = join_groups(inside, offsets, [*by, "_bucket"]).withColumn(
            "before", F.col("_inside") + F.col("_offset")
        )
    return ranked.select(
        *by, value, "n", "before", (F.col("before") + (F.col("n") + 1) / 2).alias("avg_rank")
    )


def quantile_name(p: float) -> str:
    return f"q{p * 100:g}".replace(".", "_")


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    splits: Sequence[float] = (),
    totals: DataFrame | None = None,
) -> DataFrame:
    """Quantiles with linear interpolation between the two neighbouring ranks.

    Positions are looked up in the running counts of the value histogram, so the final
    aggregation combines map-side whatever the group sizes. ``totals`` (by..., _total) saves
    counting the values again.
    """
    ranked = ranked_values(df, value, by, splits)
    if totals is None:
        totals = df.groupBy(*by).agg(F.count(value).alias("_total"))
    if by:
        placed = ranked.join(totals, list(by))
        total = F.col("_total")
    else:
        placed, total = ranked, totals.scalar()
    columns = []
    for p in probs:
        at = (total - 1) * F.lit(float(p))
        pick = {}
        for side, position in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            held = (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
            pick[side] = F.max(F.when(held, F.col(value)))
        # the fraction is the same on every row of a group
        part = F.max(at - F.floor(at))
        columns.append((pick["lo"] + (pick["hi"] - pick["lo"]) * part).alias(quantile_name(p)))
    return placed.groupBy(*by).agg(*columns)


def describe(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    buckets: int | None = None,
) -> DataFrame:
    """count, mean, std, min, quantiles and max of each column, one row per column.

    Columns are unpivoted so all of them share one job. Give ``buckets`` for row-level input:
    cut values are then read first and the quantiles use the spread form.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), "column", "value"
    )
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    splits = cut_values(long, ["value"], buckets)["value"] if buckets else ()
    totals = moments.select("column", F.col("count").alias("_total"))
    cuts = exact_quantiles(long, "value", probs, ["column"], splits, totals)
    # one row per described column on both sides
    return moments.join(cuts, "column", "left").select(
        "column", "count", "mean", "std", "min", *[quantile_name(p) for p in probs], "max"
    )
