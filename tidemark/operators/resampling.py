"""Bootstrap and placebo resampling as joins, with reproducible draws.

Iterations are rows, so they spread over the cluster. A draw is a hash of (seed, iteration,
position), not a generator state: any task, retry or engine gets the same draw.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import guarded_corr
from tidemark.operators.numbering import numbered


def draw(seed: int, *parts: Column) -> Column:
    """A 32-bit number from the md5 of ``seed-part-part``."""
    text = F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def indexed(df: DataFrame, order: str, name: str = "_i") -> DataFrame:
    """Rows numbered from 0 in ``order``, in one task; for frames with one row per day."""
    return df.withColumn(name, (F.row_number().over(Window.orderBy(order)) - 1).cast("bigint"))


def bootstrap_corr(
    df: DataFrame, order: Sequence[str], x: str, y: str, n_iter: int = 5000, seed: int = 42
) -> DataFrame:
    """Pearson r of ``n_iter`` resamples with replacement: (iter, r). Draws without spread in
    either column have no r and are left out. ``order`` tells all rows apart."""
    spark = df.sparkSession
    clean = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*order, x, y)
    rows = numbered(clean, list(order), "_i", start=0)
    size = rows.count()  # each slot of each iteration is a row: no array grows with the events
    slots = spark.range(n_iter * size).select(
        F.floor(F.col("id") / max(1, size)).cast("bigint").alias("iter"),
        (F.col("id") % max(1, size)).alias("_slot"),
    )
    picks = slots.select(
        "iter", (draw(seed, F.col("iter"), F.col("_slot")) % max(1, size)).alias("_i")
    )
    return (
        picks.join(rows, "_i")
        .groupBy("iter")
        .agg(guarded_corr(x, y).alias("r"))
        .filter(F.col("r").isNotNull())
    )


def bootstrap_summary(draws: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed r, 95 % interval and shares above 0 and 0.5. ``observed`` is one row (r).

    One aggregation over the draws; their number is the call's ``n_iter``, so the exact
    percentile has a known size.
    """
    shares = draws.agg(
        F.percentile("r", [0.025, 0.975]).alias("_interval"),
        F.count(F.lit(1)).alias("n_draws"),
        F.avg((F.col("r") > 0).cast("double")).alias("p_gt_0"),
        F.avg((F.col("r") > 0.5).cast("double")).alias("p_gt_half"),
    )
    return shares.select(
        observed.scalar().alias("r_observed"),
        "n_draws",
        F.col("_interval")[0].alias("ci_low"),
        F.col("_interval")[1].alias("ci_high"),
        "p_gt_0",
        "p_gt_half",
    )


def sample_positions(size: Column, k: int, seed: int, iteration: Column) -> Column:
    """k distinct positions out of 0..size-1, every subset equally likely.

    Step j draws from 0..j; a position already taken is replaced by j itself. It takes k
    steps whatever the size, where ordering the whole pool per iteration would take size.
    """
    steps = F.sequence(size - k, size - 1)

    def step(taken: Column, j: Column) -> Column:
        pick = draw(seed, iteration, j) % (j + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, pick), j).otherwise(pick)))

    return F.aggregate(steps, F.array().cast("array<bigint>"), step)


def placebo(
    pool: DataFrame, order: str, cols: Sequence[str], k: int, n_iter: int = 1000, seed: int = 42
) -> DataFrame:
    """Means of ``cols`` over ``k`` pool rows drawn without replacement, per iteration.

    Fails when the pool is smaller than the sample.
    """
    spark = pool.sparkSession
    too_small = F.raise_error(F.lit(f"need at least {k} eligible rows")).cast("bigint")
    size = pool.agg(
        F.when(F.count(F.lit(1)) >= k, F.count(F.lit(1))).otherwise(too_small).alias("_n")
    ).scalar()
    picks = (
        spark.range(n_iter)
        .select(F.col("id").alias("iter"), size.alias("_size"))
        .select("iter", F.explode(sample_positions(F.col("_size"), k, seed, F.col("iter"))).alias("_i"))
    )
    return (
        picks.join(indexed(pool.select(order, *cols), order), "_i")
        .groupBy("iter")
        .agg(*[F.avg(c).alias(f"{c}_mean") for c in cols])
    )


def empirical_rank(real: DataFrame, draws: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of draws strictly below the real mean: (series, real_mean, n_draws, rank).

    ``real`` holds the per-event rows; ``draws`` has a ``<col>_mean`` column per series.
    """
    means = real.agg(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("_m")).scalar()
    long = draws.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("series"),
                        means.getField(c).alias("real_mean"),
                        F.col(f"{c}_mean").alias("_p"),
                    )
                    for c in cols
                ]
            )
        ).alias("_e")
    ).select("_e.*")
    return (
        long.filter(F.col("_p").isNotNull())
        .groupBy("series", "real_mean")
        .agg(
            F.count(F.lit(1)).alias("n_draws"),
            F.avg((F.col("_p") < F.col("real_mean")).cast("double")).alias("rank"),
        )
    )
