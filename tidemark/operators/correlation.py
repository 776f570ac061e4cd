"""Pearson, Spearman and leave-one-out correlation.

Pearson pieces are mergeable aggregates. All pairs of a matrix share one aggregation; pairs
are column pairs, so their number does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import guarded_corr, guarded_ratio
from tidemark.operators.ranking import cut_values, join_groups, ranked_values

Pair = tuple[str, str]


def long_pairs(df: DataFrame, pairs: Sequence[Pair], keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row and pair: (keep..., x, y, vx, vy), pairs with a NULL left out."""
    entries = F.array(
        *[
            F.struct(
                F.lit(x).alias("x"),
                F.lit(y).alias("y"),
                F.col(x).cast("double").alias("vx"),
                F.col(y).cast("double").alias("vy"),
            )
            for x, y in pairs
        ]
    )
    return (
        df.select(*keep, F.explode(entries).alias("_e"))
        .select(*keep, "_e.*")
        .filter(F.col("vx").isNotNull() & F.col("vy").isNotNull())
    )


def pearson_pairs(df: DataFrame, pairs: Sequence[Pair], by: Sequence[str] = ()) -> DataFrame:
    """(x, y, n, r) of each pair, NULL rows dropped pair by pair; a pair without rows is absent."""
    group = [*by, "x", "y"]
    return (
        long_pairs(df, pairs, by)
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("n"), guarded_corr("vx", "vy").alias("r"))
    )


def with_average_ranks(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Average ranks ``ax`` and ``ay`` of vx and vy in each group, one window per group."""

    def average_rank(value: str):
        ordered = Window.partitionBy(*group).orderBy(value)
        ties = Window.partitionBy(*group, value)
        return F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2

    return rows.select(
        *group, "vx", "vy", average_rank("vx").alias("ax"), average_rank("vy").alias("ay")
    )


def spearman_pairs(
    df: DataFrame, pairs: Sequence[Pair], by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """(x, y, n, r) on average ranks, ranked pair by pair after dropping NULL rows.

    Without ``buckets`` each (pair, group) is ranked in one window: for frames with one row
    per day or event. With ``buckets`` ranks come from value histograms split into ranges.
    """
    group = [*by, "x", "y"]
    rows = long_pairs(df, pairs, by)
    if buckets is None:
        ranked = with_average_ranks(rows, group)
        return ranked.groupBy(*group).agg(
            F.count(F.lit(1)).alias("n"), guarded_corr("ax", "ay").alias("r")
        )
    points = rows.groupBy(*group, "vx", "vy").agg(F.count(F.lit(1)).alias("_w"))
    for value, cuts in cut_values(rows, ["vx", "vy"], buckets).items():
        ranks = ranked_values(rows, value, group, cuts).select(
            *group, value, F.col("avg_rank").alias(f"_rank_{value}")
        )
        points = join_groups(points, ranks, [*group, value])
    # the mean rank is (n + 1) / 2 on both sides, so centred sums need no second pass
    w, a, b = F.col("_w"), F.col("_rank_vx"), F.col("_rank_vy")
    n = F.sum("_w")
    sums = points.groupBy(*group).agg(
        n.alias("n"),
        F.sum(w * a * b).alias("_ab"),
        F.sum(w * a * a).alias("_aa"),
        F.sum(w * b * b).alias("_bb"),
    )
    centre = F.col("n") * F.pow((F.col("n") + 1) / 2, F.lit(2))
    spread = F.sqrt((F.col("_aa") - centre) * (F.col("_bb") - centre))
    return sums.select(*group, "n", guarded_ratio(F.col("_ab") - centre, spread).alias("r"))


def correlation_matrix(
    df: DataFrame, cols: Sequence[str], method: str = "pearson", buckets: int | None = None
) -> DataFrame:
    """Full square matrix in long form (x, y, n, r), diagonal and both triangles.

    ``buckets`` splits the ranks of row-level frames (see ``spearman_pairs``).
    """
    pairs = [*combinations(cols, 2), *[(c, c) for c in cols]]
    if method == "spearman":
        half = spearman_pairs(df, pairs, buckets=buckets)
    else:
        half = pearson_pairs(df, pairs)
    flipped = F.array(
        F.struct(F.col("x"), F.col("y")), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))
    )
    once = F.array(F.struct(F.col("x"), F.col("y")))
    return half.select(
        F.explode(F.when(F.col("x") == F.col("y"), once).otherwise(flipped)).alias("_p"), "n", "r"
    ).select("_p.x", "_p.y", "n", "r")


def both_methods(
    df: DataFrame, pairs: Sequence[Pair], by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Pearson and Spearman: (by..., x, y, n, pearson, spearman, r_squared).

    Without ``buckets`` one pass ranks each (pair, group) in one window: for frames with one
    row per day. With ``buckets``, as event-level frames need, ranks come from split value
    histograms (see ``spearman_pairs``) and no task sorts all rows of a pair.
    """
    group = [*by, "x", "y"]
    if buckets is not None:
        straight = pearson_pairs(df, pairs, by).withColumnRenamed("r", "pearson")
        ranked = spearman_pairs(df, pairs, by, buckets).select(*group, F.col("r").alias("spearman"))
        both = join_groups(straight, ranked, group, "left")
        return both.withColumn("r_squared", F.col("pearson") * F.col("pearson"))
    measured = (
        with_average_ranks(long_pairs(df, pairs, by), group)
        .groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            guarded_corr("vx", "vy").alias("pearson"),
            guarded_corr("ax", "ay").alias("spearman"),
        )
    )
    return measured.withColumn("r_squared", F.col("pearson") * F.col("pearson"))


def leave_one_out(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """(x, y, n, full_r, min_loo, max_loo, sign_flip) of each pair.

    Removing a row changes the centred sums by a closed form, so one pass for the moments and
    one projection per row replace n recomputations. The moments are one row per pair.
    """
    rows = long_pairs(df, pairs)
    moments = rows.groupBy("x", "y").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("vx").alias("_mx"),
        F.avg("vy").alias("_my"),
        F.var_pop("vx").alias("_vx"),
        F.var_pop("vy").alias("_vy"),
        F.covar_pop("vx", "vy").alias("_vxy"),
        guarded_corr("vx", "vy").alias("full_r"),
    )
    # moments: len(pairs) rows, a number fixed by the call
    joined = rows.join(F.broadcast(moments), ["x", "y"])
    n = F.col("n")
    shrink = guarded_ratio(n, n - 1)
    dx, dy = F.col("vx") - F.col("_mx"), F.col("vy") - F.col("_my")
    sxx = F.col("_vx") * n - dx * dx * shrink
    syy = F.col("_vy") * n - dy * dy * shrink
    sxy = F.col("_vxy") * n - dx * dy * shrink
    # what is left of a spread after removing its only source is rounding noise
    spread = F.when(
        (sxx > F.col("_vx") * n * 1e-12) & (syy > F.col("_vy") * n * 1e-12), F.sqrt(sxx * syy)
    )
    each = joined.select("x", "y", "n", "full_r", guarded_ratio(sxy, spread).alias("_loo"))
    out = each.groupBy("x", "y").agg(
        F.max("n").alias("n"),
        F.max("full_r").alias("full_r"),
        F.min("_loo").alias("min_loo"),
        F.max("_loo").alias("max_loo"),
    )
    sign = F.signum
    return out.withColumn(
        "sign_flip",
        (sign("min_loo") != sign("full_r")) | (sign("max_loo") != sign("full_r")),
    )
