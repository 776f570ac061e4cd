"""Arithmetic and aggregate expressions shared by the roll-ups and studies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(38,10)"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(value: Column | str, digits: int) -> Column:
    """Round by way of a 10-place decimal, so binary noise cannot move a decimal tie.

    A finite value too large for the decimal has no digits after the point and stays.
    """
    value = as_column(value).cast("double")
    large = (F.abs(value) >= 1e27) & (F.abs(value) < float("inf"))
    return F.coalesce(
        F.round(value.try_cast(DECIMAL), digits).cast("double"), F.when(large, value)
    )


def round_half_even(value: Column | str, digits: int) -> Column:
    """Banker's rounding of a double, as the resampled source tables use."""
    return F.bround(as_column(value).cast("double"), digits)


def guarded_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, NULL when den is 0 or NULL."""
    return F.try_divide(as_column(num).cast("double"), as_column(den).cast("double"))


def pct_move(start: Column | str, end: Column | str) -> Column:
    """100 * (end - start) / start, NULL for a zero or missing start."""
    start, end = as_column(start), as_column(end)
    return F.try_divide(F.lit(100.0) * (end - start), start)


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """sum(value * weight) / sum(weight); NULL when the weights sum to 0.

    A NULL value leaves the numerator while its weight stays in the denominator.
    """
    value, weight = as_column(value), as_column(weight)
    return guarded_ratio(F.sum(value * weight), F.sum(weight))


def one_sided(value: Column | str, side: str) -> Column:
    """Mean of the values clipped to one side of 0. A NULL value counts as 0."""
    clip = {"negative": F.least, "positive": F.greatest}[side]
    return F.avg(clip(as_column(value), F.lit(0.0)))


def vector_part(vector: Column | str, position: int, cast: str = "double") -> Column:
    """Part ``position`` (from 1) of a comma-separated vector, NULL if absent or no number."""
    return F.split_part(as_column(vector), F.lit(","), F.lit(position)).try_cast(cast)


def gas_regime(share: Column | str, threshold: float) -> Column:
    share = as_column(share)
    return (
        F.when(share.isNull(), "unknown").when(share >= threshold, "high_gas").otherwise("low_gas")
    )


def period_of(day: Column | str, first, last) -> Column:
    """pre / during / post, with ``first`` and ``last`` both inside the middle period."""
    day = as_column(day)
    return F.when(day < F.lit(first), "pre").when(day <= F.lit(last), "during").otherwise("post")


def guarded_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson r over rows where both are present; NULL when either has no spread.

    Built from mergeable central moments, so it combines map-side like any other aggregate
    and does not fail on a constant series.
    """
    x, y = as_column(x).cast("double"), as_column(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(
        F.covar_pop(x, y),
        F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)),
    )


def dominance(
    first: Column | str,
    second: Column | str,
    labels: tuple[str, str, str] = ("LNG-dominant", "Oil-dominant", "mixed/low"),
) -> Column:
    """Which of two article counts dominates a day.

    ``first`` wins above 5 % of ``second`` and at least 5 rows; else ``second`` wins above
    five times ``first`` and at least 50 rows.
    """
    first, second = as_column(first), as_column(second)
    return (
        F.when((first > second * 0.05) & (first >= 5), labels[0])
        .when((second > first * 5) & (second >= 50), labels[1])
        .otherwise(labels[2])
    )
