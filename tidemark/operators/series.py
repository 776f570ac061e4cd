"""Daily series: alignment, shares, rebasing, spreads and their inverse."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import (
    as_column,
    gas_regime,
    guarded_ratio,
    round_half_even,
    round_half_up,
)


def align(frames: Mapping[str, DataFrame], day: str) -> DataFrame:
    """Outer-align daily frames on ``day``: one union and one aggregation for any number.

    ``has_<name>`` tells whether that frame has a row for the day, so inner- and left-join
    semantics are both a filter away. Each frame must hold one row per day; reading a day of a
    frame with more rows fails the query.
    """
    parts, out = [], []
    for name, frame in frames.items():
        parts.append(frame.withColumn(f"has_{name}", F.lit(True)))
        rows = F.count_if(f"has_{name}")
        twice = F.raise_error(
            F.concat(F.lit(f"series {name} has more than one row on "), F.first(day).cast("string"))
        )
        out += [
            F.when(rows > 1, twice).otherwise(F.max(c)).alias(c) for c in frame.columns if c != day
        ]
        out.append(F.when(rows > 1, twice).otherwise(rows == 1).alias(f"has_{name}"))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy(day).agg(*out)


def daily_mean(rows: DataFrame, day: Column, value: Column | str, out: str, positive=True):
    """Intraday rows to a daily mean; empty (zero or negative) periods are left out."""
    value = as_column(value)
    kept = rows.filter(value > 0) if positive else rows
    return kept.groupBy(day.alias("price_date")).agg(F.avg(value).alias(out))


def half_hour_mean(rows: DataFrame, out: str) -> DataFrame:
    """Half-hour prices (price_date, price) to a daily mean over the periods above zero."""
    dated = rows.filter(F.col("price_date").isNotNull())
    return daily_mean(dated, F.col("price_date"), "price", out)


def half_hour_shares(
    rows: DataFrame, categories: Mapping[str, str], names: Sequence[str]
) -> DataFrame:
    """Half-hour generation (price_date, fuel, amount as text) to daily totals and shares."""
    dated = rows.filter(F.col("price_date").isNotNull())
    return mix_shares(dated, "price_date", category_of("fuel", categories), "amount", names)


def category_of(code: Column | str, categories: Mapping[str, str], other: str = "other") -> Column:
    """Code to category; an unlisted code falls into ``other``."""
    code = as_column(code)
    by_category: dict[str, list[str]] = {}
    for key, category in categories.items():
        by_category.setdefault(category, []).append(key)
    branches = None
    for category, keys in by_category.items():
        cond = code.isin(keys)
        branches = F.when(cond, category) if branches is None else branches.when(cond, category)
    return branches.otherwise(other)


def mix_shares(
    rows: DataFrame, day: Column | str, category: Column, amount: Column | str, names: Sequence[str]
) -> DataFrame:
    """Category amounts per day, their total (whole number) and shares of it in %.

    Only the named categories enter the total. The pivot is a set of conditional sums, so it
    combines map-side and needs no second pass to find the category values. Text that is no
    number counts as 0. The shares use the rounded total.
    """
    tagged = rows.select(
        as_column(day).alias("price_date"),
        category.alias("_category"),
        F.coalesce(as_column(amount).try_cast("double"), F.lit(0.0)).alias("_amount"),
    )
    sums = tagged.groupBy("price_date").agg(
        *[
            F.sum(F.when(F.col("_category") == name, F.col("_amount")).otherwise(0.0)).alias(name)
            for name in names
        ]
    )
    total = round_half_even(reduce(lambda a, b: a + b, [F.col(n) for n in names]), 0)
    totalled = sums.withColumn("total_mwh", total)
    return totalled.select(
        "price_date",
        "total_mwh",
        *[
            round_half_even(guarded_ratio(F.col(n), F.col("total_mwh")) * 100, 1).alias(
                f"{n}_share_pct"
            )
            for n in names
        ],
    )


def rebase(
    series: DataFrame,
    day: str,
    value: str,
    base_value: float,
    base_date: date,
    out: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Scale a series so that its first value on or after ``base_date`` equals ``base_value``.

    For frames with one row per day (and per ``by``): the anchor is read in a window over the
    days, so the rows behind the series are scanned once. A series without a day on or after
    the base date has no anchor and fails the query.
    """
    whole = Window.partitionBy(*by).orderBy(day).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    found = F.first(F.when(F.col(day) >= F.lit(base_date), F.col(value)), ignorenulls=True)
    missing = F.raise_error(F.lit(f"no value on or after {base_date}")).cast("double")
    anchored = series.withColumn("_anchor", F.coalesce(found.over(whole), missing))
    scaled = F.lit(base_value) * guarded_ratio(F.col(value), F.col("_anchor"))
    return anchored.withColumn(out, round_half_even(scaled, 3)).drop("_anchor")


def index_to_first(
    df: DataFrame, order: str, cols: Sequence[str], suffix: str = "_pct", by: Sequence[str] = ()
) -> DataFrame:
    """% change of each column from its first non-NULL value in ``order``, one row per day."""
    whole = Window.partitionBy(*by).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    firsts = df.select(
        "*", *[F.first(c, ignorenulls=True).over(whole).alias(f"_first_{c}") for c in cols]
    )
    return firsts.select(
        *df.columns,
        *[
            ((guarded_ratio(F.col(c), F.col(f"_first_{c}")) - 1) * 100).alias(f"{c}{suffix}")
            for c in cols
        ],
    )


def theoretical_spread(panel: DataFrame, heat: float, fx: float, emissions: float, threshold: float):
    """Fuel plus carbon cost, theoretical margin, residual of the observed price, and regime.

    ``panel`` has one row per trading day with the observed series.
    """
    fuel = F.col("ttf_close") * heat * fx
    carbon = F.col("uka_close_gbp_per_tco2") * emissions
    return panel.select(
        "price_date",
        "brent_close",
        "ttf_close",
        F.col("gb_power_avg").alias("power_observed_gbp_mwh"),
        F.col("uka_close_gbp_per_tco2").alias("uka_proxy_gbp_per_tco2"),
        "gas_share_pct",
        round_half_up(fuel, 2).alias("fuel_cost_gbp_mwh"),
        round_half_up(carbon, 2).alias("carbon_cost_gbp_mwh"),
        round_half_up(fuel + carbon, 2).alias("theoretical_css_gbp_mwh"),
        round_half_up(F.col("gb_power_avg") - (fuel + carbon), 2).alias("residual_gbp_mwh"),
        gas_regime("gas_share_pct", threshold).alias("regime"),
    )


def implied_inverse(spread: DataFrame, heat: float, fx: float, emissions: float, limit: float):
    """The fuel price the observed power price implies, and its distance from the observed one."""
    implied = (
        F.col("power_observed_gbp_mwh") - F.col("uka_proxy_gbp_per_tco2") * emissions
    ) / F.lit(heat * fx)
    basis = F.col("ttf_close") - implied
    return spread.filter(
        F.col("ttf_close").isNotNull() & F.col("uka_proxy_gbp_per_tco2").isNotNull()
    ).select(
        "price_date",
        F.col("ttf_close").alias("observed_ttf_eur_mwh"),
        "power_observed_gbp_mwh",
        "uka_proxy_gbp_per_tco2",
        "gas_share_pct",
        "regime",
        round_half_up(implied, 2).alias("implied_ttf_eur_mwh"),
        round_half_up(basis, 2).alias("basis_eur_mwh"),
        F.when(F.abs(basis) > limit, "decoupled").otherwise("plausibly_marginal").alias(
            "basis_regime"
        ),
    )


def burst(df: DataFrame, order: str, value: str, rows: int, by: Sequence[str] = ()) -> DataFrame:
    """Value over the mean of its previous ``rows`` rows.

    Meant for frames with one row per day (and per ``by``): the window then sorts days, not
    raw rows.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-rows, -1)
    mean = f"rolling_{rows}d_mean"
    return df.withColumn(mean, F.avg(value).over(w)).withColumn(
        "burst_score", guarded_ratio(F.col(value), F.col(mean))
    )


def pct_change(
    df: DataFrame,
    order: str,
    cols: Mapping[str, str],
    k: int,
    by: Sequence[str] = (),
    scale: float = 100.0,
) -> DataFrame:
    """Trailing k-row change, times ``scale``: ``cols`` maps value column to output name.

    Rows are counted as they stand; NULLs are not filled.
    """
    w = Window.partitionBy(*by).orderBy(order)
    return df.select(
        "*",
        *[
            ((guarded_ratio(F.col(c), F.lag(c, k).over(w)) - 1) * scale).alias(out)
            for c, out in cols.items()
        ],
    )


def rolling_std(
    df: DataFrame, order: str, cols: Mapping[str, str], n: int, by: Sequence[str] = ()
) -> DataFrame:
    """Sample standard deviation of the last n rows; NULL unless all n values are present."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.select(
        "*",
        *[
            F.when(F.count(c).over(w) == n, F.stddev_samp(c).over(w)).alias(out)
            for c, out in cols.items()
        ],
    )
