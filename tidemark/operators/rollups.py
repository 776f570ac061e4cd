"""Row-level news and event frames to daily (or place) roll-ups.

Each roll-up is filter, project, one hash aggregation with map-side combine: a day holding a
third of all rows costs its map tasks, never one reducer. Flags are projected before the
aggregation, so every token is searched once per row even when composites use it again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import guarded_ratio, one_sided, vector_part, weighted_mean
from tidemark.functions.text import contains_flag, exact_token_flag, first_value, keyed_values


def in_window(df: DataFrame, first: date, last: date, day: str = "event_date") -> DataFrame:
    """Closed day window. With a ``date`` partition column, older partitions are pruned.

    A late row's day is before its partition day, so only the lower bound may prune.
    """
    kept = df.filter(F.col(day).between(F.lit(first), F.lit(last)))
    return kept.filter(F.col("date") >= F.lit(first)) if "date" in df.columns else kept


def conflict_rows(df: DataFrame, countries: Sequence[str], classes: Sequence[str]) -> DataFrame:
    return df.filter(F.col("country").isin(*countries) & F.col("quad_class").isin(*classes))


def event_rollup(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.avg("tone").alias("avg_tone"),
        F.avg("goldstein").alias("avg_goldstein"),
        F.sum("mentions").alias("total_mentions"),
    )


def place_grid(rows: DataFrame, place_types: Sequence[str], digits: int = 1) -> DataFrame:
    """Roll-up by place, country and rounded coordinates; rows without coordinates drop out."""
    located = rows.filter(
        F.col("geo_type").isin(*place_types) & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    )
    return located.groupBy(
        "place",
        F.col("country").alias("fips_country"),
        F.round("lat", digits).alias("lat"),
        F.round("lon", digits).alias("lon"),
    ).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.avg("tone").alias("avg_tone"),
        F.sum("mentions").alias("total_mentions"),
    )


def tone_asymmetry(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_date").agg(
        one_sided("tone", "negative").alias("negative_tone"),
        one_sided("tone", "positive").alias("positive_tone"),
        F.avg("tone").alias("overall_tone"),
        F.count(F.lit(1)).alias("event_count"),
    )


def event_features(
    rows: DataFrame, class_counts: Mapping[str, str], root_counts: Mapping[str, str]
) -> DataFrame:
    return rows.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum("mentions").alias("total_mentions"),
        F.avg("tone").alias("mean_tone"),
        weighted_mean("tone", "mentions").alias("mentions_weighted_tone"),
        F.avg("goldstein").alias("mean_goldstein"),
        weighted_mean("goldstein", "mentions").alias("mentions_weighted_goldstein"),
        F.sum(F.col("goldstein") * F.col("mentions")).alias("total_weighted_goldstein"),
        *[F.count_if(F.col("quad_class") == v).alias(k) for k, v in class_counts.items()],
        *[F.count_if(F.col("root_code") == v).alias(k) for k, v in root_counts.items()],
    )


def vector_rollup(rows: DataFrame, parts: Mapping[str, int], spread: Sequence[str]) -> DataFrame:
    """Means of the parts of a comma-separated vector, sample deviation of some of them."""
    parsed = rows.select(
        "event_date", *[vector_part("tone", at).alias(f"_{name}") for name, at in parts.items()]
    )
    return parsed.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("n_articles"),
        *[F.avg(f"_{name}").alias(f"mean_{name}") for name in parts],
        *[F.stddev_samp(f"_{name}").alias(f"{name}_dispersion") for name in spread],
    )


def token_rollup(
    rows: DataFrame,
    text: str,
    tokens: Mapping[str, str],
    composites: Mapping[str, Sequence[str]],
    exact: bool = False,
) -> DataFrame:
    """Rows per day holding each token, and rows holding any token of a composite.

    The default is a substring search, so a token also counts where it starts a longer one;
    ``exact`` compares whole list elements instead.
    """
    flag = exact_token_flag if exact else contains_flag
    flagged = rows.filter(F.col(text).isNotNull()).select(
        "event_date", *[flag(text, token).alias(name) for name, token in tokens.items()]
    )
    return flagged.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("n_articles"),
        *[F.sum(name).alias(name) for name in tokens],
        *[
            F.count_if(reduce(lambda a, b: a | b, [F.col(m) == 1 for m in members])).alias(name)
            for name, members in composites.items()
        ],
    )


def keyed_score_rollup(
    rows: DataFrame, text: str, keys: Mapping[str, str], spread: Sequence[str]
) -> DataFrame:
    """Means of scores picked out of a sparse ``key:score`` list; the first hit of a key counts."""
    found, numbers = keyed_values(text, keys.values())
    hits = rows.filter(F.col(text) != "").select(
        "event_date", found.alias("_keys"), numbers.alias("_numbers")
    )
    parsed = hits.select(
        "event_date",
        *[first_value("_keys", "_numbers", key).alias(f"_{name}") for name, key in keys.items()],
    )
    return parsed.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("n_articles"),
        *[F.avg(f"_{name}").alias(f"mean_{name}") for name in keys],
        *[F.stddev_samp(f"_{name}").alias(f"dispersion_{name}") for name in spread],
    )


def themes_and_places(
    rows: DataFrame,
    themes: Mapping[str, str],
    theme_composites: Mapping[str, Sequence[str]],
    places: Mapping[str, str],
    place_composites: Mapping[str, Sequence[str]],
) -> DataFrame:
    """Both token roll-ups of the article rows in one scan and one aggregation.

    Equal to the theme roll-up LEFT JOINed to the place roll-up on the day: days without any
    theme list are left out, and a day without any place list has NULL place counts.
    """
    flagged = rows.select(
        "event_date",
        F.col("themes").isNotNull().alias("_t"),
        F.col("locations").isNotNull().alias("_p"),
        *[contains_flag("themes", token).alias(name) for name, token in themes.items()],
        *[contains_flag("locations", token).alias(name) for name, token in places.items()],
    )

    def any_of(members) -> Column:
        return F.count_if(reduce(lambda a, b: a | b, [F.col(m) == 1 for m in members]))

    counts = [F.sum(name).alias(name) for name in (*themes, *places)]
    counts += [any_of(m).alias(n) for n, m in {**theme_composites, **place_composites}.items()]
    daily = flagged.groupBy("event_date").agg(
        F.count_if("_t").alias("n_articles"), F.count_if("_p").alias("_n_places"), *counts
    )
    place_columns = (*places, *place_composites)
    return daily.filter("n_articles > 0").select(
        "event_date",
        "n_articles",
        *themes,
        *theme_composites,
        *[F.when(F.col("_n_places") > 0, F.col(c)).alias(c) for c in place_columns],
    )


def dual_signal(joined: DataFrame) -> DataFrame:
    """Two composite signals from daily theme and place counts; missing counts are 0."""
    zero = F.lit(0)
    return joined.select(
        "event_date",
        (F.coalesce("n_econ_oil", zero) + F.coalesce("n_kharg", zero)).alias("oil_signal"),
        F.coalesce("n_ras_laffan", zero).alias("lng_signal"),
        F.coalesce("n_maritime_total", zero).alias("maritime_signal"),
        "n_econ_oil",
        "n_econ_oilexport",
        "n_kharg",
        "n_ras_laffan",
        "n_persian_gulf",
        "n_chokepoint_total",
        "n_maritime_total",
        "n_armedconflict",
    )


def score_rollup(scores: DataFrame) -> DataFrame:
    """Daily means of text scores, their mentions-weighted mean and dispersion."""
    weight = F.col("nummentions").cast("double")
    signed = F.col("finbert_signed").cast("double")
    return (
        scores.filter(F.col("day").isNotNull())
        .groupBy(F.col("day").cast("date").alias("event_date"))
        .agg(
            F.count(F.lit(1)).alias("n_articles"),
            F.avg(signed).alias("mean_finbert_signed"),
            F.avg("finbert_positive").alias("mean_finbert_positive"),
            F.avg("finbert_negative").alias("mean_finbert_negative"),
            F.avg("finbert_neutral").alias("mean_finbert_neutral"),
            guarded_ratio(F.sum(signed * weight), F.sum(weight)).alias(
                "mentions_weighted_finbert_signed"
            ),
            F.stddev_samp(signed).alias("finbert_dispersion"),
        )
    )


def value_counts(rows: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """Rows per value, most frequent first; ``k`` gives the top-k report."""
    counted = (
        rows.filter(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy(F.col("n_rows").desc(), F.col(col))
    )
    return counted if k is None else counted.limit(k)
