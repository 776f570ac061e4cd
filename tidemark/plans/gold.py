"""Daily states kept on disk: sums and counts by landing day that views are merged from.

A state row holds mergeable sums of one (landing day, event day): a late row changes the state of
the day it lands on only. After new files land, the states of changed landing days are worked
out again and replaced; all other days are left as they are. Views add up a few thousand state
rows instead of scanning the raw table again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import StudyConfig
from tidemark.functions.columns import guarded_ratio, vector_part
from tidemark.functions.text import contains_flag
from tidemark.sources import sinks
from tidemark.sources.units import ensure_folder

PRINTS = "date date, n_files long, n_bytes long, newest timestamp, version long"


# -- states -----------------------------------------------------------------------------------


def _sum_if(cond: Column, value: Column | str) -> Column:
    return F.sum(F.when(cond, F.col(value) if isinstance(value, str) else value))


def event_states(rows: DataFrame, cfg: StudyConfig) -> DataFrame:
    """States of event rows (with ``date``): one scan for all roll-ups by day."""
    mine = (
        F.col("country").isin(*cfg.countries)
        & F.col("quad_class").isin(*cfg.conflict_classes)
        & F.col("event_date").between(F.lit(cfg.window_start), F.lit(cfg.window_end))
    )
    tone, weight = F.col("tone"), F.col("mentions")
    return rows.groupBy("date", "event_date").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(mine).alias("event_count"),
        _sum_if(mine, "tone").alias("tone"),
        F.count_if(mine & tone.isNotNull()).alias("toned"),
        _sum_if(mine, F.least(tone, F.lit(0.0))).alias("tone_below"),
        _sum_if(mine, F.greatest(tone, F.lit(0.0))).alias("tone_above"),
        _sum_if(mine, "goldstein").alias("goldstein"),
        F.count_if(mine & F.col("goldstein").isNotNull()).alias("goldsteined"),
        _sum_if(mine, "mentions").alias("mentions"),
        _sum_if(mine, tone * weight).alias("tone_mentions"),
        _sum_if(mine, F.col("goldstein") * weight).alias("goldstein_mentions"),
        *[F.count_if(mine & (F.col("quad_class") == v)).alias(k) for k, v in cfg.class_counts.items()],
        *[F.count_if(mine & (F.col("root_code") == v)).alias(k) for k, v in cfg.root_counts.items()],
    )


def event_views(states: DataFrame, cfg: StudyConfig) -> dict[str, DataFrame]:
    """The daily event views from their states."""
    keys = ("date", "event_date", "n_rows")
    days = states.groupBy("event_date").agg(*[F.sum(c).alias(c) for c in states.columns if c not in keys])
    days = days.filter("event_count > 0")
    mean = guarded_ratio
    count = F.col("event_count")
    return {
        "v_middle_east_events": days.select(
            "event_date",
            "event_count",
            mean(F.col("tone"), F.col("toned")).alias("avg_tone"),
            mean(F.col("goldstein"), F.col("goldsteined")).alias("avg_goldstein"),
            F.col("mentions").alias("total_mentions"),
        ),
        # a missing tone counts as 0 in the one-sided means
        "v_gdelt_tone_asymmetry_daily": days.select(
            "event_date",
            (F.coalesce("tone_below", F.lit(0.0)) / count).alias("negative_tone"),
            (F.coalesce("tone_above", F.lit(0.0)) / count).alias("positive_tone"),
            mean(F.col("tone"), F.col("toned")).alias("overall_tone"),
            "event_count",
        ),
        "v_gdelt_events_features_daily": days.select(
            "event_date",
            "event_count",
            F.col("mentions").alias("total_mentions"),
            mean(F.col("tone"), F.col("toned")).alias("mean_tone"),
            mean(F.col("tone_mentions"), F.col("mentions")).alias("mentions_weighted_tone"),
            mean(F.col("goldstein"), F.col("goldsteined")).alias("mean_goldstein"),
            mean(F.col("goldstein_mentions"), F.col("mentions")).alias("mentions_weighted_goldstein"),
            F.col("goldstein_mentions").alias("total_weighted_goldstein"),
            *cfg.class_counts,
            *cfg.root_counts,
        ),
    }


def article_states(rows: DataFrame, cfg: StudyConfig, parts: Mapping[str, int]) -> DataFrame:
    """States of article rows (with ``date``): token counts, and moments of the tone vector.

    Moments are count, mean and squared distance from the mean, which merge without loss.
    """
    tokens = {**cfg.theme_tokens, **cfg.place_tokens}
    flagged = rows.filter(
        F.col("event_date").between(F.lit(cfg.window_start), F.lit(cfg.window_end))
    ).select(
        "date",
        "event_date",
        F.col("themes").isNotNull().alias("_t"),
        F.col("locations").isNotNull().alias("_p"),
        *[contains_flag("themes", v).alias(k) for k, v in cfg.theme_tokens.items()],
        *[contains_flag("locations", v).alias(k) for k, v in cfg.place_tokens.items()],
        *[vector_part("tone", at).alias(f"_{name}") for name, at in parts.items()],
    )

    def any_of(members: Sequence[str]) -> Column:
        return F.count_if(reduce(lambda a, b: a | b, [F.col(m) == 1 for m in members]))

    composites = {**cfg.theme_composites, **cfg.place_composites}
    moments = []
    for name in parts:
        x = F.col(f"_{name}")
        moments += [
            F.count(x).alias(f"n_{name}_"),
            F.avg(x).alias(f"mean_{name}_"),
            (F.var_pop(x) * F.count(x)).alias(f"dist_{name}_"),
        ]
    return flagged.groupBy("date", "event_date").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("_t").alias("n_themed"),
        F.count_if("_p").alias("n_placed"),
        *[F.sum(name).alias(name) for name in tokens],
        *[any_of(m).alias(n) for n, m in composites.items()],
        *moments,
    )


def article_views(
    states: DataFrame, cfg: StudyConfig, parts: Mapping[str, int], spread: Sequence[str]
) -> dict[str, DataFrame]:
    """Theme, place and tone-vector views from their states."""
    counts = [
        "n_rows", "n_themed", "n_placed", *cfg.theme_tokens, *cfg.place_tokens,
        *cfg.theme_composites, *cfg.place_composites,
    ]
    sums = [F.sum(c).alias(c) for c in counts]
    for name in parts:
        n, mean, dist = (F.col(f"{k}_{name}_") for k in ("n", "mean", "dist"))
        sums += [
            F.sum(n).alias(f"n_{name}_"),
            F.sum(n * mean).alias(f"sum_{name}_"),
            F.sum(dist + n * mean * mean).alias(f"square_{name}_"),
        ]
    days = states.groupBy("event_date").agg(*sums)

    def mean_of(name: str) -> Column:
        return guarded_ratio(F.col(f"sum_{name}_"), F.col(f"n_{name}_"))

    def deviation(name: str) -> Column:
        n = F.col(f"n_{name}_")
        rest = F.col(f"square_{name}_") - F.col(f"sum_{name}_") * mean_of(name)
        return F.when(n > 1, F.sqrt(F.greatest(rest, F.lit(0.0)) / (n - 1)))

    return {
        "v_gkg_tone_daily": days.select(
            "event_date",
            F.col("n_rows").alias("n_articles"),
            *[mean_of(name).alias(f"mean_{name}") for name in parts],
            *[deviation(name).alias(f"{name}_dispersion") for name in spread],
        ),
        "v_gdelt_gkg_themes_daily": days.filter("n_themed > 0").select(
            "event_date", F.col("n_themed").alias("n_articles"), *cfg.theme_tokens, *cfg.theme_composites
        ),
        "v_gdelt_gkg_hormuz_daily": days.filter("n_placed > 0").select(
            "event_date", F.col("n_placed").alias("n_articles"), *cfg.place_tokens, *cfg.place_composites
        ),
    }


# -- refresh ----------------------------------------------------------------------------------


def landed_prints(spark: SparkSession, raw: str) -> DataFrame:
    """What the listing says of each landing day: files, bytes, newest file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(raw)
    day = F.try_to_date(F.regexp_extract("path", r"date=([0-9-]+)/", 1), "yyyy-MM-dd")
    return (
        files.where("length > 0")
        .groupBy(day.alias("date"))
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.sum("length").alias("n_bytes"),
            F.max("modificationTime").alias("newest"),
        )
    )


def known_prints(spark: SparkSession, path: str) -> DataFrame:
    ensure_folder(spark, f"{path}/prints")
    return spark.read.schema(PRINTS).parquet(f"{path}/prints")


def refresh(
    spark: SparkSession, raw: str, path: str, schema: str, states: Callable[[DataFrame], DataFrame]
) -> int:
    """Work out the states of the landing days of ``raw`` that are new or changed.

    ``raw`` is a folder of ``date=YYYY-MM-DD`` Parquet folders with the columns of ``schema``. Days
    are compared by their file listing; only changed ones are read. States are replaced before
    the listing is noted, so a run that dies in between is repeated. Gives the days refreshed.
    """
    known = known_prints(spark, path)
    last = known.groupBy("date").agg(F.max_by(F.struct("n_files", "n_bytes", "newest", "version"), "version").alias("k"))
    now = landed_prints(spark, raw).join(last, "date", "left")
    same = F.struct("n_files", "n_bytes", "newest").eqNullSafe(F.struct("k.n_files", "k.n_bytes", "k.newest"))
    changed = now.where(~same).select(
        "date", "n_files", "n_bytes", "newest", (F.coalesce("k.version", F.lit(0)) + 1).cast("long").alias("version")
    )
    days = spark.createDataFrame(changed.collect(), PRINTS)  # a row a day
    count = days.count()
    if count:
        rows = spark.read.schema(f"{schema}, date date").parquet(raw)
        sinks.write_partitioned(states(rows.join(F.broadcast(days.select("date")), "date", "left_semi")), f"{path}/states")
        days.write.mode("append").parquet(f"{path}/prints")
    return count


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/states")
