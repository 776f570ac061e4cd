"""Late casts: raw text rows to the narrow typed frames every roll-up reads.

Casting once at ingest replaces the casts each view would repeat, and lets a columnar copy
carry statistics, so day and code filters reach the scan. All casts are ``try`` casts: an
empty or broken value becomes NULL instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPED_EVENT_COLUMNS = (
    "event_id", "event_date", "country", "quad_class", "root_code", "geo_type", "place",
    "lat", "lon", "tone", "goldstein", "mentions", "source_url",
)
TYPED_ARTICLE_COLUMNS = ("article_id", "event_date", "themes", "locations", "tone", "scores")


def day_of(stamp: Column | str) -> Column:
    """First eight characters ``yyyyMMdd`` as a date; NULL when they are not a date."""
    stamp = F.col(stamp) if isinstance(stamp, str) else stamp
    return F.try_to_date(F.substring(stamp, 1, 8), "yyyyMMdd")


def whole_number(text: Column) -> Column:
    """Text to INT by way of DOUBLE, so ``'12.7'`` rounds instead of turning NULL."""
    return F.round(text.try_cast("double")).try_cast("int")


def typed_events(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` names further columns that stay as they are."""
    kept = [*(["date"] if "date" in raw.columns else []), *keep]
    return raw.select(
        F.col("globaleventid").alias("event_id"),
        day_of("day").alias("event_date"),
        F.col("actiongeo_countrycode").alias("country"),
        F.col("quadclass").alias("quad_class"),
        F.col("eventrootcode").alias("root_code"),
        F.col("actiongeo_type").alias("geo_type"),
        F.col("actiongeo_fullname").alias("place"),
        F.col("actiongeo_lat").try_cast("double").alias("lat"),
        F.col("actiongeo_long").try_cast("double").alias("lon"),
        F.col("avgtone").try_cast("double").alias("tone"),
        F.col("goldsteinscale").try_cast("double").alias("goldstein"),
        whole_number(F.col("nummentions")).alias("mentions"),
        F.col("sourceurl").alias("source_url"),
        *kept,
    )


def typed_articles(raw: DataFrame) -> DataFrame:
    kept = ["date"] if "date" in raw.columns else []
    return raw.select(
        F.col("gkgrecordid").alias("article_id"),
        day_of("gkg_datestamp").alias("event_date"),
        F.col("v1themes").alias("themes"),
        F.col("v2enhancedlocations").alias("locations"),
        F.col("v2tone").alias("tone"),
        F.col("v21gcam").alias("scores"),
        *kept,
    )


def cast_rejects(raw: DataFrame) -> DataFrame:
    """Per-field count of non-empty raw values a typed cast turns into NULL, in one pass."""
    checks = {
        "day": day_of("day"),
        "avgtone": F.col("avgtone").try_cast("double"),
        "goldsteinscale": F.col("goldsteinscale").try_cast("double"),
        "nummentions": whole_number(F.col("nummentions")),
        "actiongeo_lat": F.col("actiongeo_lat").try_cast("double"),
        "actiongeo_long": F.col("actiongeo_long").try_cast("double"),
    }
    counted = raw.agg(
        *[
            F.count_if((F.col(name) != "") & cast.isNull()).alias(name)
            for name, cast in checks.items()
        ]
    )
    return counted.unpivot([], list(checks), "field", "rejected_rows")
