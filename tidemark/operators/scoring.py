"""URL collection around events and batched text scoring."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import slug
from tidemark.operators.bounds import bounded_broadcast, span_days
from tidemark.operators.ranking import top_n
from tidemark.operators.windows import within_windows
from tidemark.sources.sinks import appended, unseen
from tidemark.sources.units import UnitTable

SCORE_FIELDS = ("finbert_positive", "finbert_neutral", "finbert_negative", "finbert_signed")

# a scorer takes texts and gives (positive, neutral, negative) probabilities per text
Scorer = Callable[[Sequence[str]], Sequence[tuple[float, float, float]]]


class LexiconScorer:
    """Counts words of two lists and turns the counts into three probabilities.

    A small stand-in for a transformer: same interface, deterministic, no weights.
    """

    def __init__(self, positive: Sequence[str], negative: Sequence[str]):
        self.positive = frozenset(positive)
        self.negative = frozenset(negative)

    def __call__(self, texts: Sequence[str]) -> list[tuple[float, float, float]]:
        # one row per word of the batch, then shares per text
        words = pd.Series(list(texts), dtype="object").str.lower().str.split(" ").explode()
        shares = [words.isin(known).groupby(level=0).mean() for known in (self.positive, self.negative)]
        weights = np.stack(
            [np.exp(8.0 * shares[0]), np.full(len(shares[0]), math.exp(0.5)), np.exp(8.0 * shares[1])],
            axis=1,
        )
        return [tuple(row) for row in (weights / weights.sum(axis=1, keepdims=True)).tolist()]


def score_batches(
    df: DataFrame, text: str, make_scorer: Callable[[], Scorer], batch_size: int = 32
) -> DataFrame:
    """Add the four score columns. ``make_scorer`` runs once per partition, so a model is
    loaded once and used for every batch; key and weight columns stay on their row."""
    schema = T.StructType(
        [*df.schema.fields, *[T.StructField(f, T.DoubleType()) for f in SCORE_FIELDS]]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in frames:
            texts = frame[text].tolist()
            scored: list[tuple[float, float, float]] = []
            for start in range(0, len(texts), batch_size):
                scored.extend(scorer(texts[start : start + batch_size]))
            positive, neutral, negative = (
                pd.Series([row[i] for row in scored], index=frame.index, dtype="float64")
                for i in range(3)
            )
            yield frame.assign(
                finbert_positive=positive,
                finbert_neutral=neutral,
                finbert_negative=negative,
                finbert_signed=positive - negative,
            )

    return df.mapInPandas(run, schema)


def top_urls(rows: DataFrame, n: int) -> DataFrame:
    """Most-mentioned URLs of each day: (source_url, day, nummentions).

    The maximum per (URL, day) combines map-side; ties are cut by URL.
    """
    per_url = (
        rows.filter(F.col("source_url") != "")
        .groupBy("source_url", F.col("event_date").alias("day"))
        .agg(F.max("mentions").alias("nummentions"))
    )
    order = [F.col("nummentions").desc_nulls_last(), F.col("source_url")]
    return top_n(per_url, ["day"], order, n)


def above_cut(rows: DataFrame, n: int, window: tuple[date, date]) -> DataFrame:
    """The rows that can be among the ``n`` most-mentioned URLs of their day.

    The cut is the n-th highest count of a day, found over hashes of the URLs: long URLs below
    it never move. Two URLs with one hash only lower the cut, so no row is lost. ``window`` is
    the closed range of the days.
    """
    per_url = (
        rows.filter(F.col("source_url") != "")
        .groupBy(F.xxhash64("source_url").alias("_url"), F.col("event_date").alias("_day"))
        .agg(F.max("mentions").alias("_cut"))
    )
    ranked = top_n(per_url, ["_day"], [F.col("_cut").desc_nulls_last()], n, "_rank")
    cuts = ranked.filter(F.col("_rank") == n).select("_day", "_cut")
    cuts = bounded_broadcast(cuts, span_days(*window), 16)
    near = rows.join(cuts, rows["event_date"] == cuts["_day"], "left")
    # a day with fewer URLs, or with a cut among the missing counts, keeps all its rows
    kept = F.col("_cut").isNull() | (F.col("mentions") >= F.col("_cut"))
    return near.filter(kept).drop("_day", "_cut")


def event_window_urls(
    rows: DataFrame,
    events: DataFrame,
    window: tuple[date, date],
    window_days: int = 1,
    per_day: int = 200,
    min_length: int = 6,
    long_urls: bool = False,
) -> DataFrame:
    """Top URLs of the days around events, with their slug: (source_url, day, nummentions, slug).

    Rows outside the event windows go before the aggregation, and slugs are cut only for the
    URLs that stay. With ``long_urls`` a second pass over the rows saves moving the other URLs.
    """
    near = within_windows(rows, events, "event_date", window_days, "event_date", window)
    if long_urls:
        near = above_cut(near, per_day, window)
    urls = top_urls(near, per_day).withColumn("slug", slug("source_url"))
    return urls.filter(F.length("slug") >= min_length)


def score_new(
    urls: DataFrame,
    existing: DataFrame,
    make_scorer: Callable[[], Scorer],
    partitions: int | None = None,
    digests: DataFrame | None = None,
) -> DataFrame:
    """Score URLs not scored before and append them to the existing scores.

    The new URLs are spread by key, so a busy day does not sit in one scoring task. With
    ``digests`` (url_digest of every existing URL) long existing URLs are not moved to be compared.
    """
    if digests is None:
        new = unseen(urls, existing, "source_url")
    else:
        keyed = urls.withColumn("url_digest", url_digest("source_url"))
        new = unseen(keyed, digests, "url_digest").drop("url_digest")
    return appended(existing, score_batches(spread(new, partitions), "slug", make_scorer))


def url_digest(url: str) -> Column:
    """SHA-256 of a URL: a short key that tells URLs apart."""
    return F.unhex(F.sha2(F.col(url), 256))


def spread(urls: DataFrame, partitions: int | None) -> DataFrame:
    return (
        urls.repartition(partitions, "source_url", "day")
        if partitions
        else urls.repartition("source_url", "day")
    )


def score_table(spark: SparkSession, path: str, schema: T.StructType) -> UnitTable:
    """A score table of which each run is a unit; ``schema`` is that of the unscored rows."""
    scores = [T.StructField(f, T.DoubleType()) for f in SCORE_FIELDS]
    return UnitTable(spark, path, T.StructType([*schema.fields, *scores]))


def append_scores(
    urls: DataFrame,
    table: UnitTable,
    run: str,
    make_scorer: Callable[[], Scorer],
    rows_per_task: int = 2_000,
) -> int:
    """Score the URLs that ``table`` lacks and append only those, as the unit ``run``.

    Old scores are read for their keys alone and never written again. The number of scoring
    tasks follows the number of new URLs, as scoring costs time per row, not per byte. A run
    that dies is repeated under its name and adds nothing twice; a finished run adds nothing.
    Gives the number of rows appended.
    """
    spark = urls.sparkSession
    unit = spark.createDataFrame([(run,)], "unit string")
    if table.pending(unit).isEmpty():
        return 0
    new = unseen(urls, table.rows().select("source_url"), "source_url")
    count = new.count()
    scored = score_batches(spread(new, max(1, -(-count // rows_per_task))), "slug", make_scorer)
    table.add(scored.withColumn("unit", F.lit(run)), unit)
    return count
