"""Stream jobs: daily roll-up, late rows, one row per id, filter at ingest, burst on closed days.

Each job is a plain transformation plus a runner. Runners process what is there and stop
(``availableNow``), keep their progress in a checkpoint folder, and write files, so a run that
loses executors resumes where it was, and nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import rollups, series
from tidemark.sources.readers import is_file
from tidemark.sources.sinks import contains_any

def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", per_trigger: int = 0
) -> DataFrame:
    """A stream of the files below ``path``; ``per_trigger`` bounds the files of one batch.

    A single file is streamed as its folder with a name filter, as sources watch folders.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if is_file(spark, path):
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def run_to_files(
    stream: DataFrame, out: str, checkpoint: str, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Append everything available to Parquet under ``out`` and read it back."""
    spark = stream.sparkSession
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Hand every micro-batch to ``handle``, which must be safe to repeat for a batch id."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def event_time(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp; the session runs in UTC."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def daily_rollup(stream: DataFrame, delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """Daily event roll-up in append mode: a day appears once the watermark has passed it.

    ``stream`` holds typed event rows. State is one entry per open day.
    """
    days = F.window(ts, "1 day")
    rolled = (
        event_time(stream, ts)
        .withWatermark(ts, delay)
        .groupBy(days.alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.avg("tone").alias("avg_tone"),
            F.avg("goldstein").alias("avg_goldstein"),
            F.sum("mentions").alias("total_mentions"),
        )
    )
    return rolled.select(
        F.to_date("_w.start").alias("event_date"),
        "event_count",
        "avg_tone",
        "avg_goldstein",
        "total_mentions",
    )


def once_per_id(stream: DataFrame, key: str, delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """Each id once, however often a drop repeats it within the watermark delay."""
    return event_time(stream, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def ingest_filter(stream: DataFrame, text: str, tokens: Sequence[str]) -> DataFrame:
    """Stateless filter at ingest: rows whose text holds one of the tokens."""
    return stream.filter(contains_any(text, tokens))


def batch_files(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """What the batches wrote under ``out``; no rows where no batch has run yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)


def count_late(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """On-time, late and undated rows per file day; late means the event day precedes it.

    The three counts of a day add up to its rows. Each batch writes its counts into a folder
    named by its id, so a repeated batch replaces its own counts. A stream without files yet
    gives no rows.
    """
    spark = stream.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        late = F.col("event_date") < F.col("file_date")
        counts = batch.groupBy("file_date").agg(
            F.count_if(~late).alias("on_time"),
            F.count_if(late).alias("late"),
            F.count_if(late.isNull()).alias("undated"),
        )
        counts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_batches(stream, handle, checkpoint)
    counts = ("on_time", "late", "undated")
    schema = "file_date date, " + ", ".join(f"{c} long" for c in counts)
    return (
        batch_files(spark, out, schema)
        .groupBy("file_date")
        .agg(*[F.sum(c).alias(c) for c in counts])
    )


def burst_on_closed_days(
    stream: DataFrame, out: str, checkpoint: str, rows: int = 30, delay: str = "1 day"
) -> DataFrame:
    """Burst score over closed days: the stream adds days, the window runs on the day table."""
    spark = stream.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.select("event_date", "event_count").write.mode("overwrite").parquet(
            f"{out}/batch={batch_id}"
        )

    run_batches(daily_rollup(stream, delay), handle, checkpoint)
    closed = batch_files(spark, out, "event_date date, event_count long")
    return series.burst(closed, "event_date", "event_count", rows)


def in_waves(
    waves: Sequence[DataFrame], landing: str, run: Callable[[], DataFrame]
) -> DataFrame:
    """Let files land one wave after the other and run the job after each.

    Every run starts a new query from the checkpoint of the one before, so state, watermark and
    progress pass over a restart. The last run's result comes back.
    """
    out = None
    for wave in waves:
        wave.write.mode("append").parquet(landing)
        out = run()
    if out is None:
        raise ValueError("no wave has landed")
    return out


def upsert_days(
    stream: DataFrame, out: str, checkpoint: str, delay: str = "1 day", ts: str = "ts"
) -> DataFrame:
    """Daily roll-up with days still open: a day is there from its first row on.

    Update mode hands on the days a batch has changed; each batch writes them to a folder named
    by its id, so a repeated batch replaces its own rows, and the latest version of a day counts.
    ``open`` says that rows of the day may still come: the day ends after the newest timestamp
    less ``delay``.
    """
    spark = stream.sparkSession
    rolled = (
        event_time(stream, ts)
        .withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day").alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.sum("tone").alias("_tone"),
            F.count("tone").alias("_toned"),
            F.sum("mentions").alias("total_mentions"),
            F.max(ts).alias("newest"),
        )
        .select(F.to_date("_w.start").alias("event_date"), "event_count", "_tone", "_toned",
                "total_mentions", "newest")
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        rolled.writeStream.foreachBatch(handle)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = (
        "event_date date, event_count long, _tone double, _toned long, total_mentions long, "
        "newest timestamp, batch_id long"
    )
    versions = batch_files(spark, out, schema)
    names = ("event_count", "_tone", "_toned", "total_mentions", "newest")
    days = (
        versions.groupBy("event_date")
        .agg(F.max_by(F.struct(*names), "batch_id").alias("_d"), F.count(F.lit(1)).alias("n_versions"))
        .select("event_date", "_d.*", "n_versions")
    )
    closed = days.agg((F.max("newest") - F.expr(f"INTERVAL '{delay}'")).alias("_m")).scalar()
    end = F.date_add("event_date", 1).cast("timestamp")
    return days.select(
        "event_date",
        "event_count",
        F.try_divide("_tone", "_toned").alias("avg_tone"),
        "total_mentions",
        (end > closed).alias("open"),
        "n_versions",
    )


def conflict_stream(stream: DataFrame, countries, classes) -> DataFrame:
    return rollups.conflict_rows(stream, countries, classes)
