"""Landed text drops: one permissive parse that keeps what it rejects, and resumable ingest.

A drop is a folder ``date=YYYY-MM-DD/slot=HHMMSS`` of headerless tab-separated lines. Each line is
split once; it is accepted or has a problem, so accepted and rejected lines add up to the lines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import schemas, sinks, typed
from tidemark.sources.units import UnitTable


@dataclass(frozen=True)
class Layout:
    """Fields of a line. With ``pad`` a short line is filled up with NULL and a long one cut."""

    columns: tuple[str, ...]
    pad: bool


EVENT_LINES = Layout(schemas.EVENT_COLUMNS, pad=True)
ARTICLE_LINES = Layout(schemas.ARTICLE_COLUMNS, pad=False)


def lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Lines of a drop: value, date, slot, file."""
    return (
        spark.read.option("pathGlobFilter", glob)
        .schema("value string, date date, slot string")
        .text(path)
        .select("value", "date", "slot", F.col("_metadata.file_path").alias("file"))
    )


def parsed(drop: DataFrame, layout: Layout) -> DataFrame:
    """The columns of ``layout`` as text, ``problem`` (NULL: accepted) and ``n_fields``.

    Problems: ``blank``, and for layouts that are not filled up ``short`` and ``long``. An empty
    field is NULL; a double quote is data. All other columns pass through, the line too.
    """
    width = len(layout.columns)
    cut = drop.withColumn("_f", F.split(F.rtrim("value", F.lit("\r")), "\t", -1))
    n = F.when(F.trim("value") == "", 0).otherwise(F.size("_f"))
    problem = F.when(n == 0, "blank")
    if not layout.pad:
        problem = problem.when(n < width, "short").when(n > width, "long")
    fields = [F.nullif(F.get("_f", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(layout.columns)]
    return cut.select(*drop.columns, *fields, problem.alias("problem"), n.alias("n_fields"))


def unit_of(date: Column | str = "date", slot: Column | str = "slot") -> Column:
    """The stamp ``yyyyMMddHHmmss`` of a slot."""
    date, slot = (F.col(c) if isinstance(c, str) else c for c in (date, slot))
    return F.concat(F.date_format(date, "yyyyMMdd"), slot)


def landed_units(spark: SparkSession, path: str) -> DataFrame:
    """Slots of a drop that hold a file with something in it, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    at = [F.regexp_extract("path", p, 1) for p in (r"date=([0-9-]+)/", r"slot=([0-9]+)/")]
    return (
        files.where("length > 0")
        .select(F.concat(F.replace(at[0], F.lit("-"), F.lit("")), at[1]).alias("unit"))
        .distinct()
    )


def ingest(
    spark: SparkSession,
    path: str,
    table: UnitTable,
    prepare: Callable[[DataFrame], DataFrame],
) -> int:
    """Load the slots of the drop at ``path`` that ``table`` has not finished.

    ``prepare`` turns lines (with ``unit``) into rows of the table. Only the folders of open
    slots are read. Run again after a failure or with nothing new it adds nothing twice. Gives
    the number of slots finished.
    """
    units = table.pending(landed_units(spark, path))
    if units.isEmpty():
        return 0
    # open slots, held fixed for this run: more may land while it reads
    open_ = spark.createDataFrame([(r["unit"],) for r in units.collect()], "unit string")
    drop = lines(spark, path).withColumn("unit", unit_of())
    return table.add(prepare(drop.join(F.broadcast(open_), "unit", "left_semi")), open_)


ARTICLE_ROWS = (
    "article_id string, event_date date, themes string, locations string, tone string, "
    "scores string, problem string, line string"
)


def article_rows(tokens: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """``prepare`` for article drops: lines whose theme field holds a token, parsed and typed.

    A rejected line is kept whole in ``line``, with its problem and without values.
    """

    def prepare(drop: DataFrame) -> DataFrame:
        rows = parsed(sinks.ingest_filter(drop, tokens), ARTICLE_LINES)
        good = F.col("problem").isNull()
        kept = typed.typed_articles(rows.drop("date")).columns
        values = {
            "article_id": F.col("gkgrecordid"),
            "event_date": typed.day_of("gkg_datestamp"),
            "themes": F.col("v1themes"),
            "locations": F.col("v2enhancedlocations"),
            "tone": F.col("v2tone"),
            "scores": F.col("v21gcam"),
        }
        return rows.select(
            *[F.when(good, values[c]).alias(c) for c in kept],
            "problem",
            F.when(~good, F.col("value")).alias("line"),
            "unit",
        )

    return prepare


def gaps(expected: DataFrame, table: UnitTable) -> DataFrame:
    """Expected slots (``stamp``) that are not finished yet."""
    return expected.join(table.log().select(F.col("unit").alias("stamp")), "stamp", "left_anti")
