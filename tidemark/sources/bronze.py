"""Columnar copies of the landed text files.

Text must be parsed whole to read one column, and 96 small files a day cost more to open than
to read. One ingest job casts the rows, drops what no roll-up reads, and writes Parquet by
partition day; views then prune days and columns and push code filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.sources import readers, sinks, typed


def copy_events(spark: SparkSession, raw_path: str, out: str) -> None:
    sinks.write_partitioned(typed.typed_events(readers.events_tsv(spark, raw_path)), out)


def copy_articles(spark: SparkSession, raw_path: str, out: str, tokens=()) -> None:
    """Article rows; with ``tokens`` only those whose theme list holds one of them."""
    rows = typed.typed_articles(readers.articles_tsv(spark, raw_path))
    if tokens:
        rows = rows.filter(sinks.contains_any("themes", tokens))
    sinks.write_partitioned(rows, out)


def read_copy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def register(spark: SparkSession, name: str, path: str, schema: T.StructType, by: str) -> None:
    """An external table over a partitioned folder that something else has written.

    The catalog finds the partitions itself; the folder stays where the table is dropped.
    """
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    columns = T.StructType([*[f for f in schema.fields if f.name != by], schema[by]])
    spark.sql(
        f"CREATE TABLE {name} ({columns.toDDL()}) USING parquet PARTITIONED BY (`{by}`) LOCATION '{path}'"
    )
    spark.catalog.recoverPartitions(name)
