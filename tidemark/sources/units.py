"""Tables written in units (a file slot, a scoring run) that a repeated run cannot double.

A unit's rows lie in a folder of their own and are replaced as a whole. They count once the unit
stands in the log, which is written after them. A run that dies in between leaves rows nobody
reads; the next run writes the unit again over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ensure_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


class UnitTable:
    """Rows below ``path``/data, one folder a unit, and the log of finished units."""

    LOG = "unit string, n_rows long"

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType):
        self.spark, self.path = spark, path.rstrip("/")
        if isinstance(schema, str):
            schema = spark.createDataFrame([], schema).schema
        self.schema = T.StructType([*schema.fields, T.StructField("unit", T.StringType())])

    def log(self) -> DataFrame:
        """Finished units and their rows."""
        ensure_folder(self.spark, f"{self.path}/log")
        return self.spark.read.schema(self.LOG).parquet(f"{self.path}/log")

    def written(self) -> DataFrame:
        """All rows there are, those of unfinished units too."""
        ensure_folder(self.spark, f"{self.path}/data")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data")

    def rows(self) -> DataFrame:
        """The rows of finished units, with ``unit``."""
        return self.written().join(self.log().select("unit"), "unit", "left_semi")

    def pending(self, units: DataFrame) -> DataFrame:
        """Units of ``units`` (column ``unit``) that are not finished."""
        return units.select("unit").distinct().join(self.log().select("unit"), "unit", "left_anti")

    def add(self, rows: DataFrame, units: DataFrame) -> int:
        """Write the rows of ``units``, all of them unfinished, and log these units.

        ``rows`` has a column ``unit`` and the columns of the table; a unit without rows is
        logged with 0. Gives the number of units.
        """
        self.put(rows)
        wanted = units.select("unit").distinct()
        mine = self.written().join(wanted, "unit", "left_semi")  # prunes the other folders
        done = wanted.join(mine.groupBy("unit").agg(F.count(F.lit(1)).alias("n")), "unit", "left")
        entries = done.select("unit", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"))
        before = self.log().count()
        entries.write.mode("append").parquet(f"{self.path}/log")
        return self.log().count() - before

    def put(self, rows: DataFrame) -> None:
        """Replace the rows of the units that ``rows`` holds; a heavy unit is split over tasks."""
        names = [f.name for f in self.schema.fields]
        (
            rows.select(*names)
            .hint("rebalance", "unit")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("unit")
            .parquet(f"{self.path}/data")
        )
