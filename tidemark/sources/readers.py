"""Typed readers over landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import schemas

def _tsv(spark: SparkSession, path: str, schema: T.StructType, partitioned: bool):
    fields = list(schema.fields)
    if partitioned:
        fields.append(T.StructField("date", T.DateType()))
    reader = (
        spark.read.option("sep", "\t")
        # a stray double quote is data here; the default quote would swallow tabs
        .option("quote", "")
        .option("recursiveFileLookup", "false")
    )
    return reader, T.StructType(fields), path


def events_tsv(
    spark: SparkSession, path: str, partitioned: bool = True, glob: str = "*.export.CSV"
) -> DataFrame:
    """Headerless 61-field event drops below ``date=YYYY-MM-DD`` folders, all text.

    A short row is kept and padded with NULL; a longer row keeps its first 61 fields.
    """
    reader, schema, path = _tsv(spark, path, schemas.EVENTS, partitioned)
    return reader.option("pathGlobFilter", glob).schema(schema).csv(path)


def articles_tsv(
    spark: SparkSession, path: str, partitioned: bool = True, glob: str = "*.gkg.csv"
) -> DataFrame:
    """Headerless 27-field article drops; malformed (short or long) rows are skipped."""
    reader, schema, path = _tsv(spark, path, schemas.ARTICLES, partitioned)
    return (
        reader.option("mode", "DROPMALFORMED")
        # column pruning would stop the parser before it can see that a row is short
        .option("columnPruning", "false")
        .option("pathGlobFilter", glob)
        .schema(schema)
        .csv(path)
    )


def article_rejects(
    spark: SparkSession, path: str, partitioned: bool = True, glob: str = "*.gkg.csv"
) -> DataFrame:
    """The rows ``articles_tsv`` skips, counted per partition day (or over all files)."""
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    by = ["date"] if partitioned else []
    width = F.size(F.split("value", "\t", -1))
    return lines.groupBy(*by).agg(
        F.count_if((F.length("value") > 0) & (width != len(schemas.ARTICLE_COLUMNS))).alias(
            "rejected_rows"
        ),
        F.count_if(F.length("value") > 0).alias("read_rows"),
    )


def headed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quoted commas and doubled quotes, under an explicit schema."""
    return (
        spark.read.option("header", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", "false")
        .schema(schema)
        .csv(path)
    )


def json_rows(spark: SparkSession, path: str, schema: str, a_line: bool = False) -> DataFrame:
    """Landed API payloads ``{"data": [...]}``: one row per array element over all files.

    A file is one payload, or holds one on each line (``a_line``), which lets Spark split it.
    """
    return (
        spark.read.option("multiLine", str(not a_line).lower())
        .schema(schema)
        .json(path)
        .select(F.explode("data").alias("row"))
        .select("row.*")
    )


def half_hour_prices(
    spark: SparkSession, path: str, provider: str | None = None, a_line: bool = False
) -> DataFrame:
    """Price payloads as rows: price_date (UTC day of the start), start, price.

    Text that is no time gives a NULL day. ``provider`` keeps one of the sources of a payload.
    """
    rows = json_rows(spark, path, schemas.HALF_HOUR_PRICES, a_line)
    if provider is not None:
        rows = rows.filter(F.col("dataProvider") == provider)
    start = F.try_to_timestamp(F.col("startTime"), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    return rows.select(F.to_date(start).alias("price_date"), start.alias("start"), "price")


def half_hour_generation(spark: SparkSession, path: str, a_line: bool = False) -> DataFrame:
    """Generation payloads as rows: price_date, fuel, amount (text; see ``mix_shares``)."""
    rows = json_rows(spark, path, schemas.HALF_HOUR_GENERATION, a_line)
    return rows.select(
        F.try_to_date("settlementDate", "yyyy-MM-dd").alias("price_date"),
        F.col("fuelType").alias("fuel"),
        F.col("generation").alias("amount"),
    )


def is_file(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(target) and fs.getFileStatus(target).isFile())


def optional_source(spark: SparkSession, path: str, glob: str = "*") -> bool:
    """True when at least one file exists under ``path`` (also below partition folders)."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    for pattern in (f"{path}/{glob}", f"{path}/*/{glob}"):
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(pattern))
        if found is not None and any(status.isFile() for status in found):
            return True
    return is_file(spark, path)
