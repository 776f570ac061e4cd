"""Helpers of the training-text operators: table reading, scratch tables, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import run_dir

#: ASCII white space of the word rules: space, tab, line feed, vertical tab, form feed, return.
SPACE = "[\\x20\\x09-\\x0D]+"


BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(frame: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared scratch folder once and read it back.

    Cuts the lineage: the copy survives lost executors, and later jobs reuse it.
    """
    path = run_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def words(text: str | Column = "text") -> Column:
    """The words of a text; none for null. Words are what ASCII white space divides."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def crc_of_id(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def map_texts(
    frame: DataFrame,
    columns: list[str],
    work: Callable[[Iterator[tuple]], Iterator[tuple]],
    schema: str,
    rows_out: int = 4096,
) -> DataFrame:
    """``work`` turns an iterator of rows (tuples of ``columns``) into rows of ``schema``.

    Rows pass one Arrow batch at a time, so a task holds one batch, not its partition. Batches
    of whole texts are kept small: the session's bound on their rows is lowered where it is
    above ``BATCH_ROWS``.
    """
    conf = frame.sparkSession.conf
    if not 0 < int(conf.get(BATCH_CONF, "10000")) <= BATCH_ROWS:
        conf.set(BATCH_CONF, str(BATCH_ROWS))
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    fields = frame.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches):
        def rows():
            for batch in batches:
                for start in range(0, batch.num_rows, 128):  # few Python strings at a time
                    part = batch.slice(start, 128)
                    yield from zip(*[part.column(i).to_pylist() for i in range(part.num_columns)])

        def batch_of(held):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*held), arrow)], names=names
            )

        held = []
        for row in work(rows()):
            held.append(row)
            if len(held) >= rows_out:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    return frame.select(*columns).mapInArrow(run, fields)
