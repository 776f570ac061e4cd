"""Exact duplicates by two passes over hashes with a Bloom filter between them.

Pass 1 hashes every text once into a fingerprint table and counts how often each filter cell
is hit. Cells hit at least twice form the filter: its bits are set where a repetition is
possible. Pass 2 probes the cell of each row; only rows for which it is set shuffle to their
group, the rest pass straight through. Groups that hold a large share of all rows are joined by
broadcast. Everything is DataFrame and SQL functions.

The filter has a bounded size (``bloom.MAX_CELLS``, 64 MB). Far above 17 million rows it fills up:
more rows without a copy then take the way of the suspects, the results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm.shared import SPACE, saved

#: A row has one cell, so the filter has twice the cells a row that two cells would need.
CELLS_FACTOR = 2


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, row number, SHA-256 of the normalised text."""
    return saved(
        docs.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            F.sha2(normalised().cast("binary"), 256).alias("text_sha256"),
        ),
        "fingerprints",
    )


def cell(sha: str, cells: int) -> Column:
    """Cell number from 1 on, from the digest."""
    return F.pmod(F.conv(F.substring(sha, 1, 15), 16, 10).cast("long"), F.lit(cells)) + 1


def repeated_cells(prints: DataFrame) -> tuple[DataFrame, int]:
    """Pass 1: the filter of cells that two or more rows hit, as bitmaps, and its size.

    One cell number a row is counted, combined in map tasks first, so a text that a third of all
    rows share costs each task one number. Ids, digests and texts stay where they are.
    """
    cells = bloom.cells_for(CELLS_FACTOR * prints.count())
    hit = prints.select(cell("text_sha256", cells).alias("cell")).groupBy("cell")
    twice = hit.agg(F.count(F.lit(1)).alias("hits")).where("hits > 1").select("cell")
    return saved(bloom.bitmaps(twice), "bloom-cells"), cells


def flagged(frame: DataFrame, maps: DataFrame, cells: int) -> DataFrame:
    """Pass 2: ``frame`` (with text_sha256) plus ``possible``: its cell is in the filter."""
    return bloom.probed(frame, maps, cell("text_sha256", cells), "possible")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical once each run of ASCII white space is one space.
    The row with the smallest doc_id of a group is kept. A null text counts as empty; a null
    doc_id sorts last; of rows with the same text and doc_id exactly one is kept. An empty
    table gives no rows. Other columns of ``docs`` are not read.
    """
    prints = fingerprints(docs)
    marked = saved(flagged(prints, *repeated_cells(prints)), "bloom-marked")
    once = marked.where(~F.col("possible")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    perhaps = marked.where("possible").drop("possible")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    groups = perhaps.groupBy("text_sha256").agg(first, F.count(F.lit(1)).alias("group_size"))
    groups = saved(groups, "copy-groups")
    repeats = bloom.joined_to_groups(perhaps, groups, "text_sha256", "group_size").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )
    return once.unionByName(repeats)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``.

    Rows outside the filter pass without a shuffle. Of the others, the row with the smallest
    doc_id of its group stays; where several rows share text and doc_id, one of them.
    """
    prints = fingerprints(docs)
    maps, cells = repeated_cells(prints)
    groups = (
        flagged(prints, maps, cells)
        .where("possible")
        .groupBy("text_sha256", "doc_id")
        .agg(F.count(F.lit(1)).alias("ties"))
        .groupBy("text_sha256")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "ties")).alias("keep"),
            F.sum("ties").alias("size"),
        )
        .where("size > 1")
    )
    groups = saved(groups, "copy-groups")
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")).withColumn(
        "text_sha256",
        F.sha2(F.regexp_replace(F.coalesce("doc.text", F.lit("")), SPACE, " ").cast("binary"), 256),
    )
    marked = flagged(inner, maps, cells)
    straight = marked.where(~F.col("possible")).select("doc.*")
    perhaps = marked.where("possible").drop("possible")
    joined = bloom.joined_to_groups(perhaps, groups, "text_sha256", "size", "left").where(
        F.col("keep").isNull() | F.col("doc.doc_id").eqNullSafe(F.col("keep.doc_id"))
    )
    single = joined.where(F.coalesce(F.col("keep.ties"), F.lit(1)) == 1).select("doc.*")
    tied = joined.where("keep.ties > 1").dropDuplicates(["text_sha256"]).select("doc.*")
    return straight.unionByName(single).unionByName(tied)
