"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents fall into blocks of about equal words by a hash. Weights and totals give each source
its target, the target gives exact block quotas, and a tree splits the quotas of all sources
among output shards. Each shard draws blocks of its own in a permuted order and is shuffled
within itself. Texts stay where they are: a document's draws follow from its block.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import saved, words

#: Words a block holds about, and the largest number of blocks (their sizes go to the driver).
BLOCK_WORDS, MAX_BLOCKS = 1 << 16, 1 << 17
SHARE, CAP, WEIGHTS = 1.5, 2.0, (3.0, 1.0, 2.0)
SHARDS = 16
#: Words of a shard that are shuffled together, about.
PART_WORDS = 1 << 20


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Words per source: shares by weight of ``share`` x all words, none over ``cap`` x its own.

    What a capped source gives up goes to the others by weight, until none is above its cap.
    """
    out = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], share * sum(sizes)
    for i in set(range(len(sizes))) - set(open_):
        out[i] = 0.0
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in over]
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of each shard (row) by source (column), equal in blocks up to one.

    At each node of the tree the blocks of the left half are a multivariate hypergeometric
    draw from the quotas of the node, so the rows add up to ``quotas`` exactly.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def node(lo: int, hi: int, mine: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = mine
            return
        mid = (lo + hi) // 2
        blocks = int(mine.sum())
        left = blocks * (mid - lo) // (hi - lo)
        drawn = rng.multivariate_hypergeometric(mine, left, method="marginals")
        node(lo, mid, drawn)
        node(mid, hi, mine - drawn)

    if len(quotas):
        node(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


@dataclass
class Mix:
    """What the driver knows of a mix: sources, and the draws of each block."""

    sources: pd.DataFrame  # number, source, source_size, target, blocks
    draws: pd.DataFrame  # number, block, copy, shard
    boundary: pd.DataFrame  # number, block, copy, shard, budget: blocks drawn in part


def unit(seed: int) -> Column:
    """Rows with equal doc_id and text are drawn together."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, words of the text, and the drawing unit of each row."""
    return docs.select(
        "doc_id", "source", F.size(words()).cast("long").alias("size"), unit(seed).alias("unit")
    )


def design(
    sized: DataFrame, weights: tuple[float, ...], share: float, cap: float, shards: int, seed: int
) -> Mix:
    totals = sized.groupBy("source").agg(F.sum("size").alias("words")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["words"]) for r in totals]
    aim = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, cap)
    per_block = max(BLOCK_WORDS, -(-sum(sizes) // MAX_BLOCKS))
    sources = pd.DataFrame(
        {
            "number": range(len(sizes)),
            "source": [r["source"] for r in totals],
            "source_size": sizes,
            "target": aim,
            "blocks": [max(1, s // per_block) for s in sizes],
        }
    )
    empty = pd.DataFrame(columns=["number", "block", "copy", "shard", "budget"], dtype="int64")
    if not sizes:
        return Mix(sources, empty.drop(columns="budget"), empty)
    blocks = (
        with_blocks(sized, sources).groupBy("number", "block").agg(F.sum("size").alias("words"))
    ).collect()
    held = [np.zeros(n, dtype=np.int64) for n in sources["blocks"]]
    for r in blocks:
        held[r["number"]][r["block"]] = r["words"]

    order, parts = [], []
    for i, sizes_of in enumerate(held):
        name = zlib.crc32(repr(totals[i]["source"]).encode())
        rng = np.random.default_rng([seed, name])
        sequence, left = [], int(round(aim[i]))
        for copy in range(int(np.ceil(cap))):
            for block in rng.permutation(len(sizes_of)):
                if left <= 0:
                    break
                if sizes_of[block] > left:  # the last block of the source is drawn in part
                    parts.append((i, int(block), copy, left))
                    left = 0
                elif sizes_of[block]:
                    sequence.append((int(block), copy))
                    left -= int(sizes_of[block])
        order.append(sequence)
    quotas = np.array([len(s) for s in order])
    rng = np.random.default_rng(seed)
    by_shard = split_quotas(quotas, shards, rng)
    rows = []
    for i, sequence in enumerate(order):
        shard_of = np.repeat(np.arange(shards), by_shard[:, i])
        rows += [(i, b, c, int(s)) for (b, c), s in zip(sequence, shard_of)]
    draws = pd.DataFrame(rows, columns=["number", "block", "copy", "shard"], dtype="int64")
    boundary = pd.DataFrame(
        [(i, b, c, int(rng.integers(shards)), left) for i, b, c, left in parts],
        columns=["number", "block", "copy", "shard", "budget"],
        dtype="int64",
    )
    return Mix(sources, draws, boundary)


def with_blocks(rows: DataFrame, sources: pd.DataFrame) -> DataFrame:
    """``rows`` plus number, block, source_size and target of their source.

    One row per source is broadcast.
    """
    few = rows.sparkSession.createDataFrame(
        list(sources.itertuples(index=False, name=None)),
        "number int, __source string, source_size long, target double, blocks int",
    )
    return (
        rows.join(F.broadcast(few), F.col("source").eqNullSafe(F.col("__source")))
        .drop("__source")
        .withColumn("block", F.pmod(F.col("unit"), F.col("blocks")).cast("int"))
        .drop("blocks")
    )


def _frame(spark, rows: pd.DataFrame, schema: str) -> DataFrame:
    return spark.createDataFrame(
        [tuple(int(v) for v in r) for r in rows.itertuples(index=False, name=None)], schema
    )


def chosen_units(sized: DataFrame, mix: Mix) -> DataFrame:
    """Units taken from the blocks drawn in part: largest first, each that still fits.

    One block is one group: about ``BLOCK_WORDS`` words, or a ``MAX_BLOCKS``-th of all words where
    that is more (above 8.6 billion words). The sum misses the budget
    by less than the smallest unit left out. Columns: unit, number, copy, shard.
    """
    spark = sized.sparkSession
    few = _frame(spark, mix.boundary, "number int, block int, copy int, shard int, budget long")
    rows = (
        with_blocks(sized, mix.sources)
        .where("size > 0")
        .join(F.broadcast(few), ["number", "block"])
        .groupBy("number", "copy", "shard", "budget", "unit")
        .agg(F.sum("size").alias("words"))
    )

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["words", "unit"], ascending=[False, True])
        left, taken = int(group["budget"].iloc[0]), []
        for w in group["words"]:
            taken.append(w <= left)
            left -= w if w <= left else 0
        return group.loc[taken, ["unit", "number", "copy", "shard"]]

    return rows.groupBy("number", "copy", "shard", "budget").applyInPandas(
        fill, "unit long, number int, copy int, shard int"
    )


def parts_of(mix: Mix, shards: int) -> int:
    """Parts into which each shard is dealt."""
    return max(1, -(-int(mix.sources["target"].sum()) // (shards * PART_WORDS)))


DRAWS = "number int, block int, copy int, shard int"


def taken_words(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    shards: int = SHARDS,
    seed: int = 17,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, shards.

    ``size`` counts the words of the text (null: 0), ``taken`` the words the mix takes of it,
    repeats counted: whole documents up to ``cap`` times. ``shards`` lists the output shards the
    splitting tree sends these copies to, one number a copy, comma-joined. Sources are ordered by code point,
    null last, and take ``weights`` in turn. Reruns agree. Rows with equal doc_id and text are
    drawn together; an empty table gives no rows; other columns are not read.
    """
    sized = saved(measured(docs, seed), "mix-sizes")
    mix = design(sized, weights, share, cap, shards, seed)
    spark = docs.sparkSession
    shards_of = F.collect_list("shard")
    whole = _frame(spark, mix.draws, DRAWS).groupBy("number", "block").agg(shards_of.alias("n"))
    part = chosen_units(sized, mix).groupBy("unit", "number").agg(shards_of.alias("m"))
    none = F.array().cast("array<int>")
    found = F.sort_array(F.concat(F.coalesce("n", none), F.coalesce("m", none)))
    drawn = F.when(F.col("size") > 0, found).otherwise(none)
    return (
        with_blocks(sized, mix.sources)
        .join(F.broadcast(whole), ["number", "block"], "left")  # a row per block at most
        .join(part, ["unit", "number"], "left")
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("size") * F.size(drawn)).alias("taken"),
            F.array_join(drawn.cast("array<string>"), ",").alias("shards"),
        )
    )


def drawn(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    shards: int = SHARDS,
    seed: int = 17,
) -> DataFrame:
    """The rows of ``docs``, as often as the mix draws them: doc (a struct of their columns),
    shard, part, and order, a random number by which a shard is shuffled. The parts of a shard
    grow with the mix, each holds about ``PART_WORDS`` words.

    The draws are joined to the documents by block; texts are not shuffled. Documents without
    words are never drawn.
    """
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        "source",
        F.size(words()).cast("long").alias("size"),
        unit(seed).alias("unit"),
    )
    sized = saved(measured(docs, seed), "mix-sizes")
    mix = design(sized, weights, share, cap, shards, seed)
    spark = docs.sparkSession
    placed = with_blocks(keyed, mix.sources)
    whole = placed.where("size > 0").join(F.broadcast(_frame(spark, mix.draws, DRAWS)), ["number", "block"])
    part = placed.join(saved(chosen_units(sized, mix), "mix-part"), ["unit", "number"])
    both = whole.select("doc", "copy", "shard", "unit").unionByName(
        part.select("doc", "copy", "shard", "unit")
    )
    order = F.xxhash64("unit", "copy", "shard").alias("order")
    parts = F.lit(parts_of(mix, shards))
    return both.select("doc", "shard", order).select("doc", "shard", F.pmod("order", parts).alias("part"), "order")


def shuffled(rows: DataFrame) -> DataFrame:
    """``drawn`` rows dealt to their shards, each shard in a random order; a shard is split over
    tasks, rows of one task lie in the order of shard, part and random number."""
    return rows.repartition("shard", "part").sortWithinPartitions("shard", "part", "order")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` with their columns, as often as the mix draws them, shard by shard in
    a random order (see ``drawn``)."""
    return shuffled(drawn(docs, **how)).select("doc.*")


def write_shards(rows: DataFrame, path: str) -> None:
    """Write ``drawn`` rows: one folder ``shard=N`` a shard, its rows in a shuffled order."""
    shuffled(rows).write.partitionBy("shard").parquet(path)
