"""Resampling a corpus towards a target distribution.

Hashed counts of words and word pairs of the corpus and of a target corpus give each bucket a
gain, an array that scores every document in one pass. A Gumbel perturbation of the score turns
"take the highest" into a weighted draw without replacement. The highest k are found by
distributed quickselect: random pivot keys, exact counts of the keys below, at and between them,
and only the part that holds the k-th key goes on. Only the winners are sorted and ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import map_texts, saved
from tidemark.operators.numbering import numbered

BUCKETS, ORDER, LEAST_WORDS, SHARE, SEED = 10_000, 2, 20, 25, 7
#: Pivot keys of a round; a part of at most so many keys is settled by its own pivots.
PIVOTS = 64
#: Features a task holds before it counts them.
HELD = 1 << 20

#: ASCII letters in lower case and digits stay, other ASCII becomes a space; other bytes stay.
_PLAIN = bytes(
    c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32
    for c in range(256)
)


def feature_hashes(text: str | None, order: int = ORDER) -> tuple[int, np.ndarray]:
    """Number of words, and the CRC-32 of every run of 1 to ``order`` words joined by a space."""
    words = (text or "").encode().translate(_PLAIN).split()
    runs = list(map(crc32, words))
    out = [np.array(runs, np.uint32)]
    spaced = [b" " + w for w in words]
    for k in range(1, order):
        # the CRC of a run goes on from that of the run one word shorter
        runs = list(map(crc32, spaced[k:], runs))
        out.append(np.array(runs, np.uint32))
    return len(words), np.concatenate(out)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """How many features of the column ``text`` fall in each bucket, over all rows."""

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        total, held, size = np.zeros(buckets, np.int64), [], 0
        for (text,) in rows:
            hashes = feature_hashes(text, order)[1]
            held.append(hashes % buckets)
            size += len(hashes)
            if size >= HELD:
                total += np.bincount(np.concatenate(held), minlength=buckets)
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=buckets)
        at = np.flatnonzero(total)
        yield from zip(at.tolist(), total[at].tolist())

    parts = map_texts(texts, ["text"], work, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1,000 times the log ratio of the smoothed bucket shares, floored."""
    s_all, t_all, n = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array(
        [
            math.floor(1000.0 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
            for s, t in zip(corpus.tolist(), target.tolist())
        ],
        np.int64,
    )


def weighed(docs: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean gain) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        gain = shared.value
        for doc_id, text in rows:
            words, hashes = feature_hashes(text, order)
            n = len(hashes)
            weight = int(gain[hashes % len(gain)].sum()) // n if n else 0
            yield doc_id, words, n, weight

    return map_texts(
        docs, ["doc_id", "text"], work, "doc_id long, n_words long, n_features long, weight long"
    )


def perturbation(seed: int, doc_id: str = "doc_id") -> Column:
    """1,000 times a Gumbel variate of (seed, doc_id), floored."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    first = F.substring(F.sha2(name.cast("binary"), 256), 1, 8)
    h = F.conv(first, 16, 10).cast("long").cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


#: The composite key, smaller first: higher scores, then smaller ids, then the row.
KEY = ("down", "no_id", "id", "row")


def keyed(frame: DataFrame) -> DataFrame:
    """``frame`` with the columns of ``KEY``; it has doc_id, score and row."""
    return frame.select(
        "*",
        (-F.col("score")).alias("down"),
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"),
    )


def literal_key(key: tuple) -> Column:
    kinds = ("long", "boolean", "long", "long")
    return F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(key, kinds, KEY)])


def kth_key(keys: DataFrame, k: int, seed: int, pivots: int = PIVOTS) -> tuple:
    """The ``k``-th smallest (from 1) of distinct keys, columns ``KEY``.

    A round takes random pivot keys of what is left, counts the keys below, at and between them
    exactly, and keeps the part with the k-th key, written anew, so that the work of all rounds
    is about that of the first. The driver sees pivots and counts only.
    """
    left, step = keys, 0
    while True:
        step += 1
        shuffled = left.orderBy(F.xxhash64(F.lit(seed), F.lit(step), "row"), "row")
        found = sorted(tuple(r) for r in shuffled.limit(pivots).select(*KEY).collect())
        if not found:
            raise ValueError(f"fewer keys than {k} are left")
        points = F.array(*[literal_key(p) for p in found])
        mine = F.struct(*KEY)
        parted = left.withColumn("below", F.size(F.filter(points, lambda p: p < mine))).withColumn(
            "at", F.exists(points, lambda p: p == mine)
        )
        counts = {(r["below"], r["at"]): r["count"] for r in parted.groupBy("below", "at").count().collect()}
        for below in range(len(found) + 1):
            between = counts.get((below, False), 0)
            if k <= between:
                rest = parted.where((F.col("below") == below) & ~F.col("at"))
                left = saved(rest.select(*KEY), "select-part")
                break
            k -= between
            if below < len(found):
                if k <= counts[below, True]:
                    return found[below]
                k -= counts[below, True]
        else:
            raise ValueError("k exceeds the number of keys")


def target_scores(
    docs: DataFrame,
    target: DataFrame,
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    order: int = ORDER,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank, all long.

    ``target`` has the texts (column ``text``) whose distribution is aimed at. Of the N rows of
    at least ``least_words`` words the floor(share * N / 100) with the highest scores are drawn
    and ranked from 1; rank is null for all others. Ties go to the smaller doc_id, a null doc_id
    last; rows that tie on both are drawn and ranked one after the other. A null text has no
    words: weight 0, never drawn. An empty target is a uniform one; an empty table gives no
    rows. Other columns are not read.
    """
    corpus = bucket_counts(docs.select("text"), buckets, order)
    aim = bucket_counts(target.select("text"), buckets, order)
    rows = weighed(docs, gains(corpus, aim), order).withColumn("row", F.monotonically_increasing_id())
    scored = rows.withColumn("score", F.col("weight") + perturbation(seed)).withColumn(
        "open", F.col("n_words") >= least_words
    )
    scores = saved(keyed(scored), "target-scores")
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    open_ = scores.where("open")
    k = share * open_.count() // 100
    if k <= 0:
        return scores.select(*out, none)
    last = kth_key(open_.select(*KEY), k, seed)
    wins = F.col("open") & (F.struct(*KEY) <= literal_key(last))
    winners = scores.where(wins).where(F.col("down") <= last[0])  # the latter reaches the scan
    ranked = numbered(winners.select(*out, *KEY), list(KEY), "rank")
    return scores.where(~wins).select(*out, none).unionByName(ranked.select(*out, "rank"))


def resampled(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The rows of ``docs`` that ``target_scores`` draws, whole and with all their columns.

    Rows that share a doc_id come and go together: they stay if one of them is drawn.
    """
    drawn = target_scores(docs, target, **how).where("rank IS NOT NULL")
    chosen = drawn.select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("__drawn")), "left_semi")
