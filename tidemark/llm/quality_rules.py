"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Every document first gets the base counts. Words and word pairs are hashed into a fixed number
of cells, and counted over all documents (raw) and over the trusted ones (target). A document's
score is the sum of log(target / raw) over its n-grams, divided by their number, and a fixed
threshold decides every document. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import saved, words

CELLS = 1 << 16
#: Pseudo-counts that draw a cell's target share to its raw share: rare n-grams decide little.
PRIOR = 20.0
THRESHOLD = -0.18
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
WINDOW = 5


def _count(pattern: str) -> Column:
    return F.length("__t").cast("long") - F.length(F.regexp_replace("__t", pattern, ""))


def once(value: Column) -> Column:
    """``value``, worked out in its own projection only.

    A condition on the row number makes it nondeterministic to the optimizer, which then
    neither moves filters below it nor repeats it inside the functions that read it.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def hashed_words(rows: DataFrame) -> DataFrame:
    """``rows`` plus __w (words of __t), __x (their hashes) and __p (hashes of neighbouring pairs).

    Each word's bytes are hashed once; pairs and windows combine those numbers.
    """
    pairs = F.transform("__x", lambda x, i: F.xxhash64(x, F.get("__x", i + 1)))
    return (
        rows.withColumn("__w", once(words("__t")))
        .withColumn("__x", once(F.transform("__w", lambda w: F.xxhash64(w))))
        .withColumn("__p", once(F.slice(pairs, F.lit(1), F.greatest(F.size("__x") - 1, F.lit(0)))))
    )


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` plus __t (text, null as empty), the columns of ``hashed_words`` and the base columns."""
    rows = hashed_words(docs.withColumn("__t", F.coalesce("text", F.lit(""))))
    n = F.size("__w")
    # five words are two pairs and a word
    windows = F.when(
        n >= WINDOW,
        F.transform(
            F.slice("__p", F.lit(1), F.greatest(n - WINDOW + 1, F.lit(0))),
            lambda p, i: F.xxhash64(p, F.get("__p", i + 2), F.get("__x", i + 4)),
        ),
    )
    lines = F.filter(F.split("__t", "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.withColumns({"__h": once(windows), "__lines": once(lines)})
    # windows by hash and place, only where some window occurs again
    ordered = F.when(
        F.size(F.array_distinct("__h")) < F.size("__h"),
        F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
    )
    rows = rows.withColumn("__s", once(ordered))
    again = F.filter(
        "__s",
        lambda x, i: ((i > 0) & (F.get("__s", i - 1)["h"] == x["h"]))
        | F.coalesce(F.get("__s", i + 1)["h"] == x["h"], F.lit(False)),
    )
    rows = rows.withColumn("__a", once(F.array_sort(F.transform(again, lambda x: x["p"]))))
    covered = F.aggregate(
        F.transform(
            "__a",
            lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__a", i + 1) - p, F.lit(WINDOW))),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    rows = rows.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": _count("[#*$%&|<>]"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": once(F.coalesce(covered, F.lit(0)).cast("long")),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")
    )
    return rows.withColumn("base_failed", failed).drop("__h", "__s", "__a", "__lines")


def ngram_cells(cells: int = CELLS) -> Column:
    """The cells of all words (__x) and all pairs of neighbouring words (__p)."""
    return F.transform(F.concat("__x", "__p"), lambda h: F.pmod(h, F.lit(cells)).cast("int"))


def looks_trusted() -> Column:
    """Default target: plain running text by strict counts that need no other table."""
    upper = F.length("__t") - F.length(F.regexp_replace("__t", "\\p{Lu}+", ""))
    symbols = F.length("__t") - F.length(F.regexp_replace("__t", "[#*$%&|<>]+", ""))
    lines = F.filter(F.split("__t", "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    return (
        (F.size("__w") >= 2 * MIN_WORDS)
        & (20 * symbols < F.size("__w"))
        & (5 * upper < F.length("__t"))
        & (F.size(lines) == F.size(F.array_distinct(lines)))
    )


def log_ratios(docs: DataFrame, trusted: Column | None = None, cells: int = CELLS) -> str:
    """log(target / raw) of each cell, comma-joined in cell order: ``cells`` numbers.

    Counts cover all documents and are combined within each task, so a task sends one row
    per cell at most, whatever the number of documents.
    """
    rows = hashed_words(docs.select(F.coalesce("text", F.lit("")).alias("__t")))
    rows = rows.select(
        once(ngram_cells(cells)).alias("c"), (looks_trusted() if trusted is None else trusted).alias("y")
    )
    counts = saved(
        rows.select(F.explode("c").alias("cell"), F.col("y").cast("int").alias("y"))
        .groupBy("cell")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("y").alias("target")),
        "ngram-counts",
    )
    total = counts.agg(F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    sums = total.first()
    raws, targets = float(sums.raws or 0), float(sums.targets or 0)
    if not raws or not targets:
        return ",".join(["0"] * cells)
    # expected target count of a cell if it held its raw share
    expected = F.col("raw") * F.lit(targets / raws)
    ratio = F.log((F.col("target") + PRIOR) / (expected + PRIOR))
    every = counts.select("cell", F.round(ratio, 5).alias("r"))
    return _joined(every, cells)


def _joined(every: DataFrame, cells: int) -> str:
    spread = every.sparkSession.range(cells).select(F.col("id").cast("int").alias("cell"))
    full = spread.join(every, "cell", "left").select("cell", F.coalesce("r", F.lit(0.0)).alias("r"))
    return (
        full.agg(F.array_sort(F.collect_list(F.struct("cell", "r"))).alias("a"))
        .select(F.array_join(F.transform("a", lambda x: x["r"].cast("string")), ","))
        .first()[0]
    )


def quality_rules(
    docs: DataFrame,
    trusted: Column | None = None,
    cells: int = CELLS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    score and kept.

    n_repeat_words counts the words inside 5-word windows that occur at least twice in the
    text. A document fails the base rules with fewer than 10 words, or when over 20 % of its
    words are such repeats; its kept is false. Any other document is kept when its score is at
    least ``threshold``. A null or empty text has no words and fails; repeated rows get equal
    verdicts; an empty table gives no rows; columns of ``docs`` pass through unless they have
    the name of a result.
    """
    values = log_ratios(docs, trusted, cells)
    table = F.split(F.lit(values), ",").cast("array<double>")  # folded to one constant
    rows = base_counts(docs).withColumn("__c", once(ngram_cells(cells)))
    total = F.aggregate("__c", F.lit(0.0), lambda a, c: a + F.get(table, c))
    score = F.when(F.size("__c") > 0, F.round(total / F.size("__c"), 6)).otherwise(F.lit(0.0))
    return (
        rows.withColumn("score", once(score))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .drop("__w", "__x", "__p", "__c", "__t")
    )


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with the columns of ``docs``."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = quality_rules(docs.select(F.struct(*names).alias("doc"), "doc_id", "text"), **options)
    return rows.where("kept").select("doc.*")
