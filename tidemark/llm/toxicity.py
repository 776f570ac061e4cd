"""Toxicity by weak supervision.

One pass over the texts writes the hashed features of every document, words and their
beginnings; all later steps read those. Voters are lexicons and patterns mined from labelled
training rows. A generative label model over the votes of all rows that are not held out
estimates each voter's accuracy and the correlations between voters, and turns votes into
posterior labels. A linear classifier is trained on those posteriors and scores every document.
Texts are read in tasks only; the driver gets sums.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import crc_of_id, map_texts, saved

#: Bound of the rows whose label is used, all others vote without.
LABELLED = 6_000
#: Lengths of the beginnings of a word that are features beside the word.
PREFIXES = (3, 4, 5)
#: A feature goes by so many bits of its hash.
BITS = 24
#: Lexicons that vote for label 1; a fourth as many vote for label 0.
VOTERS = 48
#: Features of the linear classifier: those that separate the posterior labels most.
FEATURES = 4_096
#: Steps of the label model, and most steps of the classifier; its ridge.
STEPS, FIT_STEPS, RIDGE = 25, 60, 0.3
#: Posteriors are summed as whole numbers of this unit, so that order changes nothing.
UNIT = 1 << 20
#: Words, features or vote patterns a task holds before it hands its counts on.
HELD = 200_000
COUNTED = 1 << 22
#: Partial sums that the driver takes at most; more are added up in tasks first.
PARTIAL = 256

#: Fixed values, a small general lexicon: one voter beside the mined ones.
INSULTS = (
    "idiot moron scum loser trash pathetic worthless disgusting stupid clown dumb filthy hateful"
).split()

#: ASCII letters stay, other ASCII becomes a space; bytes of other scripts stay.
_LETTERS = bytes(
    c if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms(text: str | None) -> set[bytes]:
    """The distinct lower-case letter runs of a text."""
    return set((text or "").lower().encode().translate(_LETTERS).split())


def shapes(word: str) -> list[str]:
    """Features of a word: itself and its beginnings."""
    return [word, *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)]


def feature(shape: str) -> int:
    """A feature goes by its hash."""
    return crc32(shape.encode()) >> 32 - BITS


_HIGH = np.arange(256, dtype=np.uint32) << 16


def packed(keys: np.ndarray) -> bytes:
    """Sorted 24-bit keys in little more than two bytes each: their low halves, after a count for
    each high byte; few keys, or very many, after the high bytes themselves."""
    low, high = (keys & 0xFFFF).astype("<u2").tobytes(), (keys >> 16).astype(np.uint8)
    if len(keys) > 256:
        counts = np.bincount(high, minlength=256)
        if counts.max() < 256:
            return b"\x01" + counts.astype(np.uint8).tobytes() + low
    return b"\x00" + high.tobytes() + low


def unpacked(data: bytes) -> np.ndarray:
    if data[0]:
        high = np.repeat(_HIGH, np.frombuffer(data, np.uint8, 256, 1))
        return high | np.frombuffer(data, "<u2", -1, 257)
    n = (len(data) - 1) // 3
    return np.frombuffer(data, np.uint8, n, 1).astype(np.uint32) << 16 | np.frombuffer(data, "<u2", n, 1 + n)


class _Shapes(dict):
    """The features of a word as bytes, little-endian; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= HELD:
            self.clear()
        found = np.array([feature(x) for x in shapes(word.decode())], "<u4").tobytes()
        self[word] = found
        return found


def feature_sets(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and keys: the distinct features of the text (see ``packed``)."""

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = _Shapes()
        for doc_id, held, text in rows:
            found = b"".join(map(known.__getitem__, terms(text)))
            yield doc_id, held, packed(np.unique(np.frombuffer(found, "<u4")))

    marked = docs.select("doc_id", "text").withColumn("held_out", held_out())
    schema = "doc_id long, held_out boolean, keys binary"
    return saved(map_texts(marked, ["doc_id", "held_out", "text"], work, schema, 512), "toxicity_sets")


def flat_sets(column) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a batch, and how many each row has."""
    sets = [unpacked(b) for b in column.to_pylist()]
    sizes = np.array([len(x) for x in sets], np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint32), sizes


class Lookup:
    """Which of some keys are known, and where."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys & 0xFFFFF] = True

    def find(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``flat`` that hold a known key, and the number of that key."""
        at = np.flatnonzero(self.maybe[flat & 0xFFFFF])
        if not len(self.keys) or not len(at):
            return at[:0], at[:0]
        near = np.searchsorted(self.keys, flat[at]).clip(max=len(self.keys) - 1)
        hit = self.keys[near] == flat[at]
        return at[hit], self.order[near[hit]]


class Voters:
    """Lexicons of label 1, then such of label 0, then a pattern voter for label 0: none of the
    lexicons of label 1 speaks. A row's votes are one whole number, a bit a voter."""

    def __init__(self, toxic: list[list[int]], clean: list[list[int]]):
        mask: dict[int, int] = {}
        lexicons = [*toxic, [feature(w) for w in INSULTS], *clean]
        for j, lexicon in enumerate(lexicons):
            for f in lexicon:
                mask[f] = mask.get(f, 0) | 1 << j
        self.lookup = Lookup(np.array(list(mask), np.uint32))
        self.mask = np.array(list(mask.values()), np.int64)
        self.toxic, self.count = (1 << len(toxic) + 1) - 1, len(lexicons) + 1

    def votes(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes), np.int64)
        at, which = self.lookup.find(flat)
        np.bitwise_or.at(out, np.searchsorted(sizes.cumsum(), at, "right"), self.mask[which])
        return np.where(out & self.toxic, out, out | 1 << self.count - 1)

    def both(self, votes: np.ndarray) -> np.ndarray:
        """Row x (votes of 1 of each voter, then votes of 0 of each voter)."""
        on = (votes[:, None] >> np.arange(self.count)) & 1
        ones = np.arange(self.count) < self.toxic.bit_length()
        return np.hstack([on * ones, on * ~ones]).astype(float)


class _Counts:
    """Rows and label sums by feature (a number below 2^24), merged as they come."""

    def __init__(self):
        self.flat, self.weight, self.size = [], [], 0
        self.key, self.n, self.ones = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, flat: np.ndarray, weight: np.ndarray) -> None:
        self.flat.append(flat)
        self.weight.append(weight)
        self.size += len(flat)
        if self.size >= COUNTED:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.key, *[f.astype(np.int64) for f in self.flat]])
        value, at = np.unique(keys, return_inverse=True)
        n = np.concatenate([self.n, np.ones(self.size, np.int64)])
        ones = np.concatenate([self.ones, *self.weight])
        self.n = np.bincount(at, n, len(value)).astype(np.int64)
        self.ones = np.bincount(at, ones, len(value)).astype(np.int64)
        self.key, self.flat, self.weight, self.size = value, [], [], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.key), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            columns = [pa.array(self.key[part].astype(np.int32)), pa.array(self.n[part]), pa.array(self.ones[part])]
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "n", "ones"])
        self.key, self.n, self.ones = (np.zeros(0, np.int64) for _ in range(3))


#: Stands for all rows among the features.
ALL = -1


def feature_counts(
    sets: DataFrame, voters: Voters, weigh: Callable[[list[int | None], np.ndarray], np.ndarray]
) -> DataFrame:
    """feature, n (rows that have it) and ones (sum of ``weigh(doc_ids, votes)`` over them)."""

    def run(batches):
        counts, rows, total = _Counts(), 0, 0
        for batch in batches:
            flat, sizes = flat_sets(batch.column(1))
            weight = weigh(batch.column(0).to_pylist(), voters.votes(flat, sizes))
            rows += len(sizes)
            total += int(weight.sum())
            counts.add(flat, np.repeat(weight, sizes))
            if len(counts.key) >= COUNTED:
                yield from counts.batches()
        if counts.size:
            counts.merge()
        yield from counts.batches()
        if rows:
            columns = [pa.array([x], t) for x, t in ((ALL, pa.int32()), (rows, pa.int64()), (total, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "n", "ones"])

    parts = sets.select("doc_id", "keys").mapInArrow(run, "feature int, n long, ones long")
    sums = parts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    return saved(sums, "toxicity_features")


def strengths(counts: DataFrame) -> tuple[DataFrame, float, float]:
    """Features with their signed log-likelihood ratio to the (soft) label where chance, given
    how many features are tried, does not explain it; the number of rows and the sum of labels."""
    whole = counts.where(F.col("feature") == ALL).first()
    n, total = (float(whole["n"]), whole["ones"] / UNIT) if whole else (0.0, 0.0)
    found = counts.where(F.col("feature") != ALL)
    with_, ones = F.col("n").cast("double"), F.col("ones") / F.lit(float(UNIT))

    def term(k, size):
        share = F.least(F.lit(1.0), F.greatest(F.lit(1e-9), k / F.greatest(size, F.lit(1e-9))))
        return k * F.log(share)

    def ratio(ones: Column) -> Column:
        return 2 * (
            term(ones, with_)
            + term(with_ - ones, with_)
            + term(F.lit(total) - ones, n - with_)
            + term(n - with_ - (F.lit(total) - ones), n - with_)
            - term(F.lit(total), F.lit(n))
            - term(F.lit(n - total), F.lit(n))
        )

    # features too rare to pass, whatever their labels, are no trials
    every = max(2, found.count())
    tried = max(2, found.where(ratio(F.least(with_, F.lit(total))) > 2 * math.log(every)).count())
    g = ratio(ones)
    signed = F.when(ones * n > with_ * total, g).otherwise(-g)
    rated = found.select("feature", g.alias("g"), signed.alias("strength"))
    return rated.where(F.col("g") > 2 * math.log(tried)), n, total


def mine(rated: DataFrame) -> Voters:
    """Lexicons that point to label 1, and such that point to label 0."""

    def dealt(sign: int, voters: int) -> list[list[int]]:
        # strong features first; each voter gets its share of all strengths
        found = rated.where(sign * F.col("strength") > 0)
        first = found.orderBy(-sign * F.col("strength"), "feature").limit(8 * VOTERS).collect()
        order = [r["feature"] for r in first]
        return [order[i::voters] for i in range(min(voters, len(order)))]

    return Voters(dealt(1, VOTERS), dealt(-1, VOTERS // 4))


Model = tuple[float, np.ndarray]  # log odds of label 1: constant, and one term for each vote


def posterior(both: np.ndarray, known: np.ndarray, model: Model) -> np.ndarray:
    """Label 1 for each row; ``known`` is 1, 0, or -1 where no label is used."""
    z = model[0] + both @ model[1]
    z += np.where(known >= 0, np.where(known > 0, 1, -1) * math.log(98), 0)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def vote_sums(both: np.ndarray, known: np.ndarray, count: np.ndarray, model: Model | float):
    """All that a step needs of the rows, by sums; with a prior for ``model``, before the first
    step, the pairs of votes as well."""
    first = isinstance(model, float)
    post = np.where(known >= 0, known * 0.98 + 0.01, model) if first else posterior(both, known, model)
    w = count * post
    sums = [[count.sum(), w.sum(), (w * post).sum()], count @ both, w @ both]
    if first:
        half = both.shape[1] // 2
        votes = both[:, :half] - both[:, half:]
        sums.append(((count[:, None] * votes).T @ votes).ravel())
    return np.concatenate(sums)


def model_step(sums: np.ndarray, pairs: np.ndarray, prior: float) -> Model:
    """One step of expectation maximisation from the sums of the step before.

    Each voter has its rates of both votes and of silence under both labels; without the rates
    of silence, rows on which nobody votes would keep the prior and drag it up. Voters that
    speak together more than their accuracies explain are correlated: their weights are divided
    by the number of voters they amount to.
    """
    n, s1, squares = sums[:3]
    whole, ones = sums[3:].reshape(2, -1)
    zeros, s0, m = whole - ones, n - s1, len(whole) // 2
    r1, r0 = (ones + 0.1) / (s1 + 1), (zeros + 0.1) / (s0 + 1)
    q1 = (s1 - ones[:m] - ones[m:] + 0.1) / (s1 + 1)
    q0 = (s0 - zeros[:m] - zeros[m:] + 0.1) / (s0 + 1)
    # correlation of what the labels leave unexplained: votes less p * a + (1 - p) * b
    a, b = r1[:m] - r1[m:], r0[:m] - r0[m:]
    mixed = np.outer(ones[:m] - ones[m:], a) + np.outer(zeros[:m] - zeros[m:], b)
    cross = np.outer(a, b)
    expected = squares * np.outer(a, a) + (s1 - squares) * (cross + cross.T)
    expected += (n - 2 * s1 + squares) * np.outer(b, b)
    rest = (pairs - mixed - mixed.T + expected) / n
    scale = np.sqrt(np.diag(rest).clip(0)) + 1e-6
    together = np.abs(rest / np.outer(scale, scale))
    weight = 1.0 / np.where(together > 0.1, together, 0).sum(axis=1).clip(1.0)
    silent = weight * np.log(q1.clip(1e-9) / q0.clip(1e-9))
    votes = np.tile(weight, 2) * np.log(r1 / r0) - np.tile(silent, 2)
    return math.log(prior / (1 - prior)) + silent.sum(), votes


def fit_votes(gather: Callable[[Model | float], np.ndarray], voters: int, prior: float, steps: int) -> Model:
    """``gather`` gives ``vote_sums`` of all rows under a model."""
    prior = float(np.clip(prior, 0.01, 0.99))
    sums = gather(prior)
    at = 3 + 4 * voters
    sums, pairs = sums[:at], sums[at:].reshape(voters, voters)
    model = model_step(sums, pairs, prior)
    for _ in range(steps - 1):
        sums = gather(model)
        model = model_step(sums, pairs, float(np.clip(sums[1] / sums[0], 0.005, 0.995)))
    return model


def calibrated(model: Model, both: np.ndarray, known: np.ndarray, count: np.ndarray) -> Model:
    """Log odds drawn in to what the used labels bear out: Platt's scaling on the rows with a
    label. Voters that fall silent together would else make silent rows far too sure."""
    z = model[0] + both @ model[1]
    n1, n0 = count[known > 0].sum(), count[known == 0].sum()
    target = np.where(known > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, c = np.stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(c @ x, -30, 30)))
        hessian = (x * (count * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, x @ (count * (p - target)) + 1e-3 * (c - (1, 0)))
        c = c - move / max(1.0, float(np.abs(move).max()) / 0.2)
        if np.abs(move).max() < 1e-6:
            break
    if c[0] >= 1:
        return model
    slope = max(float(c[0]), 0.01)
    return slope * model[0] + float(c[1]), slope * model[1]


def label_model(votes: np.ndarray, known: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Posterior of label 1 for each row of ``votes`` (1, -1, 0), by expectation maximisation.

    ``known`` holds training labels, NaN where none is used; they enter as a voter of fixed
    accuracy.
    """
    both = np.hstack([votes == 1, votes == -1]).astype(float)
    has = ~np.isnan(known)
    prior = float(known[has].mean()) if has.any() else 0.1
    known, count = np.where(has, known, -1), np.ones(len(votes))
    model = fit_votes(lambda m: vote_sums(both, known, count, m), votes.shape[1], prior, steps)
    return posterior(both, known, model)


def vote_patterns(sets: DataFrame, voters: Voters, labels: dict[int, int]) -> DataFrame:
    """votes, known (label, or -1) and n: the rows of ``sets`` by what is voted on them."""
    shared = sets.sparkSession.sparkContext.broadcast(labels)

    def run(batches):
        seen: Counter[tuple[int, int]] = Counter()

        def out():
            votes, known = zip(*seen)
            columns = [pa.array(votes, pa.int64()), pa.array(known, pa.int32()), pa.array(seen.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["votes", "known", "n"])

        for batch in batches:
            votes = voters.votes(*flat_sets(batch.column(1))).tolist()
            seen.update(zip(votes, [shared.value.get(i, -1) for i in batch.column(0).to_pylist()]))
            if len(seen) >= HELD:
                yield out()
                seen.clear()
        if seen:
            yield out()

    parts = sets.select("doc_id", "keys").mapInArrow(run, "votes long, known int, n long")
    return saved(parts.groupBy("votes", "known").agg(F.sum("n").alias("n")), "toxicity_votes")


def summed(frame: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum of ``part`` over all batches, in the order of the tasks.

    One vector a task is made; beyond ``PARTIAL`` tasks these are added up in tasks first, about
    as many to a group as there are groups, so that the driver takes few.
    """

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                sums = part(batch)
                total = sums if total is None else total + sums
        if total is not None:
            columns = [pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["task", "sums"])

    parts = frame.mapInArrow(run, "task long, sums binary")
    tasks = frame.rdd.getNumPartitions()
    if tasks > PARTIAL:
        width = math.isqrt(tasks)

        def add(key, group):
            group = group.sort_values("task")
            vector = sum(np.frombuffer(b) for b in group["sums"])
            return group.head(1).assign(sums=[vector.tobytes()])[["task", "sums"]]

        grouped = parts.withColumn("g", F.floor(F.col("task") / width))
        parts = grouped.groupBy("g").applyInPandas(add, "task long, sums binary")
    found = sorted(parts.collect(), key=lambda r: r["task"])
    return sum((np.frombuffer(r["sums"]) for r in found), np.zeros(1))


def linear_model(design: DataFrame, size: int, start: float) -> tuple[np.ndarray, float]:
    """Logistic regression on the presence of features, targets are posteriors: L-BFGS, one pass
    over the rows (post, features) a step. Weights and bias."""

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        def part(batch):
            post = np.asarray(batch.column(0))
            lists = batch.column(1).to_pylist()
            col = np.frombuffer(b"".join(lists), np.uint16)
            row = np.repeat(np.arange(len(post)), [len(b) // 2 for b in lists])
            z = x[-1] + np.bincount(row, x[col], len(post))
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - post
            loss = (np.logaddexp(0, z) - post * z).sum()
            return np.concatenate(([loss], np.bincount(col, err[row], size), [err.sum()]))

        out = summed(design, part)
        grad = out[1:] + RIDGE * np.append(x[:-1], 0)
        return out[0] + RIDGE / 2 * float(x[:-1] @ x[:-1]), grad

    x = np.append(np.zeros(size), start)
    f, g = value(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(FIT_STEPS):
        move, alphas = -g, []
        for s, y in reversed(pairs):
            alphas.append(s @ move / (s @ y))
            move = move - alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            move = move * (s @ y) / (y @ y)
        else:
            move = move / max(1.0, float(np.linalg.norm(g)))
        for (s, y), alpha in zip(pairs, reversed(alphas)):
            move = move + (alpha - y @ move / (s @ y)) * s
        step, slope = 1.0, float(g @ move)
        for _ in range(20):
            f2, g2 = value(x + step * move)
            if f2 <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * move, g2 - g
        if s @ y > 1e-12:
            pairs = [*pairs[-9:], (s, y)]
        done = f - f2 <= 1e-7 * abs(f)
        x, f, g = x + s, f2, g2
        if done:
            break
    return x[:-1], float(x[-1])


Linear = tuple[np.ndarray, np.ndarray, float]  # features, their weights, bias


def train(spark: SparkSession, sets: DataFrame, labels: dict[int, int]) -> Linear:
    """The classifier from all rows of ``sets``; ``labels`` are those that may be used."""
    shared = spark.sparkContext.broadcast(labels)
    chosen = spark.createDataFrame([(i,) for i in labels], "doc_id long")

    def marks(ids: list[int | None]) -> np.ndarray:
        return np.array([shared.value.get(i, -1) for i in ids], np.int64)

    marked = feature_counts(
        sets.join(F.broadcast(chosen), "doc_id"), Voters([], []), lambda ids, _: UNIT * marks(ids)
    )
    rated, n, ones = strengths(marked)
    if not 0 < ones < n:
        return np.zeros(0, np.uint32), np.zeros(0), -2.0
    voters = mine(rated)
    patterns = vote_patterns(sets, voters, labels)

    def gather(model: Model | float) -> np.ndarray:
        def part(batch):
            votes, known, count = (np.asarray(batch.column(i)) for i in range(3))
            return vote_sums(voters.both(votes), known, count.astype(float), model)

        return summed(patterns, part)

    model = fit_votes(gather, voters.count, ones / n, STEPS)
    pairs = patterns.where("known >= 0").groupBy("votes").pivot("known", [0, 1]).agg(F.sum("n"))
    pairs = np.array(pairs.na.fill(0).collect(), dtype=np.int64).reshape(-1, 3)
    both = voters.both(np.tile(pairs[:, 0], 2))
    model = calibrated(model, both, np.repeat([0, 1], len(pairs)), pairs[:, 1:].T.ravel() * 1.0)

    def post(ids: list[int | None], votes: np.ndarray) -> np.ndarray:
        return np.rint(UNIT * posterior(voters.both(votes), marks(ids), model)).astype(np.int64)

    rated, n, ones = strengths(feature_counts(sets, voters, post))
    best = rated.orderBy(-F.col("g"), "feature").limit(FEATURES).select("feature").collect()
    used = np.array([r["feature"] for r in best], np.uint32)

    def run(batches):
        lookup = Lookup(used)
        for batch in batches:
            flat, sizes = flat_sets(batch.column(1))
            y = post(batch.column(0).to_pylist(), voters.votes(flat, sizes)) / UNIT
            at, which = lookup.find(flat)
            ends = np.searchsorted(at, sizes.cumsum())
            rows = [x.astype("<u2").tobytes() for x in np.split(which, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(rows, pa.binary())], names=["post", "features"])

    design = saved(sets.select("doc_id", "keys").mapInArrow(run, "post double, features binary"), "toxicity_design")
    weights, bias = linear_model(design, len(used), math.log((ones + 1) / (n - ones + 1)))
    return used, weights, bias


def held_out() -> Column:
    return F.coalesce(F.pmod(crc_of_id(), F.lit(4)) == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    ``labels`` has doc_id and toxic. All rows that are not held out (crc32 of doc_id as text,
    mod 4, is 2) are trained on; labels are used of at most ``labelled`` ids, those with the
    smallest hash. Scores read nothing but the text. A null or empty text gets the score of no
    features; a null doc_id is not held out; repeated rows count each and get equal scores;
    without labels of both kinds all scores are equal; an empty table gives no rows.
    """
    spark = docs.sparkSession
    usable = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(~held_out())
    )
    ids = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    wanted = {r["doc_id"]: int(r["toxic"]) for r in ids.collect()}
    sets = feature_sets(docs)
    used, weights, bias = train(spark, sets.where(~F.col("held_out")), wanted)

    def run(batches):
        lookup = Lookup(used)
        for batch in batches:
            flat, sizes = flat_sets(batch.column(2))
            at, which = lookup.find(flat)
            row = np.searchsorted(sizes.cumsum(), at, "right")
            z = bias + np.bincount(row, weights[which], len(sizes))
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            predicted = pa.array((score >= 0.3).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), predicted],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return sets.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
