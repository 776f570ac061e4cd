"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled bad or good. A line's potentials read its own features and those of its
neighbours, and a transition table links neighbouring labels. Forward-backward gives each line
its marginal of being good; marginals weighted by line length make the document's quality.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import crc_of_id, map_texts

#: Bound of the labelled documents whose line features reach the driver for training.
LABELLED = 4_000
SYMBOLS = b"#*$%&|<>{}[]\\^~=_"
WINDOW = 5
#: Steps, step size and ridge of the training.
STEPS, RATE, RIDGE = 250, 0.05, 1e-3
#: Documents and padded lines of a training batch.
DOCS, LINES = 250, 25_000

_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_PUNCT = b".,;:!?"


def _without(data: bytes, table: bytes) -> int:
    return len(data) - len(data.translate(None, table))


def repeats(words: list[bytes]) -> np.ndarray:
    """For each word whether a 5-word window with it occurs again in the text."""
    n = len(words)
    out = np.zeros(n, dtype=bool)
    if n < WINDOW + 1:
        return out
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    key = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : n - WINDOW + 1 + k]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    for k in range(WINDOW):
        out[again + k] = True
    return out


LINE = 14  # features of one line, the first is constant


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Line x feature, and the weight (bytes) of each line. Lines without a word are left out;
    a text without words is one line of weight 1."""
    lines = [(s, w) for s in (text or "").encode().split(b"\n") if (w := s.split())]
    if not lines:
        empty = np.zeros((1, LINE))
        empty[0, :2] = 1
        return empty, np.ones(1)
    words = [w for _, ws in lines for w in ws]
    again = repeats(words)
    counts = np.array([len(ws) for _, ws in lines])
    starts = np.concatenate(([0], counts.cumsum()[:-1]))
    covered = np.add.reduceat(again, starts) / counts
    seen = Counter(s for s, _ in lines)
    total = len(words)
    rows = np.empty((len(lines), LINE))
    for i, (line, ws) in enumerate(lines):
        size, n = len(line), len(ws)
        letters = _without(line, _LETTER)
        rows[i] = (
            1.0,
            0.0,
            math.log1p(n) / 5,
            min(3.0, _without(line, SYMBOLS) / n),
            _without(line, _UPPER) / (letters + 1),
            _without(line, _DIGIT) / size,
            min(3.0, _without(line, _PUNCT) / n),
            covered[i],
            1.0 if seen[line] > 1 and n > 2 else 0.0,
            sum(map(bytes.__eq__, ws, ws[1:])) / n,
            len(set(ws)) / n,
            min(3.0, size / n / 8),
            1.0 if n < 4 else 0.0,
            math.log1p(total) / 10,
        )
    return rows, np.array([len(s) for s, _ in lines], dtype=float)


def with_neighbours(rows: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and after (zeros at the ends)."""
    none = np.zeros((1, rows.shape[1]))
    return np.hstack([rows, np.vstack([none, rows[:-1]]), np.vstack([rows[1:], none])])


class Chain:
    """Two labels, 0 bad and 1 good; only differences of potentials matter."""

    def __init__(self, weight: np.ndarray, moves: np.ndarray):
        self.weight, self.moves = weight, moves  # features; 2 x 2

    @classmethod
    def untrained(cls) -> Chain:
        return cls(np.zeros(3 * LINE), np.zeros((2, 2)))

    def marginals(self, node: np.ndarray, mask: np.ndarray, share: np.ndarray | None = None):
        """Forward-backward over padded documents: ``node`` (document x line) is the potential
        of good. Marginals of good, sums of pair marginals (a document counts ``share``), and the
        log of the partition sums."""
        n, length = node.shape
        share = np.ones(n) if share is None else share
        pot = np.stack([np.zeros_like(node), node], axis=2)
        ahead, back = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        ahead[:, 0] = pot[:, 0]
        for i in range(1, length):
            step = np.logaddexp.reduce(ahead[:, i - 1, :, None] + self.moves, axis=1) + pot[:, i]
            ahead[:, i] = np.where(mask[:, i, None], step, ahead[:, i - 1])
        for i in range(length - 2, -1, -1):
            step = np.logaddexp.reduce(
                self.moves + (pot[:, i + 1] + back[:, i + 1])[:, None, :], axis=2
            )
            back[:, i] = np.where(mask[:, i + 1, None], step, back[:, i + 1])
        whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
        good = np.exp(ahead[:, :, 1] + back[:, :, 1] - whole[:, None]) * mask
        pair = np.zeros((2, 2))
        for i in range(1, length):
            both = (
                ahead[:, i - 1, :, None]
                + self.moves
                + (pot[:, i] + back[:, i])[:, None, :]
                - whole[:, None, None]
            )
            pair += (np.exp(both) * (mask[:, i] * share)[:, None, None]).sum(axis=0)
        return good, pair, whole

    def quality(self, rows: np.ndarray, weight: np.ndarray) -> float:
        node = with_neighbours(rows) @ self.weight
        if len(node) == 1:  # one line: its marginal needs no chain
            return float(1 / (1 + np.exp(-np.clip(node[0], -50, 50))))
        good = self.line_marginals(node)
        return float(np.clip((good * weight).sum() / weight.sum(), 0, 1))

    def line_marginals(self, node: np.ndarray) -> np.ndarray:
        """Marginals of one document. Log odds suffice: each step keeps one number a line."""
        (a, b), (c, d) = np.exp(self.moves - self.moves.max())
        n = len(node)
        e = np.exp(np.clip(node, -50, 50)).tolist()
        ahead, back = [0.0] * n, [1.0] * n  # odds of good against bad
        ahead[0] = e[0]
        for i in range(1, n):
            p = ahead[i - 1]
            ahead[i] = e[i] * (b + p * d) / (a + p * c)
        for i in range(n - 2, -1, -1):
            q = e[i + 1] * back[i + 1]
            back[i] = (c + d * q) / (a + b * q)
        odds = np.array(ahead) * np.array(back)
        return odds / (1 + odds)


def gradient(chain: Chain, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss of a batch and its gradient: the negative log-likelihood a line, averaged over the
    documents, and the ridge. ``x`` is document x line x feature, ``y`` the documents' labels."""
    lines = mask.sum(axis=1)
    share = 1.0 / lines  # the lines of a long document share one document's weight
    node = x @ chain.weight
    good, pair, whole = chain.marginals(node, mask, share)
    moves = (lines - 1) * share
    seen = np.array([[(moves * (1 - y)).sum(), 0.0], [0.0, (moves * y).sum()]])
    right = ((node * mask).sum(axis=1) * y * share).sum() + (seen * chain.moves).sum()
    loss = ((whole * share).sum() - right) / len(y)
    loss += RIDGE / 2 * float((chain.weight**2).sum() + (chain.moves**2).sum())
    miss = (good - y[:, None] * mask) * share[:, None]
    return loss, np.append(
        np.einsum("nl,nlf->f", miss, x) / len(y) + RIDGE * chain.weight,
        ((pair - seen) / len(y) + RIDGE * chain.moves).ravel(),
    )


def batches(docs: list[np.ndarray], labels: list[int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of about equal numbers of lines, padded: ``DOCS`` at most, and ``LINES`` padded
    lines unless one document alone has more."""
    order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
    parts: list[list[int]] = []
    for i in order:
        if parts and len(parts[-1]) < DOCS and (len(parts[-1]) + 1) * len(docs[i]) <= LINES:
            parts[-1].append(i)
        else:
            parts.append([i])
    out = []
    for part in parts:
        longest = len(docs[part[-1]])
        x = np.zeros((len(part), longest, 3 * LINE))
        mask = np.zeros((len(part), longest), dtype=bool)
        for j, i in enumerate(part):
            x[j, : len(docs[i])] = with_neighbours(docs[i])
            mask[j, : len(docs[i])] = True
        out.append((x, mask, np.array([labels[i] for i in part], dtype=float)))
    return out


def train(docs: list[np.ndarray], labels: list[int]) -> Chain:
    """Maximum likelihood; each line of a training document has the document's label.

    ``docs`` are line features. A document counts as one, however many lines it has; a step
    takes one batch.
    """
    chain = Chain.untrained()
    if not docs:
        return chain
    groups = batches(docs, labels)
    m = np.zeros(3 * LINE + 4)
    v = np.zeros_like(m)
    for t in range(1, STEPS + 1):
        _, grad = gradient(chain, *groups[(t * 7919) % len(groups)])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        chain.weight = chain.weight - move[:-4]
        chain.moves = chain.moves - move[-4:].reshape(2, 2)
    return chain


def held_out() -> Column:
    return F.coalesce(F.pmod(crc_of_id(), F.lit(3)) == 1, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    ``labels`` has doc_id and quality. Only rows that are not held out (crc32 of doc_id as
    text, mod 3, is 1) are trained on, at most ``labelled`` of them, those with the smallest
    hash. Scores read nothing but the text, whole. A null or empty text is scored as one line
    without words; a null doc_id is not held out; repeated rows get equal scores; without
    labels every score is 0.5; an empty table gives no rows.
    """
    spark = docs.sparkSession
    usable = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .where(~held_out())
    )
    ids = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()
    chosen = spark.createDataFrame([(r["doc_id"], r["quality"]) for r in ids], "doc_id long, y int")
    def features(found: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, y, text in found:
            yield doc_id, y, line_features(text)[0].tobytes()

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    rows = map_texts(sample, ["doc_id", "y", "text"], features, "doc_id long, y int, lines binary", 64)
    found = sorted(rows.collect(), key=lambda r: r["doc_id"])
    chain = train(
        [np.frombuffer(r["lines"]).reshape(-1, LINE) for r in found], [int(r["y"]) for r in found]
    )
    model = spark.sparkContext.broadcast((chain.weight, chain.moves))

    def work(found: Iterator[tuple]) -> Iterator[tuple]:
        chain = Chain(*model.value)
        for doc_id, held, text in found:
            score = chain.quality(*line_features(text))
            yield doc_id, held, score, int(score >= 0.5)

    return map_texts(
        docs.withColumn("held_out", held_out()),
        ["doc_id", "held_out", "text"],
        work,
        "doc_id long, held_out boolean, score double, predicted int",
    )
