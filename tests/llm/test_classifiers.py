"""Classifiers: parts against brute force, and accuracy on held-out rows."""

import itertools
import zlib

import numpy as np
import pytest

from tidemark.llm import quality_crf, queries, toxicity

SMALL = "/root/testdata/sf0.01"


def auc(label, score):
    order = np.argsort(score, kind="stable")
    score, label = np.asarray(score)[order], np.asarray(label)[order]
    _, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    ends = counts.cumsum()
    rank = (ends - (counts - 1) / 2)[inverse]
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


@pytest.mark.parametrize(
    "name, column, mod, rest, cut, least",
    [("op3_toxicity", "toxic", 4, 2, 0.3, 0.8), ("op10_quality_crf", "quality", 3, 1, 0.5, 0.95)],
)
def test_held_out_accuracy(spark, name, column, mod, rest, cut, least):
    got = queries.queries()[name](spark, SMALL)
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= cut)
    held = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    assert auc(*zip(*held)) > least


def test_labels_of_held_out_rows_are_not_read(spark, odd):
    rows = [(r.doc_id, r.doc_id % 2) for r in odd.where("doc_id < 30").select("doc_id").collect()]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in rows]
    out = []
    for labels in (rows, flipped):
        frame = spark.createDataFrame(labels, "doc_id long, quality int")
        out.append(sorted(map(str, quality_crf.quality(odd, frame).collect())))
    assert out[0] == out[1]


def test_odd_and_empty_tables(spark, odd, none):
    for run, column in ((toxicity.toxicity, "toxic"), (quality_crf.quality, "quality")):
        labels = spark.createDataFrame(
            [(100, 1), (101, 0), (101, None), (None, 1), (999, 1)] + [(i, i % 2) for i in range(30)],
            f"doc_id long, {column} int",
        )
        rows = run(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert run(none, labels).count() == 0
        assert len({r.score for r in run(odd, labels.limit(0)).collect()}) == 1


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    chain = quality_crf.Chain(np.zeros(3 * quality_crf.LINE), rng.normal(size=(2, 2)))
    node = rng.normal(size=6)
    whole, good = 0.0, np.zeros(6)
    for y in itertools.product((0, 1), repeat=6):
        weight = np.exp(
            sum(node[i] * y[i] for i in range(6)) + sum(chain.moves[y[i], y[i + 1]] for i in range(5))
        )
        whole += weight
        good += weight * np.array(y)
    assert np.allclose(chain.line_marginals(node), good / whole)
    padded = np.zeros((2, 8))
    padded[0, :6] = node
    mask = np.zeros((2, 8), dtype=bool)
    mask[0, :6] = mask[1, :1] = True
    marginals, pair, _ = chain.marginals(padded, mask)
    assert np.allclose(marginals[0, :6], good / whole) and pair.sum() == pytest.approx(5)


def test_feature_sets_are_packed_without_loss():
    rng = np.random.default_rng(6)
    for n in (0, 1, 200, 257, 5000, 90_000):
        keys = np.unique(rng.integers(0, 1 << 24, n).astype(np.uint32))
        assert (toxicity.unpacked(toxicity.packed(keys)) == keys).all()
        assert len(toxicity.packed(keys)) <= 3 * len(keys) + 1
    lookup = toxicity.Lookup(keys[::3])
    at, which = lookup.find(keys)
    assert at.tolist() == list(range(0, len(keys), 3)) and (keys[::3][which] == keys[at]).all()


def test_gradient_equals_differences():
    """Documents of 2, 3 and 40 lines: no document steers the transitions by its length."""
    rng = np.random.default_rng(4)
    docs = [rng.normal(size=(n, quality_crf.LINE)) for n in (2, 3, 40)]
    (batch,) = quality_crf.batches(docs, [1, 0, 1])
    at = rng.normal(size=3 * quality_crf.LINE + 4) / 3

    def loss(z):
        return quality_crf.gradient(quality_crf.Chain(z[:-4], z[-4:].reshape(2, 2)), *batch)

    grad = loss(at)[1]
    for i in range(len(at)):
        step = np.zeros(len(at))
        step[i] = 1e-5
        assert grad[i] == pytest.approx((loss(at + step)[0] - loss(at - step)[0]) / 2e-5, abs=1e-6)


def test_batches_are_bounded():
    docs = [np.ones((n, quality_crf.LINE)) for n in [1] * 600 + [300] * 200 + [40_000]]
    found = quality_crf.batches(docs, [0] * len(docs))
    assert sum(len(y) for *_, y in found) == len(docs)
    assert all(m.size <= max(quality_crf.LINES, m.shape[1]) and len(y) <= 250 for _, m, y in found)


def test_label_model_weighs_accurate_voters_and_discounts_copies():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3

    def voter(rate):
        flip = rng.random(4000) > rate
        return np.where(y ^ flip, 1, -1)

    poor = voter(0.55)
    votes = np.stack([voter(0.9), voter(0.85), voter(0.8), *[poor] * 6], axis=1).astype(np.int8)
    known = np.where(rng.random(4000) < 0.05, y, np.nan)
    post = toxicity.label_model(votes, known)
    # the six copies of a poor voter don't outvote three good ones
    assert ((post > 0.5) == y).mean() > 0.9


def test_wording_of_any_unlabelled_row_reaches_the_classifier(spark):
    from pyspark.sql import functions as F

    def filler(i):
        return " ".join(f"plain{chr(97 + i * k % 23)}{chr(97 + (i + k) % 19)}" for k in range(1, 12))

    ids = spark.range(6000).where("pmod(crc32(cast(cast(id as string) as binary)), 4) != 2").orderBy(F.xxhash64("id"), "id")
    ids = [r.id for r in ids.collect()]
    labelled = {i: int(n % 4 == 0) for n, i in enumerate(sorted(ids)[:200])}
    rest = [i for i in ids if i not in labelled]
    rows = [(i, filler(i) + (" grumblefoo snarklebar" if y else "")) for i, y in labelled.items()]
    # beyond any thousand unlabelled rows, the labelled wording comes with another word
    late = {i: ("grumblefoo", "snarklebar")[n % 2] for n, i in enumerate(rest[1500::4])}
    rows += [(i, filler(i) + (f" {late[i]} zorbax" if i in late else "")) for i in rest]
    rows += [(10_000, "zorbax"), (10_001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(list(labelled.items()), "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    # a word that the classifier doesn't know leaves the score of no features
    assert abs(score[10_000] - score[10_001]) > 0.01
