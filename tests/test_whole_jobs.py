"""Scoring reads the whole text of a document and every order of a month-end day."""

import hashlib
import math
from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import scoring

TEXTS = {28: "Les mots und more words, the end. " * 40, 29: "the plain, und words: der sea " * 50}


def slug_of(text):
    words = "".join(c if c.isalnum() else " " for c in text).split()
    return " ".join([*words, hashlib.md5(text.encode()).hexdigest()])


def scores_of(text):
    words = slug_of(text).lower().split()
    up, down = (
        sum(w in known for w in words) / len(words)
        for known in (entry.bindings.LEXICON.positive, entry.bindings.LEXICON.negative)
    )
    weights = [math.exp(8 * up), math.exp(0.5), math.exp(8 * down)]
    return [w / sum(weights) for w in weights]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two texts near one month-end order that is not urgent; the first text has a label."""
    path = tmp_path_factory.mktemp("whole")
    frames = {
        "orders": ([(7, date(1998, 1, 31), "5-LOW", "O", 10.0)],
                   "o_orderkey long, o_orderdate date, o_orderpriority string, o_orderstatus string,"
                   " o_totalprice double"),
        "documents": ([(i, t, "en", "s1", len(t)) for i, t in TEXTS.items()],
                      "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(28, 1, 0)], "doc_id long, quality int, toxic int"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_batch_score_scores_whole_texts(spark, tables):
    got = {r.slug: r for r in entry.queries()["batch_score"](spark, tables).collect()}
    assert set(got) == {slug_of(t) for t in TEXTS.values()}
    for text in TEXTS.values():
        row = got[slug_of(text)]
        found = [row.finbert_positive, row.finbert_neutral, row.finbert_negative]
        assert found == pytest.approx(scores_of(text), abs=1e-6)


def test_incremental_append_adds_whole_texts(spark, tables):
    got = {r.slug: r for r in entry.queries()["incremental_append"](spark, tables).collect()}
    assert set(got) == {None, slug_of(TEXTS[29])}
    assert all(r.source_url.startswith("https://e.com/s1/") for r in got.values())
    assert "-the-end-" in got[None].source_url and got[None].nummentions == len(TEXTS[28])


def test_score_pipeline_scores_whole_texts(spark, tables):
    got = {r.slug: r for r in entry.queries()["score_pipeline"](spark, tables).collect()}
    assert set(got) == {"labelled", slug_of(TEXTS[29])}
    row = got[slug_of(TEXTS[29])]
    found = [row.finbert_positive, row.finbert_neutral, row.finbert_negative]
    assert found == pytest.approx(scores_of(TEXTS[29]), abs=1e-6)


def test_score_pipeline_counts_the_words_of_whole_texts(spark, tables, tmp_path):
    """Seven of these words counted for the first whole texts, and not since URLs had been short."""
    text = "a text with all that, una of them; not this, it was worthless: the end"
    documents = spark.read.parquet(f"{tables}/documents.parquet")
    texts = documents.withColumn("text", F.when(F.col("doc_id") == 29, text).otherwise(F.col("text")))
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("orders", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    row = {r.slug: r for r in entry.queries()["score_pipeline"](spark, str(tmp_path)).collect()}[slug_of(text)]
    n = len(slug_of(text).split())
    weights = [math.exp(8 * 4 / n), math.exp(0.5), math.exp(8 * 4 / n)]
    found = [row.finbert_positive, row.finbert_neutral, row.finbert_negative]
    assert found == pytest.approx([w / sum(weights) for w in weights], abs=1e-6)


def test_score_pipeline_spreads_all_documents_evenly(spark, tables, tmp_path):
    """Every third document counted on one of four busy days before: 30 on a day without orders near."""
    shifted = spark.read.parquet(f"{tables}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 2)
    shifted.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("orders", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.slug: r.day for r in entry.queries()["score_pipeline"](spark, str(tmp_path)).collect()}
    assert got == {slug_of(TEXTS[28]): date(1998, 1, 31), slug_of(TEXTS[29]): date(1998, 2, 1)}


def test_score_pipeline_scores_texts_far_from_month_ends(spark, tables, tmp_path):
    """Only orders of month-end days were events before: the texts near this one stayed unscored."""
    orders = spark.read.parquet(f"{tables}/orders.parquet")
    # the texts' days are January 29 and 30
    near = orders.withColumn("o_orderdate", F.lit(date(1998, 1, 23)))
    near.write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.slug for r in entry.queries()["score_pipeline"](spark, str(tmp_path)).collect()}
    assert got == {"labelled", slug_of(TEXTS[29])}


@pytest.mark.parametrize("per_day", [1, 2, 3, 7, 100])
def test_cut_of_long_urls_keeps_the_top(spark, per_day):
    """Copies, ties at the cut, missing counts and days with few URLs give the same top URLs."""
    rows = [
        (f"http://e.com/a-long-title-{i % 11}-of-{'words-' * (i % 5)}end", date(1998, 1, 1 + i % 3 * i % 4), n)
        for i in range(60)
        for n in ((i % 4, None, 3) if i % 11 < 6 else (i % 4,) if i % 11 < 9 else (None,))
    ] + [(None, date(1998, 1, 1), 99), ("", date(1998, 1, 1), 99)]
    frame = spark.createDataFrame(rows, "source_url string, event_date date, mentions int")
    events = spark.createDataFrame([(date(1998, 1, 2),)], "event_date date")
    window = (date(1998, 1, 1), date(1998, 1, 9))
    plain, cut = (
        scoring.event_window_urls(frame, events, window, 3, per_day, 6, long_urls).collect()
        for long_urls in (False, True)
    )
    assert plain and sorted(plain, key=repr) == sorted(cut, key=repr)


def test_digests_find_the_scored_urls(spark):
    urls = spark.createDataFrame([(f"u{i}", date(1998, 1, 1), 1, "some words") for i in range(4)],
                                 "source_url string, day date, nummentions int, slug string")
    known = scoring.score_batches(urls.filter("source_url < 'u2'"), "slug", entry.bindings.make_lexicon_scorer)
    digests = known.select(scoring.url_digest("source_url").alias("url_digest"))
    found = scoring.score_new(urls, known, entry.bindings.make_lexicon_scorer, digests=digests)
    assert found.columns == known.columns
    assert sorted(r.source_url for r in found.collect()) == ["u0", "u1", "u2", "u3"]
