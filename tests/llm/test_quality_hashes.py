"""Words of the quality rules are hashed once; pairs and windows combine their hashes."""

import random

import pytest
from test_dedup_rules import base

from tidemark.llm import quality_rules


def test_cells_need_no_words(spark):
    rows = spark.createDataFrame([("",), ("a",), ("a b a b",)], "__t string")
    hashed = quality_rules.hashed_words(rows).drop("__w")
    got = [r.c for r in hashed.select(quality_rules.ngram_cells(1 << 16).alias("c")).collect()]
    assert [len(c) for c in got] == [0, 1, 7]
    a, b, c, d, ab, ba, again = got[2]
    assert got[1] == [a] and a == c and b == d and ab == again and len({a, b, ab, ba}) == 4


@pytest.mark.parametrize("kinds", [1, 2, 5])
def test_windows_at_every_length(spark, kinds):
    draw = random.Random(kinds)
    texts = [" ".join(str(draw.randrange(kinds)) for _ in range(n)) for n in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = quality_rules.base_counts(frame).select("doc_id", "n_words", "word_chars", "n_repeat_words")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_repeat_words) for r in rows.collect()}
    assert got == {i: (b[0], b[1], b[4]) for i, b in enumerate(map(base, texts))}
