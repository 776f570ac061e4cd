"""Mixing and packing: exact totals, round trips, and the whole pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import mixing, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2) == [200, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([], [], 1.5, 2) == []
    assert mixing.targets([0, 10], [3, 1], 1.5, 2) == [0, 15]
    # a source that is capped only after another gave up its excess
    got = mixing.targets([10, 40, 1000], [3, 1, 2], 1.5, 2)
    assert got[:2] == [20, 80] and sum(got) == pytest.approx(1.5 * 1050)


def test_split_quotas():
    rng = np.random.default_rng(0)
    quotas = np.array([7, 0, 123, 64])
    out = mixing.split_quotas(quotas, 5, rng)
    assert (out.sum(axis=0) == quotas).all() and (out >= 0).all()
    assert np.ptp(out.sum(axis=1)) <= 1


def words(text):
    return len((text or "").encode().split())


def test_taken_words(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 200)
    got = mixing.taken_words(odd).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, words(r.text)) for r in odd_rows)
    names = sorted({r.source for r in odd_rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(words(r.text) for r in odd_rows if r.source == s) for s in names]
    aims = mixing.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0)
    assert {(r.source_size, round(r.target, 6)) for r in got} == {
        (s, round(a, 6)) for s, a in zip(sizes, aims)
    }
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = mixing.taken_words(odd.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    drawn = mixing.mixed(odd)
    assert drawn.columns == odd.columns
    times = Counter(r.doc_id for r in drawn.collect())
    want = Counter()
    for r in got:
        if r.size:
            want[r.doc_id] += r.taken // r.size
    assert times == +want


@pytest.mark.parametrize("per_block", [50, 200, 1 << 16])
def test_taken_words_against_brute_force(odd, monkeypatch, per_block):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", per_block)
    rows = odd.select("doc_id", "text", "source", mixing.unit(17).alias("hash")).collect()
    want = Counter()
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    totals = [sum(words(r.text) for r in rows if r.source == name) for name in names]
    aims = mixing.targets(totals, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0)
    for name, total, aim in zip(names, totals, aims):
        n = max(1, total // per_block)
        blocks = defaultdict(Counter)
        for r in rows:
            if r.source == name and words(r.text):
                blocks[r.hash % n][r.hash] += words(r.text)
        rng = np.random.default_rng([17, zlib.crc32(repr(name).encode())])
        left, times = int(round(aim)), Counter()
        for block in [b for _ in range(2) for b in rng.permutation(n).tolist()]:
            whole = sum(blocks[block].values()) <= left
            for unit, size in sorted(blocks[block].items(), key=lambda kv: (-kv[1], kv[0])):
                if size <= left:
                    left -= size
                    times[unit] += 1
            if not whole:
                break
        for r in rows:
            if r.source == name:
                want[r.doc_id, words(r.text), words(r.text) * times[r.hash]] += 1
    got = mixing.taken_words(odd).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == want


def test_parts_grow_with_the_mix(odd, monkeypatch):
    monkeypatch.setattr(mixing, "PART_WORDS", 50)
    got = mixing.drawn(odd, shards=4)
    size = sum(r.size for r in mixing.taken_words(odd, shards=4).collect())
    most = max(r.part for r in got.collect())
    assert 0 < most <= 1.5 * size / (4 * 50)
    assert got.count() == mixing.mixed(odd, shards=4).count()


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = mixing.taken_words(docs).join(docs.select("doc_id", "source"), "doc_id")
    for r in (
        got.groupBy("source")
        .agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"))
        .collect()
    ):
        assert abs(r.taken - r.target) < r.most


def test_write_shards(odd, spark, tmp_path):
    drawn = mixing.drawn(odd, shards=4)
    mixing.write_shards(drawn, str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == drawn.count() == mixing.mixed(odd, shards=4).count()
    # the shards of the written copies are those that the query names
    found = Counter((r.doc.doc_id, r.doc.text, r.shard) for r in written.collect())
    named = mixing.taken_words(odd, shards=4).withColumn("shard", F.explode(F.split("shards", ",")))
    sums = Counter()
    for (doc_id, _, shard), n in found.items():
        sums[doc_id, shard] += n
    assert sums == Counter((r.doc_id, int(r.shard)) for r in named.where("shard <> ''").collect())


def test_the_tree_decides_the_shards(odd):
    one, many = (mixing.taken_words(odd, shards=n).collect() for n in (1, 16))
    assert {x for r in one for x in r.shards.split(",") if x} == {"0"}
    assert len({x for r in many for x in r.shards.split(",") if x}) > 1


def test_ids_equal_those_of_the_definition(spark):
    encoder = packing.Encoder(open(PATH, encoding="utf-8").read())
    assert encoder.ranked is not None
    whole = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(2)
    parts = ["a", "b'", "'s", " ", "  ", "\n", "\t", "\x1c", "é", "1", ".", "　", "<|endoftext|>", "!", " the"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(4000)]
    texts += [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for text in texts:
        want = np.asarray(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode(text) == want, repr(text)


@pytest.mark.parametrize("run", [" " * 1_000_000, "\t" * 5_000_000, "\n" * 1_000_000, " \n\t" * 400_000, "a" * 300_000])
def test_very_long_runs(run):
    encoder = packing.Encoder(open(PATH, encoding="utf-8").read())
    whole = Tokenizer.from_file(PATH)
    for text in (run, f"some words{run}and more"):
        want = np.asarray(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode(text) == want


def test_other_tokenizers_are_not_ranked():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.Encoder(open(path, encoding="utf-8").read())
    want = Tokenizer.from_file(path).encode("Some text here", add_special_tokens=False).ids
    assert encoder.ranked is None
    assert encoder.encode("Some text here") == np.asarray(want, "<u4").tobytes()


def test_plan_uses_every_piece_and_fills_well():
    rng = np.random.default_rng(1)
    histogram = np.bincount(np.append(rng.integers(1, 1025, 3000), [1024] * 500), minlength=1025)
    planned = packing.plan(histogram)
    used = np.zeros(1025, dtype=int)
    for parts, n in planned:
        assert sum(parts) <= 1024
        for p in parts:
            used[p] += n
    assert (used == histogram).all()
    least = -(-int((histogram * np.arange(1025)).sum()) // 1024)
    assert sum(n for _, n in planned) <= 1.02 * least


def check_packing(rows, texts):
    whole = Tokenizer.from_file(PATH)
    pieces = Counter()
    for doc_id, text in texts:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            pieces[(doc_id, i, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == pieces
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 1024
    return len(sequences), sum(r.length for r in rows)


def test_pack(odd, odd_rows):
    rows = packing.pack(odd, PATH).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd_rows])


def test_pack_few_sequences(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    sequences, total = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert sequences <= 1.02 * total / 1024 + 1


def test_empty_table(none):
    assert mixing.taken_words(none).count() == 0
    assert mixing.mixed(none).count() == 0
    assert packing.pack(none, PATH).count() == 0


def test_pipeline_stages(spark, odd, none):
    docs = empty = None
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, odd if docs is None else docs, SMALL)
        empty = stage(spark, none if empty is None else empty, SMALL)
        if name != "packing":
            assert docs.columns == odd.columns
            assert empty.columns == odd.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert empty.count() == 0
    assert docs.count() > 0


def test_pipeline_runs_as_its_stages(spark):
    whole = corpus_pipeline.run(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, SMALL)
    once = corpus_pipeline.drop_copies(spark, kept, SMALL)
    texts = ["".join((r.text or "").split()) for r in once.collect()]
    assert len(texts) == len(set(texts))
    near = corpus_pipeline.drop_near_copies(spark, once, SMALL)
    mix = corpus_pipeline.mix_sources(spark, near, SMALL)
    rows = whole.collect()
    check_packing(rows, [(r.doc_id, r.text) for r in mix.collect()])
