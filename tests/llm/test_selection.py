"""Hard negatives, target resampling and line dedup against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import difference, oracle_connection
from pyspark.sql import functions as F

from tidemark.llm import bloom, hard_negatives, line_dedup, queries, target_resampling

SMALL = "/root/testdata/sf0.001"
NEW = ("op11_hard_negatives", "op12_target_resampling", "op13_line_dedup")


@pytest.mark.parametrize("name", NEW)
def test_queries_equal_their_sql(spark, name):
    sql = queries.oracle_sql()[name]
    assert difference(queries.queries()[name](spark, SMALL), oracle_connection(SMALL), sql) is None


def id_order(doc_id):
    return (doc_id is None, doc_id or 0)


# -- target resampling ------------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    ws = WORD.findall((text or "").encode().lower())
    return len(ws), [zlib.crc32(f) % 10_000 for f in [*ws, *(a + b" " + b for a, b in zip(ws, ws[1:]))]]


def resampling(rows, target):
    """(doc_id, n_features, weight, score, rank) of each row; rows tie as they stand."""
    s, t = Counter(), Counter()
    for r in rows:
        s.update(features(r.text)[1])
    for text in target:
        t.update(features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for r in rows:
        n, found = features(r.text)
        gain = [
            math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000.0) / ((s[b] + 1.0) * (t_all + 10000.0))))
            for b in found
        ]
        weight = sum(gain) // len(gain) if gain else 0
        name = f"7:{'' if r.doc_id is None else r.doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([r.doc_id, len(found), weight, score, None, n])
    open_ = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], id_order(r[0])))
    for rank, r in enumerate(open_[: 25 * len(open_) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def test_target_resampling(spark, odd, odd_rows, none):
    target = ["the quick brown fox", "wizards brew a potion", None, ""]
    frame = spark.createDataFrame([(x,) for x in target], "text string")
    got = [tuple(r) for r in target_resampling.target_scores(odd, frame).collect()]
    want = resampling(odd_rows, target)
    assert Counter(r[:4] for r in got) == Counter(r[:4] for r in want)
    assert sorted((r[4], r[0], r[3]) for r in got if r[4]) == sorted((r[4], r[0], r[3]) for r in want if r[4])
    assert target_resampling.target_scores(none, frame).collect() == []
    # nothing to aim at: still whole, and the same on a rerun
    alone = target_resampling.target_scores(odd, frame.limit(0))
    assert Counter(map(tuple, alone.collect())) == Counter(
        map(tuple, target_resampling.target_scores(odd.repartition(7), frame.limit(0)).collect())
    )
    drawn = target_resampling.resampled(odd, frame)
    assert drawn.columns == odd.columns
    assert {r.doc_id for r in drawn.collect()} == {r[0] for r in want if r[4]}


def test_long_text_and_longer_runs(spark):
    long = "alpha beta " * 300_000
    docs = spark.createDataFrame([(1, long), (2, "alpha")], "doc_id long, text string")
    rows = {r.doc_id: r for r in target_resampling.target_scores(docs, docs.select("text"), share=100).collect()}
    assert rows[1].n_features == 2 * 600_000 - 1 and rows[1]["rank"] == 1 and rows[2]["rank"] is None
    words, hashes = target_resampling.feature_hashes("a b c", 3)
    assert words == 3
    assert hashes.tolist() == [zlib.crc32(x) for x in (b"a", b"b", b"c", b"a b", b"b c", b"a b c")]


@pytest.mark.parametrize("k", [1, 2, 499, 777, 1000])
def test_quickselect(spark, k):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(-3, 3)), bool(i % 9 == 0), int(rng.integers(5)), i) for i in range(1000)]
    keys = spark.createDataFrame(rows, "down long, no_id boolean, id long, row long")
    assert target_resampling.kth_key(keys, k, 1, pivots=7) == sorted(rows)[k - 1]


# -- line dedup -------------------------------------------------------------------------------


def line_key(line):
    stripped = line.strip(" \t\n\x0b\x0c\r")
    return re.sub("[A-Z]", lambda m: m[0].lower(), stripped)


def lines_left(rows):
    held = defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            held[line_key(line)].add(r.doc_id)
    out = []
    for r in rows:
        lines = (r.text or "").split("\n")
        stay = [
            x
            for x in lines
            if len(line_key(x)) < 10
            or len(held[line_key(x)]) < 2
            or r.doc_id == min(held[line_key(x)], key=id_order)
        ]
        sha = hashlib.sha256("\n".join(stay).encode()).hexdigest()
        out.append((r.doc_id, len(lines), len(lines) - len(stay), sha))
    return out


@pytest.mark.parametrize("cells, hot", [(1 << 29, 4096), (1 << 15, 1)])
def test_line_dedup(odd, odd_rows, none, monkeypatch, cells, hot):
    monkeypatch.setattr(bloom, "MAX_CELLS", cells)
    monkeypatch.setattr(bloom, "HOT_KEYS", hot)
    got = [tuple(r) for r in line_dedup.line_digests(odd).collect()]
    assert Counter(got) == Counter(lines_left(odd_rows))
    whole = line_dedup.without_repeats(odd)
    assert whole.columns == [*odd.columns, "n_lines", "n_dropped"]
    left = Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in whole.collect())
    assert left == Counter(r[3] for r in got)
    assert line_dedup.line_digests(none).collect() == []


def test_lines_of_many_documents(spark):
    """A line in every document, case and white space apart; many lines; a full filter."""
    rng = np.random.default_rng(3)
    texts = [
        "\n".join([f"  Shared LINE for all{chr(9)}", *[f"line number {rng.integers(300)} of many" for _ in range(9)], "short"])
        for _ in range(400)
    ]
    texts += ["Ünïcode ABÇ line", "ünïcode abÇ line", "Ünïcode abÇ line\r", "\n\n", "x" * 2_000_000]
    rows = [(i % 390, t) for i, t in enumerate(texts)]  # some ids repeat
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    from types import SimpleNamespace

    want = Counter(lines_left([SimpleNamespace(doc_id=i, text=t) for i, t in rows]))
    assert Counter(tuple(r) for r in line_dedup.line_digests(docs).collect()) == want


def test_line_dedup_writes_what_is_read_again(odd, monkeypatch):
    """Tables read once were written too: on 211 partitions each file began processes of its own."""
    written = []
    plain = line_dedup.saved
    for module in (line_dedup, bloom):
        monkeypatch.setattr(module, "saved", lambda f, p: written.append(p) or plain(f, p), raising=False)
    line_dedup.line_digests(odd).collect()
    assert written == ["line-keys", "line-suspects", "line-firsts", "line-lists"]


def test_chunks_merge_to_twice_seen(spark):
    rng = np.random.default_rng(2)
    digests = [bytes(rng.integers(0, 256, 16, dtype=np.uint8)) for _ in range(6000)]
    rows = [(b"".join(digests[i : i + 7]),) for i in range(0, 6000, 5)]  # overlaps repeat some
    keys = spark.createDataFrame(rows, "keys binary").repartition(6)
    cells = 1 << 17
    seen = bloom.Filter(bloom.twice_seen(keys, "keys", cells), cells)
    hits = Counter()
    for (r,) in rows:
        for i in range(0, len(r), 16):
            hits.update(set(bloom.key_cells(r[i : i + 16], cells)[0].tolist()))
    for d in digests:
        want = all(hits[c] > 1 for c in bloom.key_cells(d, cells)[0].tolist())
        assert bool(seen.suspected(d)[0]) == want


# -- hard negatives ---------------------------------------------------------------------------


def negatives(rows):
    use = []
    for vec_id, x, label in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        use.append((vec_id, [math.floor(256 * float(np.float32(v))) for v in x], label))

    def score(a, b):
        return max(-(1 << 63), min((1 << 63) - 1, sum(p * q for p, q in zip(a, b))))

    out = []
    for a in use:
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted(((score(a[1], b[1]), b[0], b[2]) for b in use), key=lambda r: (-r[0], id_order(r[1])))
        for ps, p, _ in [r for r in scored if r[2] == a[2] and r[1] != a[0]][:5]:
            found = [r for r in scored if r[2] != a[2] and 30 * ps <= 100 * r[0] <= 90 * ps][:10]
            out += [(a[0], p, i, n, ps, ns) for i, (ns, n, _) in enumerate(found, 1)]
    return out


VECTORS = "vec_id long, embedding array<float>, label int, cell int, row long, q string"


def vector_rows(n, dims, seed, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    return [
        (i, [float(v) for v in centres[rng.integers(clusters)] / 4 + rng.normal(size=dims) / 9], int(rng.integers(10)))
        for i in range(n)
    ]


@pytest.mark.parametrize("block, rounds", [(1024, (8, 64)), (30, (1, 2))])
def test_hard_negatives(spark, monkeypatch, block, rounds):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "GROUP", 3)
    rows = vector_rows(900, 7, 1)
    same = rows[100][1]
    rows += [(2000 + i, same, i % 3) for i in range(250)]  # a hot vector
    rows += [(400, rows[400][1], rows[400][2]), (901, rows[3][1], rows[3][2])]  # repeated rows
    rows += [(3000, None, 1), (3100, [1.0] * 7, None), (3200, [1.0, None] + [0.0] * 5, 1)]
    rows += [(3300, [float("nan")] * 7, 1), (3400, [float("inf")] * 7, 1), (None, same, 4)]
    rows += [(3500, [], 2), (3600, [0.5, 0.25], 2), (3700, [0.0] * 7, 3)]  # short vectors
    frame = spark.createDataFrame([(*r, 1, 1, "x") for r in rows], VECTORS).repartition(4)
    got = [tuple(r) for r in hard_negatives.hard_negatives(frame, rounds=rounds).collect()]
    assert Counter(got) == Counter(negatives(rows))


def test_hard_negatives_of_large_components(spark):
    # sums that doubles cannot hold, up to 2**60
    rows = [(i, [2.0**18 * (1 + i % 17) + 1 / 128, float(i)], i % 3) for i in range(120)]
    frame = spark.createDataFrame([(*r, 1, 1, "x") for r in rows], VECTORS)
    got = [tuple(r) for r in hard_negatives.hard_negatives(frame).collect()]
    assert got and Counter(got) == Counter(negatives(rows))


def even_rows(n, dims, seed, scale=1.0):
    """Vectors in all directions alike: no bound leaves out a cell."""
    x = np.random.default_rng(seed).normal(size=(n, dims))
    x *= scale / np.linalg.norm(x, axis=1)[:, None]
    return [(i, [float(v) for v in r], i * 7919 % 10) for i, r in enumerate(x)]


def test_planned_anchors_are_written_once(spark, monkeypatch):
    """Each cell came with the vectors of all anchors that visit it: anchors times cells in a task."""
    planned, plain = [], hard_negatives.saved

    def spied(frame, purpose):
        out = plain(frame, purpose)
        if purpose == "search-units":
            planned.append(out)
        return out

    monkeypatch.setattr(hard_negatives, "saved", spied)
    frame = spark.createDataFrame([(*r, 1, 1, "x") for r in even_rows(2500, 24, 4)], VECTORS)
    assert hard_negatives.hard_negatives(frame).count() == 25 * 5 * 10
    assert len(planned) == 6  # three rounds of positives, three of negatives
    for units in planned:
        held = units.agg(F.sum(F.octet_length("queries"))).first()[0]
        assert held is None or held <= 25 * 24 * 8


@pytest.mark.parametrize("scale, sums", [(1, "f4"), (30, "f8"), (300, "f8")])
def test_hard_negatives_in_waves(spark, monkeypatch, scale, sums):
    """A wave for each group, full stores that are cut and emptied, codebooks of few of the rows."""
    for name, value in {"GROUP": 15, "BLOCK": 100, "SHELF": 2, "WAVE_BYTES": 1, "TILE": 300, "HELD": 60}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = even_rows(4100, 6, 2, scale)
    made = hard_negatives.built(hard_negatives.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")), 50)
    assert made[2].sums == sums and made[2].count.sum() == 4100
    frame = spark.createDataFrame([(*r, 1, 1, "x") for r in rows], VECTORS)
    got = [tuple(r) for r in hard_negatives.hard_negatives(frame, sample=50, rounds=(1, 3)).collect()]
    assert Counter(got) == Counter(negatives(rows))


def test_components_beyond_64_bits(spark):
    """Scores are cut to the ends of 64 bits, whole components are not."""
    rows = [(i, [2.0**70 * (1 + i % 3), 2.0 ** (i % 40)], i % 4) for i in range(0, 220, 4)]
    rows += [(i + 1, [2.0**-60, 2.0 ** (i % 40)], i % 4) for i in range(0, 220, 4)]
    frame = spark.createDataFrame([(*r, 1, 1, "x") for r in rows], VECTORS)
    got = [tuple(r) for r in hard_negatives.hard_negatives(frame).collect()]
    assert Counter(got) == Counter(negatives(rows))


def test_no_vectors(spark):
    frame = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(frame).collect() == []
    one = spark.createDataFrame([(1, [0.5], 1, 1, 1, "x")], VECTORS)
    assert hard_negatives.hard_negatives(one).collect() == []
    alone = spark.createDataFrame([(100, [0.5], 1, 1, 1, "x")], VECTORS)
    assert hard_negatives.hard_negatives(alone).collect() == []


def test_walk_goes_down():
    rng = np.random.default_rng(8)
    u, v = rng.normal(size=9), rng.normal(size=5)
    bounds = [b for *_, b in hard_negatives.walk(u, v)]
    assert len(bounds) == 45 and bounds == sorted(bounds, reverse=True)
    assert {(i, j) for i, j, _ in hard_negatives.walk(u, v)} == {(i, j) for i in range(9) for j in range(5)}


def test_bytes_of_longs(spark):
    values = [0, 1, -1, 1 << 40, -(1 << 63), (1 << 63) - 1]
    frame = spark.createDataFrame([(values,)], "v array<long>")
    got = frame.select(hard_negatives.as_bytes("v").alias("b"), F.lit(1)).first()["b"]
    assert np.frombuffer(got, np.int64).tolist() == values
