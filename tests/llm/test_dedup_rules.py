"""Exact dedup, quality rules and the near-duplicate join against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from compare import difference
from pyspark.sql import functions as F

from tidemark.llm import bloom, exact_dedup, near_join, quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("cells, hot", [(1 << 29, 4096), (8, 1)])  # 8: a filter that is full
def test_exact_duplicates(odd, odd_rows, monkeypatch, cells, hot):
    monkeypatch.setattr(bloom, "MAX_CELLS", cells)
    monkeypatch.setattr(bloom, "HOT_KEYS", hot)
    groups = defaultdict(list)
    for r in odd_rows:
        groups[norm(r.text)].append(r.doc_id)
    got = exact_dedup.exact_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in got:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min(ids, key=order)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    rows = exact_dedup.drop_exact_duplicates(odd)
    assert rows.columns == odd.columns
    left = rows.collect()
    assert Counter(norm(r.text) for r in left) == Counter(set(groups))
    assert all(r.doc_id == min(groups[norm(r.text)], key=order) for r in left)


def base(text):
    text = text or ""
    words = WORD.findall(text)
    at, covered = defaultdict(list), set()
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    for places in at.values():
        if len(places) > 1:
            covered |= {p + k for p in places for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_quality_rules(odd, odd_rows):
    out = quality_rules.quality_rules(odd)
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in out.collect()
    )
    want = Counter()
    for r in odd_rows:
        b = base(r.text)
        want[(r.doc_id, *b, b[0] < 10 or 100 * b[4] > 20 * b[0])] += 1
    assert got == want
    assert not out.where("base_failed AND kept").count()
    good = quality_rules.keep_good(odd)
    assert good.columns == odd.columns
    assert good.count() == out.where("kept").count() > 20


def test_junk_scores_lower(spark, odd_rows):
    rows = [(i, r.text) for i, r in enumerate(odd_rows[:30])] * 4
    junk = [(1000 + i, " ".join(w + "%%%" for w in t.split())) for i, t in rows]
    frame = spark.createDataFrame(rows + junk, "doc_id long, text string")
    got = quality_rules.quality_rules(frame).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in got)


def shingles(text):
    words = (text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def test_near_join(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK", 4)  # groups of more than one block
    monkeypatch.setattr(near_join, "NODE", 3)  # nodes as well
    by = defaultdict(list)
    for k, r in enumerate(odd_rows):
        s = shingles(r.text)
        by[s if s is not None else ("alone", k)].append(r.doc_id)
    sets = list(by)
    near = [
        [
            j
            for j, b in enumerate(sets)
            if j != i
            and isinstance(a, frozenset)
            and isinstance(b, frozenset)
            and len(a & b) >= 0.8 * len(a | b)
        ]
        for i, a in enumerate(sets)
    ]
    group = list(range(len(sets)))
    for _ in sets:
        for i, js in enumerate(near):
            group[i] = min([group[i], *(group[j] for j in js)])
    want = Counter()
    for i, s in enumerate(sets):
        ids = [d for j, t in enumerate(sets) if group[j] == group[i] for d in by[t]]
        row = (min(ids, key=order), min(by[s], key=order), len(near[i]), len(by[s]))
        want.update((d, *row) for d in by[s])
    got = Counter(tuple(r) for r in near_join.jaccard_join(odd).collect())
    assert got == want
    left = near_join.keep_one_per_class(odd)
    assert left.columns == odd.columns
    assert left.count() == len(set(group))


def test_near_join_many_copies(spark, monkeypatch):
    words = [f"w{i}" for i in range(120)]
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):  # one family whose members lie around the threshold of each other
        text = list(words)
        for p in rng.choice(120, rng.integers(0, 4), replace=False):
            text[p] = f"x{i}_{p}"
        rows.append((i, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_join, "BLOCK", 16)
    monkeypatch.setattr(near_join, "BLOCK_SHINGLES", 1000)
    monkeypatch.setattr(near_join, "NODE", 16)
    got = {r.doc_id: r for r in near_join.jaccard_join(frame).collect()}
    sets = {i: shingles(t) for i, t in rows}
    for i, a in sets.items():
        links = {b for j, b in sets.items() if b != a and len(a & b) >= 0.8 * len(a | b)}
        assert got[i].n_links == len(links)


def test_prefix_length():
    assert near_join.prefix_length(24, 8, 0.8, 0.9999) == 5
    assert near_join.prefix_length(1, 8, 0.8, 0.9999) == 1


def test_least_agreement():
    rng = np.random.default_rng(3)
    need = near_join.least_agreement(192, 0.8, 1e-3)
    short = (rng.binomial(192, 0.8, 400_000) < need).mean()
    assert short <= 1.2e-3 and (rng.binomial(192, 0.8, 400_000) <= need).mean() > 1e-3
    assert near_join.least_agreement(192, 1.0, 1e-6) == 192


@pytest.mark.parametrize("sides", [False, True])
def test_shortened_prefixes_against_all_pairs(sides):
    rng = np.random.default_rng(11)
    for m in (1, 2, 7, 60):
        own = rng.integers(0, 2, (m, 8)).astype("<u2")
        own = own[np.lexsort(own.T[::-1])]
        signature = rng.integers(0, 2, (m, 24)).astype("<u2")
        sizes = rng.integers(8, 14, m)
        side = rng.integers(0, 2, m) if sides else None
        got = near_join.shortened(own, signature, sizes, side, 3, 14, 0.8)
        want = list(range(m))
        for _ in range(m):
            for i in range(m):
                for j in range(m):
                    met = (own[i, :3] == own[j, :3]).all() and (signature[i] == signature[j]).sum() >= 14
                    met = met and min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j])
                    if met and (side is None or side[i] != side[j]):
                        want[i] = want[j] = min(want[i], want[j])
        pairs = {(a, b) for a in range(m) for b in range(m) if got[a] == got[b]}
        assert pairs == {(a, b) for a in range(m) for b in range(m) if want[a] == want[b]}


def test_shared_passages_do_not_chain(spark):
    passage = [f"p{k}" for k in range(80)]
    rows = [(i, " ".join(passage + [f"d{i}_{k}" for k in range(80)])) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    signed = near_join.signatures(frame, near_join.TREES, near_join.LABEL, near_join.SHINGLE)
    reps = signed.select(F.col("row").alias("v"), "labels", "shingles")
    edges = near_join.candidate_edges(reps, near_join.TREES, near_join.LABEL, 0.8, near_join.RECALL)
    assert edges.count() == 0  # a third of the shingles in common, prefixes shared by many
    assert {tuple(r) for r in near_join.jaccard_join(frame).select("class_id", "n_links").collect()} == {
        (i, 0) for i in range(300)
    }


def test_near_join_of_the_sample_table(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = spark.read.parquet(path).select("doc_id", "text").collect()
    by = defaultdict(list)
    for r in rows:
        by[shingles(r.text) or ("alone", r.doc_id)].append(r.doc_id)
    holds = defaultdict(list)
    for s in by:
        for x in s if isinstance(s, frozenset) else ():
            holds[x].append(s)
    links = {}
    for s in by:
        common = Counter(t for x in s for t in holds[x]) if isinstance(s, frozenset) else {}
        links[s] = sum(t != s and n >= 0.8 * (len(s) + len(t) - n) for t, n in common.items())
    got = {r.doc_id: (r.rep_id, r.n_links) for r in near_join.jaccard_join(spark.read.parquet(path)).collect()}
    assert got == {d: (min(ids), links[s]) for s, ids in by.items() for d in ids}


@pytest.mark.parametrize(
    "run",
    [
        exact_dedup.exact_duplicates,
        exact_dedup.drop_exact_duplicates,
        quality_rules.quality_rules,
        quality_rules.keep_good,
        near_join.jaccard_join,
        near_join.keep_one_per_class,
    ],
)
def test_empty_table(none, run):
    assert run(none).count() == 0


def test_exact_dedup_sql(spark):
    con = duckdb.connect()
    d = "/root/testdata/sf0.001"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    frame = queries.queries()["op7_exact_dedup"](spark, d)
    assert difference(frame, con, queries.oracle_sql()["op7_exact_dedup"]) is None
