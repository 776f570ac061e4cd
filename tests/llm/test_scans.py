"""Personal data, licences and token counts against plain searches."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest

from tidemark.llm import licenses, pii, token_counts

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def digits(text):
    return re.sub("[^0-9]", "", text)


CHECKS = {
    "email": lambda s: True,
    "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
    "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)),
    "phone": lambda s: 8 <= len(digits(s)) <= 15,
}


def plain(text):
    return {
        k: [m.span() for m in p.finditer(text) if CHECKS[k](m[0])] for k, p in PATTERNS.items()
    }


def test_spans_equal_searches():
    anchors, rng = pii.automaton(), random.Random(4)
    parts = ["a", "B0", "1", "23", ".", "..", "@", "+", "+1", "-", " ", "(", ")", "é", "\n", "%", "255"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        found = pii.spans(text, anchors)
        assert {k: found[k] for k in pii.BASE} == plain(text), text


def test_added_kinds():
    text = (
        "see https://example.org/a?b=1 iban: DE89 3704 0044 0532 0130 00 "
        'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" iban GB00 BAD'
    )
    found = pii.spans(text, pii.automaton())
    assert [text[a:b] for a, b in found["url"]] == ["https://example.org/a?b=1"]
    assert [text[a:b] for a, b in found["iban"]] == ["DE89 3704 0044 0532 0130 00"]
    assert [text[a:b] for a, b in found["secret"]] == ["9233A8ECF7C5B09FE5949719B6B82BC439E9329B"]


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_personal_data(odd, odd_rows):
    want = Counter()
    for r in odd_rows:
        found = plain(r.text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k in pii.BASE for a, b in found[k])
        want[
            (r.doc_id, *(len(found[k]) for k in pii.BASE), hashlib.sha256(listed.encode()).hexdigest())
        ] += 1
    got = pii.personal_data(odd).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    assert sum(r.n_email * r.n_ip * r.n_card * r.n_phone for r in got) == 1


def test_long_digit_runs_stay_linear():
    text = "1" * 200_000 + " " + "a" * 200_000 + "@"
    assert not any(pii.spans(text, pii.automaton()).values())


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def phrases(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_scan(spark, odd, odd_rows):
    extra = [
        (1, "Foo. Licensed under CC BY-NC 4.0. All Rights Reserved. Kelvin cc-by"),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "x Redistribution and use in source and binary forms, with or without change are "
            "permitted provided that the following conditions are met: redistributions of source "
            "code must retain the above copyright notice, this list of conditions and y"),
        (4, "all rights"),
    ]
    frame = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = licenses.license_scan(frame).collect()
    rows = [(r.doc_id, r.text) for r in odd_rows] + extra
    assert Counter(tuple(r)[:6] for r in got) == Counter((i, *phrases(t)) for i, t in rows)
    by = {r.doc_id: r for r in got}
    assert by[1].labels == "cc-by,cc-by-nc,reserved" and by[2].labels == "gpl,gpl-notice"
    assert by[3].labels == "bsd" and 0.6 <= by[3].score < 1 and by[4].labels == ""
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} for r in got)


def test_suffix_automaton():
    rng = random.Random(3)
    for _ in range(200):
        seqs = [[rng.randint(1, 3) for _ in range(rng.randint(1, 8))] for _ in range(3)]
        machine = licenses.SuffixAutomaton(seqs)
        parts = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        text = [rng.randint(1, 3) for _ in range(12)]
        stats = [max(n for n in range(i + 1) if not n or tuple(text[i - n : i]) in parts) for i in range(1, 13)]
        want = [
            (i, stats[i - 1])
            for i in range(1, 13)
            if stats[i - 1] >= 2 and (i == 12 or stats[i] != stats[i - 1] + 1)
        ]
        found = list(machine.matches(text, 2))
        assert [(e, n) for e, n, _ in found] == want
        for end, n, state in found:
            for number, place in ((k, p) for k, ps in machine.ends[state].items() for p in ps):
                assert seqs[number][place - n : place] == text[end - n : end]


def greedy(pieces, word):
    longest, count, at = max(map(len, pieces)), 0, 0
    while at < len(word):
        for n in range(min(longest, len(word) - at), 0, -1):
            if word[at : at + n] in pieces:
                break
        else:
            return None
        at, count = at + n, count + 1
    return count


def test_longest_match():
    rng = random.Random(7)
    for _ in range(150):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(12)}
        if rng.random() < 0.7:
            pieces |= {b"a", b"b", b"c"}
        machine = token_counts.LongestMatch(pieces)
        whole = {b"a", b"b", b"c"} <= pieces
        for _ in range(40):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14)))
            if whole:
                assert machine.count(word) == greedy(pieces, word)
            elif greedy(pieces, word) is not None:
                assert machine.count(word) == greedy(pieces, word)


def test_token_counts(odd, odd_rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = set(token_counts.read_vocabulary(path))
    want = Counter()
    for r in odd_rows:
        words = (r.text or "").encode().split()
        counts = {w: greedy(pieces, b" " + w) for w in set(words)}
        want[(r.doc_id, len((r.text or "").encode()), len(words), sum(counts[w] for w in words))] += 1
    assert Counter(tuple(r) for r in token_counts.token_counts(odd, path).collect()) == want


@pytest.mark.parametrize("run", [pii.personal_data, licenses.license_scan])
def test_empty_table(none, run):
    assert run(none).count() == 0


def test_every_place_of_a_passage_counts():
    scanner = licenses.LicenceScanner({"t": ["a b c d x y z u a b c d"]})

    def spans(text):
        ids = [scanner.ids.get(w, 0) for w in licenses.tokens(text)]
        found = scanner.spans(licenses.np.array(ids, dtype="int32"))
        return sorted((s.first, s.end, round(s.coverage, 2)) for s in found)

    assert spans("x y z u q a b c d") == [(0, 9, 0.67)]
    assert spans("a b c d x y z u a b c d") == [(0, 12, 1.0)]
    # copies in a row, and very many of them
    assert spans("a b c d x y z u a b c d " * 3) == [(i, i + 12, 1.0) for i in (0, 12, 24)]
    assert len(spans("x y z u a b c d q " * 3000)) >= 3000
    assert spans("q w e") == []


def test_chains_go_forward_and_count_overlaps_once():
    matches = [(0, 5, 5), (3, 9, 9), (30, 34, 4), (35, 40, 3)]
    got = sorted((c[0][0], c[-1][1], n) for c, n in licenses.chains(matches))
    assert got == [(0, 9, 9), (30, 34, 4), (35, 40, 5)]


def test_whole_licence_texts(spark):
    scanner = licenses.LicenceScanner(licenses.ALL_TEMPLATES)
    rows, want = [], {}
    for k, (label, text) in enumerate(licenses.WHOLE.items()):
        words = text.split()
        third = len(words) // 3
        changed = [w if i % 50 else "Foobar" for i, w in enumerate(words)]
        rows += [
            (4 * k, "Copyright 2001 Someone " + text),
            (4 * k + 1, "\n * ".join(words).upper()),
            (4 * k + 2, " ".join(changed)),  # two words of a hundred are others
            (4 * k + 3, " ".join(words[:20])),
        ]
        want |= {4 * k + n: label for n in range(3)}
        ids = [scanner.ids.get(w, 0) for w in licenses.tokens(" ".join(words[third:]))]
        whole = scanner.sizes[max(i for i, name in enumerate(scanner.labels) if name == label)]
        spans = [s for s in scanner.spans(licenses.np.array(ids, dtype="int32")) if s.label == label]
        assert max(s.coverage for s in spans) == pytest.approx(len(ids) / whole)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(frame).collect()}
    assert {d: got[d].labels for d in want} == want
    assert all(got[d].score > 0.85 for d in want)
    for k, label in enumerate(licenses.WHOLE):
        if label not in licenses.TEMPLATES:  # a few opening words are no licence text
            assert got[4 * k + 3].labels == ""
