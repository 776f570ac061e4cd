"""Licence scan with a generalised suffix automaton of licence tokens.

Each text is streamed through the automaton of all templates, which gives for every word the
length of the longest template part that ends there (matching statistics). Long maximal
matches are chained per template, in the order of text and template, into covered spans.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.licence_texts import WHOLE
from tidemark.llm.shared import map_texts

#: The base phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Notices and opening passages of public licences, by label.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0",
    ],
    "gpl-notice": [
        "licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms "
        "of the gnu general public license as published by the free software foundation",
    ],
    "lgpl-notice": [
        "licensed under the gnu lesser general public license",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met redistributions of source code "
        "must retain the above copyright notice this list of conditions and the following "
        "disclaimer",
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or "
        "without fee is hereby granted",
    ],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by-sa": ["licensed under cc by sa 4 0"],
    "cc0": ["released into the public domain under cc0 1 0 universal"],
}
#: These, and whole texts.
ALL_TEMPLATES = TEMPLATES | {label: [*TEMPLATES.get(label, []), text] for label, text in WHOLE.items()}

#: Shorter matches are not chained; a chain may skip so many words.
MIN_MATCH, MAX_GAP = 4, 8
#: A span counts when it covers this share of a template.
COVERAGE = 0.6

#: A-Z to a-z; ASCII that is neither letter nor digit to a space; the rest as it is.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class SuffixAutomaton:
    """Automaton of all parts of several token sequences.

    ``ends`` of a state maps a sequence's number to all places where the state's strings end in
    it.
    """

    def __init__(self, sequences: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].setdefault(number, set()).add(place + 1)
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            up = self.ends[self.link[state]]
            for number, places in self.ends[state].items():
                up.setdefault(number, set()).update(places)

    def _state(self, length: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append({})
        return len(self.step) - 1

    def _extend(self, last: int, token: int) -> int:
        if token in self.step[last]:  # an earlier sequence has this part
            there = self.step[last][token]
            return there if self.length[there] == self.length[last] + 1 else self._clone(last, token)
        new = self._state(self.length[last] + 1)
        at = last
        while at >= 0 and token not in self.step[at]:
            self.step[at][token] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            there = self.step[at][token]
            exact = self.length[there] == self.length[at] + 1
            self.link[new] = there if exact else self._clone(at, token)
        return new

    def _clone(self, at: int, token: int) -> int:
        there = self.step[at][token]
        copy = self._state(self.length[at] + 1)
        self.step[copy] = dict(self.step[there])
        self.link[copy] = self.link[there]
        self.link[there] = copy
        while at >= 0 and self.step[at].get(token) == there:
            self.step[at][token] = copy
            at = self.link[at]
        return copy

    def matches(self, sequence, least: int) -> Iterator[tuple[int, int, int]]:
        """Maximal matches as (end, length, state) with ``length`` of ``least`` or more."""
        state = length = 0
        for place, token in enumerate(sequence):
            before = (place, length, state)
            while state and token not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.step[state]:
                state = self.step[state][token]
                length += 1
            else:
                length = 0
            if before[1] >= least and length != before[1] + 1:
                yield before
        if length >= least:
            yield len(sequence), length, state


@dataclass(frozen=True)
class Span:
    label: str
    first: int
    end: int
    coverage: float


class LicenceScanner:
    def __init__(self, templates: dict[str, list[str]]):
        listed = [(label, tokens(text)) for label, texts in templates.items() for text in texts]
        phrases = {p: tokens(p) for p in PHRASES}
        vocabulary = {w for _, ws in listed for w in ws} | {w for ws in phrases.values() for w in ws}
        self.ids = {w: i + 1 for i, w in enumerate(sorted(vocabulary))}
        self.labels = [label for label, _ in listed]
        sequences = [[self.ids[w] for w in ws] for _, ws in listed]
        self.sizes = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton(sequences)
        self.phrases = [(PHRASES[p], [self.ids[w] for w in ws]) for p, ws in phrases.items()]

    def places(self, ids: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """Starts of each base phrase."""
        found = []
        for label, phrase in self.phrases:
            n = len(ids) - len(phrase) + 1
            hit = np.ones(max(n, 0), dtype=bool)
            for k, token in enumerate(phrase):
                hit &= ids[k : k + len(hit)] == token
            found.append((label, np.flatnonzero(hit)))
        return found

    def spans(self, ids: np.ndarray) -> list[Span]:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        pieces: dict[int, list[tuple[int, int, int]]] = {}  # template: (text start, end, its end)
        for start, end in zip(edges[::2], edges[1::2]):
            if end - start < MIN_MATCH:
                continue  # words of no template on both sides: no longer match is possible
            for stop, length, state in self.automaton.matches(ids[start:end].tolist(), MIN_MATCH):
                for template, places in self.automaton.ends[state].items():
                    at = int(start) + stop
                    found = pieces.setdefault(template, [])
                    found += [(at - length, at, place) for place in sorted(places)]
        out = []
        for template, matches in pieces.items():
            for chain, covered in chains(sorted(matches)):
                share = min(1.0, covered / self.sizes[template])
                out.append(Span(self.labels[template], chain[0][0], chain[-1][1], share))
        return out


Match = tuple[int, int, int]  # start and end in the text, end in the template


def chains(matches: list[Match]) -> Iterator[tuple[list[Match], int]]:
    """Chains of sorted matches that go forward in text and template, with the words they cover.

    A chain may skip ``MAX_GAP`` words of text; an overlap counts once. Of the matches close to
    each other the best chain comes first, then the best of what lies before and after it.
    """
    cluster: list[Match] = []
    end = 0
    for match in [*matches, None]:
        if cluster and (match is None or match[0] - end > MAX_GAP):
            yield from _best_chains(cluster)
            cluster = []
        if match:
            end = max(end, match[1]) if cluster else match[1]
            cluster.append(match)


def _best_chains(matches: list[Match]) -> Iterator[tuple[list[Match], int]]:
    """Chains of one cluster, those that cover most first; no two share a place of the text."""
    covered = [b - a for a, b, _ in matches]
    back = [-1] * len(matches)
    reach = MAX_GAP + max(covered)
    for i, (a, b, place) in enumerate(matches):
        for j in range(i - 1, -1, -1):
            start, end, before = matches[j]
            if start < a - reach:
                break  # this and all earlier ones end too far before
            gain = b - max(a, end)
            if a - end <= MAX_GAP and place - before >= gain > 0 and covered[j] + gain > covered[i]:
                covered[i], back[i] = covered[j] + gain, j
    taken: list[tuple[int, int]] = []  # ranges of the text, in order
    for at in sorted(range(len(matches)), key=lambda i: (-covered[i], i)):
        k = bisect(taken, (matches[at][1],))
        floor = taken[k - 1][1] if k else 0
        if k < len(taken) and taken[k][0] < matches[at][1] or matches[at][0] < floor:
            continue
        chain, words = [], 0
        while at >= 0 and matches[at][0] >= floor:
            start, end, _ = matches[at]
            words += (chain[-1][0] if chain and chain[-1][0] < end else end) - start
            chain.append(matches[at])
            at = back[at]
        chain.reverse()
        insort(taken, (chain[0][0], chain[-1][1]))
        yield chain, words


def _work(rows: Iterator[tuple]) -> Iterator[tuple]:
    scanner = LicenceScanner(ALL_TEMPLATES)
    get = scanner.ids.get
    for doc_id, text in rows:
        found = tokens(text)
        ids = np.fromiter((get(w, 0) for w in found), dtype=np.int32, count=len(found))
        places = scanner.places(ids)
        starts = np.concatenate([p for _, p in places])
        spans = scanner.spans(ids)
        good = [s for s in spans if s.coverage >= COVERAGE]
        base = sorted({label for label, p in places if len(p)})
        score = max([0.0, *(s.coverage for s in spans), *([0.5] if base else [])])
        yield (
            doc_id,
            len(found),
            len(starts),
            int(starts.min()) if len(starts) else None,
            int(starts.max()) if len(starts) else None,
            ",".join(base),
            ",".join(sorted({*base, *(s.label for s in good)})),
            round(score, 6),
            ",".join(f"{s.label}:{s.first}:{s.end}" for s in sorted(good, key=lambda s: s.first)),
        )


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double, spans string"
)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: places of the base phrases, labels, and template spans.

    A null text counts as empty: no words, empty labels, score 0. ``score`` is the largest
    share of a template that a chain of matches covers, 0.5 at least where a base phrase
    stands. Spans are label:first word:end word (end exclusive). Repeated rows give repeated
    results, an empty table none; other columns are not read.
    """
    return map_texts(docs, ["doc_id", "text"], _work, SCHEMA)
