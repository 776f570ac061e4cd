"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, URL schemes, key cues)
in one pass over the text. At each anchor a small deterministic parser expands to the left and
right, and validates what it finds. Parsers start at anchors only, in text order, and never
inside a match of their own kind, so the base kinds equal a leftmost non-overlapping search.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from tidemark.llm.shared import map_texts

#: Base kinds in the order of the digest, then the kinds this method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT_RUN = re.compile(r"[0-9]+")
_URL = re.compile(r"://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?:/[^\s\"'<>()]*)?")
_SCHEMES = ("https", "http", "ftp", "sftp", "ssh", "git")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"[a-z_-]{0,16}[\"']?\s{0,2}[:=]\s{0,2}[\"']?([A-Za-z0-9+/_=-]{20,})", re.I)
#: Words that announce an account or a credential.
CUES = ("token", "secret", "password", "api_key", "apikey", "access_key", "iban")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    code = text.replace(" ", "")
    if not 15 <= len(code) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def spans(text: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, as [start, end) in code points."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *ADDED)}
    after = dict.fromkeys(out, 0)  # end of the last match of each kind, valid or not
    for last, (kind, width) in anchors.iter(text):
        at = last - width + 1
        if kind == "digit":
            if at >= after["ip"]:
                if m := _IP.match(text, at):
                    after["ip"] = m.end()
                    if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
                        out["ip"].append(m.span())
                else:  # no later digit of this run can start one either
                    after["ip"] = _DIGIT_RUN.match(text, at).end()
            if at >= after["card"] and (m := _CARD.match(text, at)):
                after["card"] = m.end()
                digits = re.sub("[ -]", "", m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        elif kind == "at":
            start = at
            while start > after["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                after["email"] = m.end()
                out["email"].append((start, m.end()))
        elif kind == "plus":
            if at >= after["phone"] and (m := _PHONE.match(text, at)):
                after["phone"] = m.end()
                if 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif kind == "scheme":
            head = text[max(0, at - 5) : at].lower()
            scheme = next((s for s in _SCHEMES if head.endswith(s)), None)
            if scheme and at - len(scheme) >= after["url"] and (m := _URL.match(text, at)):
                after["url"] = m.end()
                out["url"].append((at - len(scheme), m.end()))
        elif text[at : last + 1].lower() == "iban":
            m = _IBAN.match(text, _skip(text, last + 1))
            if m and m.start() >= after["iban"] and iban_valid(m[0]):
                after["iban"] = m.end()
                out["iban"].append(m.span())
        elif last + 1 >= after["secret"] and (m := _SECRET.match(text, last + 1)):
            after["secret"] = m.end(1)
            if any(c in _DIGITS for c in m[1]):
                out["secret"].append(m.span(1))
    return out


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in " :=#.\"'":
        at += 1
    return at


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def _work(rows: Iterator[tuple]) -> Iterator[tuple]:
    anchors = automaton()
    for doc_id, text in rows:
        found = spans(text or "", anchors)
        base = listed(found, BASE)
        yield (
            doc_id,
            *[len(found[k]) for k in BASE],
            hashlib.sha256(base.encode()).hexdigest(),
            listed(found, (*BASE, *ADDED)),
        )


SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
    "base_sha256 string, spans string"
)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, the digest of their spans and
    all spans as kind:start:end (code points, end exclusive), by kind, then start.

    A null text counts as empty: no spans, digest of the empty string. Texts of any length are
    read whole in time linear in their length. Repeated rows give repeated results, an empty
    table none; other columns are not read.
    """
    return map_texts(docs, ["doc_id", "text"], _work, SCHEMA)
