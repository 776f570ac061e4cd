"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Each trie node has a failure link and the number of
pieces popped on the way to it, worked out once, so a word is counted in one left-to-right
pass without building its pieces or stepping back.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from tidemark.llm.shared import map_texts

#: Words counted per task that are remembered.
MEMO = 200_000


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a rank file: one base64 piece and its number on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class LongestMatch:
    """Counts the pieces of greedy longest match from the left.

    The vocabulary must hold every single byte that occurs; ``count`` gives None otherwise.
    """

    def __init__(self, pieces: Iterable[bytes]):
        step: dict[int, int] = {}  # node * 256 + byte -> node; node 0 is the root
        final, nodes = {0: False}, 1
        for piece in pieces:
            at = 0
            for byte in piece:
                key = at << 8 | byte
                nxt = step.get(key)
                if nxt is None:
                    nxt = step[key] = nodes
                    final[nodes] = False
                    nodes += 1
                at = nxt
            final[at] = at != 0
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in step.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        fail, pops = [-1] * nodes, [0] * nodes
        queue = deque([0])
        while queue:  # breadth first: links of shorter strings exist already
            parent = queue.popleft()
            for byte, node in below.get(parent, ()):
                queue.append(node)
                if final[node]:
                    fail[node], pops[node] = 0, 1
                    continue
                total, at = pops[parent], fail[parent]
                while at >= 0 and (at << 8 | byte) not in step:
                    total += pops[at]
                    at = fail[at]
                if at >= 0:
                    fail[node], pops[node] = step[at << 8 | byte], total
        self.step, self.fail, self.pops = step, fail, pops

    def count(self, word: bytes) -> int | None:
        step, fail, pops = self.step, self.fail, self.pops
        at = total = 0
        for byte in word:
            while (nxt := step.get(at << 8 | byte)) is None:
                if fail[at] < 0:
                    return None
                total += pops[at]
                at = fail[at]
            at = nxt
        while at:
            if fail[at] < 0:
                return None
            total += pops[at]
            at = fail[at]
        return total


SCHEMA = "doc_id long, n_bytes long, n_words long, n_tokens long"


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per row of ``docs``: UTF-8 bytes, words, and word pieces of the text.

    ``vocabulary`` is the path of a rank file, read on the driver and sent to the tasks. Words
    are what ASCII white space divides; each is matched with a leading space, the mark of a
    word start in such vocabularies. A null or empty text has no words and no pieces; a word
    with a byte that the vocabulary lacks makes n_tokens null. Repeated rows give repeated
    results, an empty table none; other columns are not read.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        automaton = LongestMatch(pieces.value)
        memo: dict[bytes, int | None] = {}
        for doc_id, text in rows:
            data = (text or "").encode()
            found = data.split()  # bytes split at ASCII white space only
            total: int | None = 0
            for word in found:
                n = memo.get(word, -1)
                if n == -1:
                    if len(memo) >= MEMO:
                        memo.clear()
                    n = memo[word] = automaton.count(b" " + word)
                total = None if n is None or total is None else total + n
            yield doc_id, len(data), len(found), total

    return map_texts(docs, ["doc_id", "text"], work, SCHEMA)
