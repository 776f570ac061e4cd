"""Pattern packing by non-negative least squares.

Texts are tokenised and cut into pieces once, into a small table of piece lengths. The plan
depends on the histogram of lengths only: patterns of up to three lengths that fill a sequence
exactly get repeat counts by non-negative least squares, counts are rounded down, and what is
left is packed largest first with the best-fitting lengths. Each piece then finds its place by
its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import map_texts, saved

CAPACITY = 1024
END_ID = 2
#: A run of white space of this length is left to the tokenizer itself: the rank encoder's pattern
#: goes back over such a run and fails where it is very long.
LONG_RUN = 10_000
#: Ranks within one length are numbered in so many parts at least, of so many rows about.
PARTS, ROWS_PER_PART = 64, 200_000

#: Fixed value: the pattern by which a byte-level pre-tokenizer splits text.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def ranked_encoding(definition: str):
    """The tokenizer of a JSON definition as a rank table, or None where it is not one.

    A byte-level BPE whose token numbers follow the order of its merges is fully given by the
    ranks of its tokens, and a rank encoder gives the same ids several times as fast.
    """
    import tiktoken

    spec = json.loads(definition)
    model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type", "BPE") == "BPE"
        and not spec.get("normalizer")
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not any(
            model.get(k)
            for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        )
    )
    if not plain:
        return None
    alphabet, vocabulary = byte_alphabet(), model["vocab"]
    added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    ranks = {
        bytes(alphabet[c] for c in token): number
        for token, number in vocabulary.items()
        if token not in added and alphabet.keys() >= set(token)
    }
    merged = [m.replace(" ", "", 1) if isinstance(m, str) else "".join(m) for m in model["merges"]]
    numbers = [vocabulary[m] for m in merged]
    if numbers != sorted(numbers) or len(ranks) != 256 + len(set(merged)) or min(numbers) < 256:
        return None
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


def has_long_run(text: str, length: int = LONG_RUN) -> bool:
    return len(text) >= length and any(len(run) >= length for run in re.findall(r"\s+", text))


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes."""

    def __init__(self, definition: str):
        self.ranked, self.definition = ranked_encoding(definition), definition

    @cached_property
    def whole(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.definition)

    def encode(self, text: str) -> bytes:
        if self.ranked is not None and not has_long_run(text):
            ids = self.ranked.encode_to_numpy(text, allowed_special="all")
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full ones at the end, a shorter one first."""
    first = length % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID):
    """The pieces of every text; ``tokenizer`` is the path of a tokenizer's JSON file."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    end = int(end_id).to_bytes(4, "little")

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        encoder = Encoder(definition.value)
        for doc_id, text in rows:
            ids = (encoder.encode(text) if text else b"") + end
            for i, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                yield doc_id, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])

    return map_texts(docs, ["doc_id", "text"], work, PIECES)


def patterns(capacity: int) -> np.ndarray:
    """Rows of three lengths, largest first, that fill a sequence; 0 stands for none."""
    c, _, b = np.meshgrid(np.arange(capacity // 3 + 1), [0], np.arange(capacity // 2 + 1), indexing="ij")
    a = capacity - b - c
    ok = (c <= b) & (b <= a) & (a < capacity)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def least_squares(kinds: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns with the least ||A x - histogram||.

    Accelerated projected gradient; A is never built, its columns have three entries at most.
    """
    size = len(histogram)
    flat = kinds.ravel()

    def forward(x):
        y = np.bincount(flat, np.repeat(x, kinds.shape[1]), size)
        y[0] = 0
        return y

    def backward(y):
        y = y.copy()
        y[0] = 0
        return y[kinds].sum(axis=1)

    v = np.ones(len(kinds))
    for _ in range(12):  # the largest eigenvalue of A'A bounds the step
        v = backward(forward(v))
        v /= np.linalg.norm(v)
    rate = 1.0 / (1.05 * np.linalg.norm(backward(forward(v))))
    x = y = np.zeros(len(kinds))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * backward(forward(y) - histogram))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (old - 1) / t * (new - x)
        x = new
    return x


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that use up ``histogram`` (index: length) exactly."""
    left = np.asarray(histogram, dtype=np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    if left.sum():
        kinds = patterns(capacity)
        kinds = kinds[((left[kinds] > 0) | (kinds == 0)).all(axis=1)]
        if len(kinds):
            repeats = least_squares(kinds, left[: capacity + 1].astype(float))
            for j in np.argsort(-repeats, kind="stable"):
                if repeats[j] < 1:
                    break
                used, times = np.unique(kinds[j][kinds[j] > 0], return_counts=True)
                n = int(min(repeats[j], (left[used] // times).min()))
                if n:
                    left[used] -= n * times
                    out.append((tuple(int(v) for v in kinds[j] if v), n))
    while left.any():  # residuals: each round uses up one length at least
        room, parts, have = capacity, [], left.copy()
        while room and (fits := np.flatnonzero(have[: room + 1])).size:
            length = int(fits[-1])
            parts.append(length)
            have[length] -= 1
            room -= length
        used, times = np.unique(parts, return_counts=True)
        n = int((left[used] // times).min())
        left[used] -= n * times
        out.append((tuple(parts), n))
    return out


def places(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks of its runs, and each run's first sequence and offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    filled: dict[int, int] = {}
    base = 0
    for parts, n in planned:
        offset = 0
        for length in parts:
            runs.setdefault(length, []).append((filled.get(length, 0), base, offset))
            filled[length] = filled.get(length, 0) + n
            offset += length
        base += n
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in runs.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty: its only id is ``end_id``. Repeated rows are packed as often
    as they occur; a null doc_id stays null; an empty table gives no rows; other columns are
    not read. The driver holds one count per length, whatever the number of pieces.
    """
    pieces = saved(pieces_of(docs, tokenizer, capacity, end_id), "pieces")
    counts = pieces.groupBy("length").count().collect()
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts:
        histogram[r["length"]] = r["count"]
    parts = max(PARTS, int(histogram.max()) // ROWS_PER_PART)
    keyed = pieces.withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")
    )
    runs = places(plan(histogram, capacity))
    shared = docs.sparkSession.sparkContext.broadcast(runs)

    # rank of a piece among its length: its rank in its part, after the parts before
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        keyed.groupBy("length", "part")
        .count()
        .select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    )
    window = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start")
    inside = keyed.withColumn("rank", F.row_number().over(window) - 1)
    ranked = inside.join(firsts, ["length", "part"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        runs = shared.value
        for batch in batches:
            length, first, rank = (
                batch.column(n).to_numpy().astype(np.int64) for n in ("length", "first", "rank")
            )
            rank = rank + first
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for value in np.unique(length):
                at = length == value
                starts, bases, offsets = runs[int(value)]
                run = np.searchsorted(starts, rank[at], side="right") - 1
                sequence[at] = bases[run] + rank[at] - starts[run]
                offset[at] = offsets[run]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
