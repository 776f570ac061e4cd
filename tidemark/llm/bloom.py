"""Bloom filters of bounded size, merged from tasks, and joins that spread hot keys.

A filter has a power of two of cells, 16 for each expected key and at most ``MAX_CELLS`` (64 MB).
Beyond that it fills up and lets more keys pass as suspects; results stay whole, as suspects are
always confirmed, and nothing else changes with the size of a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS_PER_KEY, MIN_CELLS, MAX_CELLS = 16, 1 << 15, 1 << 29
#: Cells of one chunk of a merged filter; a list of positions takes two bytes a cell.
CHUNK = 1 << 16
#: Cells a task holds before it hands its chunks on.
HELD = 1 << 22
#: A key with more than this share of the rows is joined by broadcast: fewer keys than this.
HOT_KEYS = 4096


def cells_for(keys: int) -> int:
    wanted = 1 << (CELLS_PER_KEY * max(keys, 1) - 1).bit_length()
    return min(MAX_CELLS, max(MIN_CELLS, wanted))


# -- filters merged from tasks ----------------------------------------------------------------


def _packed(positions: np.ndarray) -> bytes:
    """Sorted positions within a chunk: a list of them, or a bitmap where that is smaller."""
    if 2 * len(positions) < CHUNK // 8:
        return positions.astype("<u2").tobytes()
    bits = np.zeros(CHUNK, np.uint8)
    bits[positions] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _positions(packed: bytes) -> np.ndarray:
    if len(packed) < CHUNK // 8:
        return np.frombuffer(packed, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little"))


def _chunks(cells: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(chunk, cells hit at least once, cells hit at least twice) of a task's cells."""
    value, times = np.unique(cells, return_counts=True)
    starts = np.flatnonzero(np.diff(value // CHUNK, prepend=-1))
    for lo, hi in zip(starts, [*starts[1:], len(value)]):
        at, twice = value[lo:hi] % CHUNK, times[lo:hi] > 1
        yield int(value[lo] // CHUNK), _packed(at), _packed(at[twice])


def key_cells(digests: bytes, cells: int) -> np.ndarray:
    """Two cells (columns) of each 16-byte digest."""
    return (np.frombuffer(digests, "<u4").reshape(-1, 4)[:, :2] & (cells - 1)).astype(np.int64)


def twice_seen(keys: DataFrame, column: str, cells: int) -> list[tuple[int, bytes]]:
    """Chunks of the filter of cells that two or more keys hit.

    ``column`` holds 16-byte digests one after the other. Each task keeps two filters of its
    own, cells seen once and seen twice, and hands on one row a chunk; merging ORs them, and a
    cell that two tasks have seen once is seen twice. No row a key is shuffled.
    """

    def scan(batches):
        held, size = [], 0

        def flush():
            rows = list(_chunks(np.concatenate(held)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                names=["chunk", "ones", "twos"],
            )

        for batch in batches:
            digests = b"".join(x for x in batch.column(0).to_pylist() if x)
            if not digests:
                continue
            both = key_cells(digests, cells)
            both[both[:, 0] == both[:, 1], 1] = -1  # one key hits a cell once
            flat = both.ravel()
            held.append(flat[flat >= 0])
            size += len(flat)
            if size >= HELD:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def merge(batches):
        def done(chunk, twos):
            bits = np.packbits(twos, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int32()), pa.array([bits], pa.binary())], names=["chunk", "bits"]
            )

        now, ones, twos = None, None, None
        for batch in batches:
            for chunk, one, two in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if chunk != now:
                    if now is not None and twos.any():
                        yield done(now, twos)
                    now, ones, twos = chunk, np.zeros(CHUNK, bool), np.zeros(CHUNK, bool)
                at = _positions(one)
                twos[at[ones[at]]] = True
                ones[at] = True
                twos[_positions(two)] = True
        if now is not None and twos.any():
            yield done(now, twos)

    parts = keys.select(column).mapInArrow(scan, "chunk int, ones binary, twos binary")
    merged = (
        parts.repartition("chunk")
        .sortWithinPartitions("chunk")
        .mapInArrow(merge, "chunk int, bits binary")
    )
    # MAX_CELLS / 8 bytes at most
    return [(r["chunk"], bytes(r["bits"])) for r in merged.collect()]


class Filter:
    """A merged filter as one array of bits, for probing in tasks."""

    def __init__(self, chunks: list[tuple[int, bytes]], cells: int):
        self.cells, self.bits = cells, np.zeros(max(cells, CHUNK) // 8, np.uint8)
        for chunk, bits in chunks:
            at = chunk * CHUNK // 8
            self.bits[at : at + CHUNK // 8] = np.frombuffer(bits, np.uint8)

    def suspected(self, digests: bytes) -> np.ndarray:
        """Whether both cells of each digest are set."""
        at = key_cells(digests, self.cells)
        return ((self.bits[at >> 3] >> (at & 7)) & 1).all(axis=1)


# -- filters by DataFrame functions -----------------------------------------------------------


def bitmaps(cells: DataFrame, cell: str = "cell") -> DataFrame:
    """Numbers from 1 on as 4 KB bitmaps, one for each run of 32,768 of them."""
    return cells.groupBy(F.bitmap_bucket_number(cell).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits")
    )


def probed(frame: DataFrame, maps: DataFrame, cell: Column, name: str) -> DataFrame:
    """``frame`` with boolean ``name``: whether ``cell`` is in the filter; no row is shuffled.

    ``maps`` is broadcast: MAX_CELLS / 8 bytes at most.
    """
    small = maps.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    position = F.bitmap_bit_position(cell)
    byte = F.substring("__bits", F.floor(position / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    bit = F.getbit(value, F.pmod(position, F.lit(8)).cast("int"))
    return (
        frame.join(F.broadcast(small), F.bitmap_bucket_number(cell) == F.col("__bucket"), "left")
        .withColumn(name, F.coalesce(bit == 1, F.lit(False)))
        .drop("__bucket", "__bits")
    )


# -- joins ------------------------------------------------------------------------------------


def joined_to_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to one row a ``key`` of ``groups``, whatever share of rows a key holds.

    ``size`` is the number of rows of a key. Keys above a 4,096th of all rows, so fewer than 4,096
    of them, are broadcast and their rows stay where they are; the others are shuffled, none of
    them large. ``groups`` should be a written table: it is read three times.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    bound = max(1, total // HOT_KEYS)
    hot = groups.where(F.col(size) > bound)
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("__hot"))), key, "left")
    plain = marked.where(F.col("__hot").isNull()).drop("__hot")
    loud = marked.where("__hot").drop("__hot")
    rest = groups.where(F.col(size) <= bound)
    return loud.join(F.broadcast(hot), key).unionByName(plain.join(rest, key, how))
