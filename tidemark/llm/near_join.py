"""N-gram Jaccard join over a MinHash LSH forest.

A text is the set of its five-word shingles. Texts with equal sets form a class of copies and
are joined once. Each tree of the forest labels a class with a sequence of minimum hashes, and
the sorted labels of a tree are its prefix trie: rows are dealt by the shortest prefix that may
be needed, sorted by label, and every deeper node is then a run of neighbours.

A match starts at the whole label and is shortened value by value, as far down as the target
recall asks for a pair at the threshold. At each depth only branching nodes are visited, and in
them only pairs of classes that no longer prefix has brought into one group; a node all of whose
classes are in one group is resolved. Nodes of different trees with the same members are visited
once. A match counts when the sizes allow the threshold and the signatures (the labels of all
trees) agree in as many values as a pair at the threshold does, but for a probability far below
the missing recall; so long shared passages alone do not chain documents up.

Matches give connected groups of candidates, and every pair inside a group is verified on the
exact sets, in blocks of bounded size. Pairs are counted where they are verified, never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm.shared import map_texts, saved

SHINGLE = 5
THRESHOLD = 0.8
TREES, LABEL = 24, 8
RECALL = 0.9999
#: Bytes of one value of a label.
VALUE = 2
#: Members of one side of a block of a trie node.
NODE = 2048
#: Members and shingles of one side of a verification block, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
WORD_MEMO = 250_000


def prefix_length(trees: int, label: int, threshold: float, recall: float) -> int:
    """The longest prefix with which a pair at the threshold matches in some tree with
    probability ``recall``: from the whole label on, shortened until that holds."""
    depth = label
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def least_agreement(values: int, threshold: float, risk: float) -> int:
    """The number of equal values of two signatures below which a pair at the threshold falls
    with a probability of ``risk`` at most."""
    below = 0.0
    for n in range(values + 1):
        log = math.lgamma(values + 1) - math.lgamma(n + 1) - math.lgamma(values - n + 1)
        log += n * math.log(threshold)
        below += math.exp(log + (values - n) * math.log1p(-threshold)) if threshold < 1 else n == values
        if below > risk:
            return n
    return values


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, hashes: dict[bytes, int], size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text with fewer words is one shingle, a text
    without words has none."""
    words = (text or "").encode().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    width = min(size, n)
    key = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : n - width + 1 + k]
    return np.unique(_mix(key))


class Forest:
    """Labels of the trees, one after the other: ``label`` values of 16 bits each."""

    def __init__(self, trees: int, label: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = trees * label
        self.a = rng.integers(0, 2**31, n, dtype=np.uint32) << np.uint32(1) | np.uint32(1)
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)

    def labels(self, shingles: np.ndarray) -> bytes:
        x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
        low = np.full(len(self.a), np.iinfo(np.uint32).max, dtype=np.uint32)
        for at in range(0, len(x), 256):
            np.minimum(low, (x[at : at + 256] * self.a + self.b).min(axis=0), out=low)
        # the least hash of a large set is a small number: mix it before it is shortened
        return (low * np.uint32(0x9E3779B1) >> np.uint32(16)).astype("<u2").tobytes()


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame, trees: int, label: int, size: int) -> DataFrame:
    """doc_id, text_key, row, set_key, size of the set, and labels, once per row."""

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        hashes, forest = _WordHashes(), Forest(trees, label)
        for doc_id, text_key, row, text in rows:
            found = shingle_set(text, hashes, size)
            # texts without words are no copies of one another
            key = set_key(found) if len(found) else b"row" + row.to_bytes(8, "big")
            yield doc_id, text_key, row, key, len(found), forest.labels(found) if len(found) else b""

    keyed = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        F.monotonically_increasing_id().alias("row"),
        "text",
    )
    schema = "doc_id long, text_key long, row long, set_key binary, shingles int, labels binary"
    names = ["doc_id", "text_key", "row", "text"]
    return saved(map_texts(keyed, names, work, schema), "signatures")


def suspects(frame: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """``frame`` with ``__possible``: false only where ``column`` is no ``key`` of ``keys``, a
    written table. No row of ``frame`` is shuffled."""
    cells = bloom.cells_for(keys.count())

    def cell(name: str):
        return F.pmod(F.xxhash64(name), F.lit(cells)) + 1

    maps = saved(bloom.bitmaps(keys.select(cell(key).alias("cell"))), "key-filter")
    return bloom.probed(frame, maps, cell(column), "__possible")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every node of ``edges`` (a, b) but the roots: the smallest node reachable.

    Alternates two star steps, each a grouped minimum and a join, until nothing changes. Every
    round is written to the shared scratch folder.
    """
    now = saved(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w"))
        .where("u <> w")
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            return now.select(F.col("u").alias("v"), F.col("w").alias("root"))
        mark = tuple(state)
        both = now.select(F.col("u").alias("n"), F.col("w").alias("x")).unionByName(
            now.select(F.col("w").alias("n"), F.col("u").alias("x"))
        )
        least = both.groupBy("n").agg(F.least("n", F.min("x")).alias("m"))
        large = both.join(least, "n").where("x > n").select(F.col("x").alias("u"), F.col("m").alias("w"))
        low = large.groupBy("u").agg(F.min("w").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("w").alias("u"), F.col("m").alias("w"))
            .where("u <> w")
            .unionByName(low.select("u", F.col("m").alias("w")))
        )
        now = saved(small.distinct(), "edges")


def shortened(
    own: np.ndarray,
    signature: np.ndarray,
    sizes: np.ndarray,
    side: np.ndarray | None,
    depth: int,
    need: int,
    threshold: float,
) -> np.ndarray:
    """Groups of the classes under one prefix: for each row the number of a row of its group.

    ``own`` holds the sorted labels of the tree. Prefixes are shortened from the whole label to
    ``depth``; pairs meet where their labels part. With ``side``, pairs of one side are left out.
    """
    m, full = own.shape
    shared = (own[1:] == own[:-1]).cumprod(axis=1).sum(axis=1)
    group, child = np.arange(m), np.arange(m)
    for d in range(full, depth - 1, -1):
        first = np.concatenate(([True], shared < d))
        starts = np.flatnonzero(first)
        for lo, hi in zip(starts, np.append(starts[1:], m)):
            if child[lo] == child[hi - 1]:
                continue  # one row, or a node that does not branch here
            for i in range(lo, hi - 1):
                if (group[lo:hi] == group[lo]).all():
                    break  # resolved
                rest = slice(i + 1, hi)
                may = (group[rest] != group[i]) & (child[rest] != child[i])
                less, more = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
                may &= less >= threshold * more - 1e-9
                if side is not None:
                    may &= side[rest] != side[i]
                other = i + 1 + np.flatnonzero(may)
                if len(other):
                    agree = (signature[other] == signature[i]).sum(axis=1) >= need
                    met = np.unique(group[other[agree]])
                    if len(met):
                        group[np.isin(group, met)] = group[i]
        child = first.cumsum()
    return group


def candidate_edges(reps: DataFrame, trees: int, label: int, threshold: float, recall: float) -> DataFrame:
    """A star per group that a block of a trie node gives: its classes with one of them."""
    depth = prefix_length(trees, label, threshold, recall)
    need = least_agreement(trees * label, threshold, (1 - recall) / 100)
    width = VALUE * label

    def part(length: int):
        return F.substring("labels", F.col("tree") * width + 1, F.lit(length))

    rows = (
        reps.where("shingles > 0")
        .select("v", "labels", F.explode(F.array(*[F.lit(t) for t in range(trees)])).alias("tree"))
        .select("v", "tree", F.xxhash64("tree", part(VALUE * depth)).alias("key"))
    )
    same = [F.count(F.lit(1)).alias("n"), F.min("v").alias("first"), F.max("v").alias("last")]
    nodes = (
        rows.groupBy("key")
        .agg(*same, F.bit_xor(F.xxhash64("v")).alias("print"))
        .where("n > 1")
        .groupBy("n", "first", "last", "print")  # the same members in several trees
        .agg(F.min("key").alias("key"))
        .select("key", "n")
    )
    members = saved(rows.join(saved(nodes, "nodes"), "key"), "node-members")
    labelled = suspects(reps.select("v", "labels", "shingles"), "v", members, "v").where("__possible")
    blocks = (
        members.join(labelled.drop("__possible"), "v")
        .withColumn("chunks", F.ceil(F.col("n") / NODE).cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("i", F.least("chunk", "k"))
        .withColumn("j", F.greatest("chunk", "k"))
        .withColumn("own", part(width))
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "own", "v")
    )

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (_, i, j), block in groupby(rows, key=lambda r: r[:3]):
            _, _, _, chunk, v, sizes, own, labels = zip(*block)
            group = shortened(
                np.frombuffer(b"".join(own), "<u2").reshape(len(v), label),
                np.frombuffer(b"".join(labels), "<u2").reshape(len(v), trees * label),
                np.array(sizes),
                None if i == j else np.array(chunk),
                depth,
                need,
                threshold,
            )
            for k in np.flatnonzero(group != np.arange(len(v))).tolist():
                yield v[k], v[group[k]]

    names = ["key", "i", "j", "chunk", "v", "shingles", "own", "labels"]
    return map_texts(blocks, names, work, "a long, b long")


def verify_block(
    left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float, every: bool = True
) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets with a Jaccard similarity of ``threshold`` or more; j counts on
    after the left sets. Without ``right``: pairs i < j within ``left``. Without ``every``: pairs
    enough to connect what such pairs connect."""
    other = left if right is None else right
    base = 0 if right is None else len(left)
    values = np.concatenate(other)
    owner = np.repeat(np.arange(len(other)), [len(s) for s in other])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    sizes = np.array([len(s) for s in other])
    out = []
    group = np.arange(base + len(other))
    for i, mine in enumerate(left):
        if not every and (group[base:] == group[i]).all():
            continue
        lo = np.searchsorted(values, mine, "left")
        n = np.searchsorted(values, mine, "right") - lo
        total = int(n.sum())
        if not total:
            continue
        at = np.repeat(lo - np.concatenate(([0], n.cumsum()[:-1])), n) + np.arange(total)
        common = np.bincount(owner[at], minlength=len(other))
        near = common >= threshold * (len(mine) + sizes - common) - 1e-9
        if right is None:
            near[: i + 1] = False
        found = base + np.flatnonzero(near)
        out += [(i, int(j)) for j in found]
        if not every and len(found):
            group[np.isin(group, group[found])] = group[i]
    return out


def verified(
    docs: DataFrame, reps: DataFrame, edges: DataFrame, threshold: float, size: int, every: bool
) -> DataFrame:
    """v, links and root per block: partners of class v in the block, and the smallest class
    that verified pairs of the block connect it with. Without ``every``, links are not whole."""
    groups = components(edges)
    everyone = groups.unionByName(groups.select(F.col("root").alias("v"), "root").distinct())
    of = reps.select("v", F.col("rep_id").alias("__id"), "set_key", "shingles")
    placed = saved(everyone.join(of, "v"), "group-members")
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("shingles").alias("total"))
    chunks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES))
    members = (
        placed.join(sizes, "root")
        .withColumn("chunks", chunks.cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))
        .select("v", "root", "chunks", "chunk", "__id", "set_key")
    )
    possible = suspects(docs.select("doc_id", "text"), "doc_id", placed, "__id").where("__possible")
    texts = possible.join(members, F.col("doc_id").eqNullSafe(F.col("__id")))

    def sets(rows: Iterator[tuple]) -> Iterator[tuple]:
        hashes = _WordHashes()
        for v, root, chunks, chunk, key, text in rows:
            found = shingle_set(text, hashes, size)
            if len(found) and set_key(found) == key:  # not another text with the same id
                for k in range(chunks):
                    yield v, root, min(chunk, k), max(chunk, k), chunk, found.tobytes()

    dealt = map_texts(
        texts,
        ["v", "root", "chunks", "chunk", "set_key", "text"],
        sets,
        "v long, root long, i int, j int, chunk int, shingles binary",
        rows_out=256,
    )

    def check(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        block = block.drop_duplicates("v").sort_values("v")
        arrays = [np.frombuffer(s, dtype=np.uint64) for s in block["shingles"]]
        side = block["chunk"].to_numpy()
        ids = block["v"].to_numpy()
        if i == j:
            pairs = verify_block(arrays, None, threshold, every) if len(arrays) > 1 else []
        else:
            a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
            ids = ids[np.concatenate((a, b))]
            pairs = (
                verify_block([arrays[k] for k in a], [arrays[k] for k in b], threshold, every)
                if len(a) and len(b)
                else []
            )
        links = np.zeros(len(ids), dtype=np.int64)
        parent = list(range(len(ids)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in pairs:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            if ids[x] > ids[y]:
                x, y = y, x
            parent[y] = x
        used = np.flatnonzero(links)
        return pd.DataFrame(
            {"v": ids[used], "links": links[used], "root": [ids[find(int(k))] for k in used]}
        )

    return saved(
        dealt.groupBy("root", "i", "j").applyInPandas(check, "v long, links long, root long"),
        "links",
    )


def classes(docs: DataFrame, threshold: float, recall: float, trees: int, size: int, every: bool = True):
    """Signatures of all rows, and per set_key: class and links (whole if ``every``)."""
    rows = signatures(docs, trees, LABEL, size)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    reps = saved(
        rows.groupBy("set_key")
        .agg(
            first.alias("first"),
            F.count(F.lit(1)).alias("n_copies"),
            F.first("shingles").alias("shingles"),
            F.first("labels").alias("labels"),
        )
        .select(
            F.col("first.row").alias("v"),
            F.col("first.doc_id").alias("rep_id"),
            "set_key",
            "n_copies",
            "shingles",
            "labels",
        ),
        "classes",
    )
    edges = candidate_edges(reps, trees, LABEL, threshold, recall)
    found = verified(docs, reps, edges, threshold, size, every)
    joined = components(found.select(F.col("v").alias("a"), F.col("root").alias("b")))
    labels = joined.unionByName(joined.select(F.col("root").alias("v"), "root").distinct())
    counts = found.groupBy("v").agg(F.sum("links").alias("n_links"))
    of = reps.select("v", "rep_id", "set_key", "n_copies")
    linked = labels.join(counts, "v").join(of, "v")
    heads = linked.groupBy("root").agg(
        F.min(F.struct(F.col("rep_id").isNull().alias("no_id"), "rep_id", "v")).alias("head")
    )
    near = linked.join(heads, "root").select("v", "n_links", "head")
    table = of.join(near, "v", "left").select(
        "set_key",
        "n_copies",
        F.col("rep_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("head").isNull(), F.col("rep_id")).otherwise(F.col("head.rep_id")).alias("class_id"),
        F.coalesce("head.v", "v").alias("class_row"),
    )
    return rows, table


def jaccard_join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    trees: int = TREES,
    size: int = SHINGLE,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, rep_id, n_links, n_copies.

    Words are what ASCII white space divides, as they stand. ``rep_id`` is the smallest doc_id
    with the same shingle set, ``n_copies`` the number of rows with that set, ``n_links`` the
    number of other sets with a similarity of ``threshold`` or more, and ``class_id`` the
    smallest doc_id that links and copies connect the row with. A text of fewer words than a
    shingle is one shingle; a null, empty or blank text is linked to nothing and stands alone.
    Null ids sort last; repeated rows are copies; an empty table gives no rows; other columns
    are not read.
    """
    rows, table = classes(docs, threshold, recall, trees, size)
    return rows.select("doc_id", "set_key").join(table, "set_key").select(
        "doc_id", "class_id", "rep_id", "n_links", F.col("n_copies").cast("long").alias("n_copies")
    )


def keep_one_per_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the row of its smallest doc_id.

    Rows are dropped by id and text, so that other texts under the same id stay; of repeated
    rows one stays.
    """
    values = {"threshold": THRESHOLD, "recall": RECALL, "trees": TREES, "size": SHINGLE} | options
    rows, table = classes(docs, **values, every=False)
    decided = saved(
        rows.select("doc_id", "text_key", "row", "set_key")
        .join(table.select("set_key", "class_row"), "set_key")
        .groupBy("doc_id", "text_key")
        .agg(
            F.max((F.col("row") == F.col("class_row")).cast("int")).alias("stays"),
            F.count(F.lit(1)).alias("times"),
        )
        .where("stays = 0 OR times > 1"),
        "near-decided",
    )
    decided = decided.select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "stays", "times"
    )
    names = docs.columns
    inner = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"),
        F.col("doc_id").alias("d"),
        F.xxhash64("text").alias("k"),
    )
    inner = suspects(inner, "d", decided, "__id")
    straight = inner.where(~F.col("__possible")).select("doc.*")
    marked = inner.where("__possible").join(
        decided, F.col("d").eqNullSafe(F.col("__id")) & (F.col("k") == F.col("__key")), "left"
    )
    single = marked.where("stays IS NULL").select("doc.*")
    repeated = marked.where("stays = 1").dropDuplicates(["d", "k"]).select("doc.*")
    return straight.unionByName(single).unionByName(repeated)
