"""Lines that repeat across documents, dropped everywhere but in the first document.

Pass 1 hashes the distinct lines of every document; tasks fill two Bloom filters, of lines seen
once and of lines seen twice, which are merged chunk by chunk. Pass 2 probes the second filter:
only lines that may repeat shuffle, are confirmed by their whole digest and find the smallest
doc_id that holds them. Documents that lose no line pass straight through.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm import bloom
from tidemark.llm.shared import map_texts, saved

#: Code points a line's key needs before it counts as a repetition.
LEAST = 10
_SPACE = " \t\n\x0b\x0c\r"
DIGEST = 16


def line_digest(line: str, least: int = LEAST) -> bytes | None:
    """128 bits of the line's key: stripped of ASCII white space, A-Z in lower case; None where
    the key is shorter than ``least``."""
    key = line.strip(_SPACE)
    if len(key) < least:
        return None
    return blake2b(key.encode().lower(), digest_size=DIGEST).digest()


def digests_of(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id and the digests of the document's distinct keys, one after the other."""

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            found = {line_digest(x, least) for x in text.split("\n")} if text else set()
            found.discard(None)
            if found:
                yield doc_id, b"".join(sorted(found))

    return saved(map_texts(docs, ["doc_id", "text"], work, "doc_id long, keys binary", 256), "line-keys")


def repeats(keys: DataFrame) -> DataFrame:
    """Confirmed repetitions to drop: no_id, id (of the document) and key (its digest).

    A key that occurs under two doc_ids or more stays in the smallest; a null id is the largest.
    """
    total = keys.agg(F.sum(F.length("keys"))).first()[0] or 0
    cells = bloom.cells_for(total // DIGEST)
    twice = bloom.twice_seen(keys, "keys", cells)
    shared = keys.sparkSession.sparkContext.broadcast((twice, cells))

    def probe(rows: Iterator[tuple]) -> Iterator[tuple]:
        seen = bloom.Filter(*shared.value)
        for doc_id, mine in rows:
            hit = seen.suspected(mine)
            for i in hit.nonzero()[0].tolist():
                yield doc_id is None, doc_id or 0, mine[DIGEST * i : DIGEST * (i + 1)]

    suspects = saved(
        map_texts(keys, ["doc_id", "keys"], probe, "no_id boolean, id long, key binary"), "line-suspects"
    )
    has = ~F.col("no_id")
    groups = suspects.groupBy("key").agg(
        F.min(F.when(has, F.col("id"))).alias("first"),
        F.max(F.when(has, F.col("id"))).alias("last"),
        F.max("no_id").alias("also_null"),
        F.count(F.lit(1)).alias("size"),
    )
    more = (F.col("first") < F.col("last")) | (F.col("also_null") & F.col("first").isNotNull())
    firsts = saved(groups.where(more).select("key", "first", "size"), "line-firsts")
    found = bloom.joined_to_groups(suspects, firsts, "key", "size")
    return found.where(F.col("no_id") | (F.col("id") > F.col("first"))).select("no_id", "id", "key")


def _id_hash(no_id, id_):
    return F.xxhash64(no_id, id_)


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with the lines that stay as ``text``, and n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower case.
    Keys of at least ``least`` code points that occur under two doc_ids or more lose all their
    lines except under the smallest; all lines of that document stay, repeated ones too. Rows
    that share a doc_id count as one document, a null doc_id as the largest. Lines end at line
    feeds only. A null or empty text is one empty line and stays as it is; an empty table gives
    no rows; all columns pass through, with columns named n_lines or n_dropped replaced.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    drops = repeats(digests_of(docs, least))
    lists = saved(
        drops.groupBy("no_id", "id").agg(F.array_join(F.sort_array(F.collect_set(F.hex("key"))), "").alias("lost")),
        "line-lists",
    )
    cells = bloom.cells_for(lists.count())
    maps = bloom.bitmaps(lists.select((F.pmod(_id_hash("no_id", "id"), F.lit(cells)) + 1).alias("cell")))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")).select(
        "doc",
        F.col("doc.doc_id").isNull().alias("no_id"),
        F.coalesce("doc.doc_id", F.lit(0)).cast("long").alias("id"),
    )
    marked = bloom.probed(held, maps, F.pmod(_id_hash("no_id", "id"), F.lit(cells)) + 1, "touched")
    n_lines = F.size(F.split(F.coalesce("doc.text", F.lit("")), "\n")).cast("long")
    none = F.lit(0).cast("long")
    straight = marked.where("NOT touched").select("doc.*", n_lines.alias("n_lines"), none.alias("n_dropped"))
    joined = marked.where("touched").join(lists, ["no_id", "id"], "left")
    return straight.unionByName(_applied(joined, docs, names, least))


def _applied(joined: DataFrame, docs: DataFrame, names: list[str], least: int) -> DataFrame:
    """Rows of documents without their lost lines; other columns pass as they are."""
    fields = [docs.schema[c] for c in names]
    schema = T.StructType(
        [*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    )
    arrow, at = to_arrow_schema(schema), names.index(next(c for c in names if c.lower() == "text"))
    inner = joined.select(*[F.col(f"doc.`{c}`").alias(f"c{i}") for i, c in enumerate(names)], "lost")

    def apply(batches):
        for batch in batches:
            texts, counts, drops = [], [], []
            for text, lost in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                lines = (text or "").split("\n")
                counts.append(len(lines))
                if lost:
                    raw = bytes.fromhex(lost)
                    gone = {raw[i : i + DIGEST] for i in range(0, len(raw), DIGEST)}
                    stay = [x for x in lines if line_digest(x, least) not in gone]
                    text, n = "\n".join(stay), len(lines) - len(stay)
                    drops.append(n)
                else:
                    drops.append(0)
                texts.append(text)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, arrow.field(at).type)
            columns += [pa.array(counts, pa.int64()), pa.array(drops, pa.int64())]
            columns = [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return inner.mapInArrow(apply, schema)


def line_digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of ``without_repeats``; other columns are not
    read."""
    rows = without_repeats(docs.select("doc_id", "text"), least)
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return rows.select("doc_id", "n_lines", "n_dropped", kept)
