"""Queries of the training-text operators, each over its whole table, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    exact_dedup,
    hard_negatives,
    licenses,
    line_dedup,
    mixing,
    near_join,
    packing,
    pii,
    quality_crf,
    quality_rules,
    target_resampling,
    token_counts,
    toxicity,
)
from tidemark.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.jaccard_join(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "score",
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return target_resampling.target_scores(docs, target)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_toxicity": op3_toxicity,
        "op4_quality_rules": op4_quality_rules,
        "op5_token_counts": op5_token_counts,
        "op6_license_scan": op6_license_scan,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_packing": op8_packing,
        "op9_pii": op9_pii,
        "op10_quality_crf": op10_quality_crf,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_target_resampling": op12_target_resampling,
        "op13_line_dedup": op13_line_dedup,
        "pipeline": pipeline,
    }


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Every anchor against every row.
HARD_NEGATIVES_SQL = """
    WITH usable AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
            CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
        FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    positives AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
        QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT anchor_id, positive_id,
        CAST(ROW_NUMBER() OVER (PARTITION BY anchor_id, positive_id
            ORDER BY score DESC, other_id) AS INT) AS rank,
        other_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN pairs USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10"""

#: CRC-32 by its table: the polynomial in reversed bits, eight steps for each byte value.
CRC_TABLE_SQL = """list_transform(range(256), lambda i: list_reduce(
    list_concat([CAST(i AS UBIGINT)], list_transform(range(8), lambda z: CAST(z AS UBIGINT))),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END))"""
CRC_SQL = """xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT],
    list_transform(range(octet_length(encode(f))), lambda i:
        CAST('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS INT), 2) AS UBIGINT))),
    lambda c, b: xor(c >> 8, crc[CAST((xor(c, b) & 255) + 1 AS INT)])))"""
RESAMPLING_SQL = f"""
    WITH texts AS (
        SELECT 0 AS kind, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
    worded AS (
        SELECT kind, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM texts),
    features AS (
        SELECT kind, doc_id, UNNEST(list_concat(ws, list_transform(
            range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM worded),
    counted AS (SELECT kind, doc_id, f, COUNT(*) AS n FROM features GROUP BY ALL),
    crcs AS (SELECT {CRC_TABLE_SQL} AS crc),
    hashed AS (
        SELECT f, {CRC_SQL} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), crcs),
    bucketed AS (SELECT kind, doc_id, bucket, n FROM counted JOIN hashed USING (f)),
    buckets AS (
        SELECT bucket, CAST(coalesce(SUM(n) FILTER (WHERE kind = 0), 0) AS DOUBLE) AS s,
            CAST(coalesce(SUM(n) FILTER (WHERE kind = 1), 0) AS DOUBLE) AS t
        FROM bucketed GROUP BY 1),
    totals AS (SELECT SUM(s) AS s_all, SUM(t) AS t_all FROM buckets),
    gains AS (
        SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))
            AS gain FROM buckets, totals),
    means AS (
        SELECT doc_id, CAST(SUM(n) AS BIGINT) AS n_features,
            CAST(floor(SUM(n * gain) / SUM(n)) AS BIGINT) AS weight
        FROM bucketed JOIN gains USING (bucket) WHERE kind = 0 GROUP BY 1),
    noise AS (
        SELECT doc_id, len(ws) >= 20 AS open, floor(-1000 * ln(-ln((CAST(
            CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5)
            / 4294967296))) AS shift FROM worded WHERE kind = 0),
    scored AS (
        SELECT doc_id, open, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            CAST(coalesce(weight, 0) + shift AS BIGINT) AS score
        FROM noise LEFT JOIN means USING (doc_id)),
    ranked AS (
        SELECT doc_id, ROW_NUMBER() OVER (ORDER BY score DESC, doc_id) AS rank
        FROM scored WHERE open
        QUALIFY rank <= (SELECT 25 * COUNT(*) // 100 FROM scored WHERE open))
    SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN ranked USING (doc_id)"""

LINE_DEDUP_SQL = f"""
    WITH split AS (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, UNNEST(ls) AS line FROM split),
    keyed AS (
        SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
            '{UPPER}', '{LOWER}') AS key FROM lines),
    firsts AS (
        SELECT key, MIN(doc_id) AS first FROM keyed WHERE length(key) >= 10
        GROUP BY key HAVING COUNT(DISTINCT doc_id) > 1),
    marked AS (
        SELECT doc_id, i, line, coalesce(doc_id > first, false) AS gone
        FROM keyed LEFT JOIN firsts USING (key))
    SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), ''))
            AS kept_sha256
    FROM marked GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_exact_dedup": """
            WITH norm AS (
                SELECT doc_id, regexp_replace(coalesce(text, ''),
                    '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents)
            SELECT doc_id, MIN(doc_id) OVER same AS keep_id, COUNT(*) OVER same AS group_size,
                doc_id = MIN(doc_id) OVER same AS kept, sha256(body) AS text_sha256
            FROM norm WINDOW same AS (PARTITION BY body)""",
        "op11_hard_negatives": HARD_NEGATIVES_SQL,
        "op12_target_resampling": RESAMPLING_SQL,
        "op13_line_dedup": LINE_DEDUP_SQL,
    }
