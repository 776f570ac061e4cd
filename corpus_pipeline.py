"""From raw documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but
the last return the columns of documents. ``run`` writes each stage's result as Parquet to the
shared scratch folder and reads it again, so a lost executor costs one stage at most.

Nulls and empty tables: a document without text fails the quality rules and goes; an empty
table passes through all stages; null sources come last in the mix; extra columns are kept
until packing, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import tidemark
from tidemark.llm import exact_dedup, mixing, near_join, packing, quality_rules
from tidemark.llm.shared import saved, table

# tasks carry the package's own functions, so workers need no copy of this folder
cloudpickle.register_pickle_by_value(tidemark)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.keep_one_per_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", keep_quality),
    ("exact dedup", drop_copies),
    ("near-duplicate join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The stages need tokenizers, sampled blocks and hashes that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
