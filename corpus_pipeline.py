"""A training-corpus pipeline of five stages; each works on all that its predecessor kept.

1. toxicity: documents that score as toxic go.
2. simhash_near_dedup: of each group of near-duplicates the document with the smallest doc_id stays.
3. benchmark_decontamination: contaminated documents go.
4. pii_surrogates: personal data in the texts becomes surrogates.
5. source_mixing: the mix of the sources at their target weights, as pieces of fixed-length blocks.

The first four return the columns of `documents`; the last one row per piece (doc_id, source, lang,
shard, slot, block, word, text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from querytide.llm import decontaminate, mixing, simhash, surrogates, tables
from querytide.llm import toxicity as toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic.kept(docs, toxic.learnt(spark, sf_dir, docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, tables.table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.replaced(docs, counted=False)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_texts(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("source_mixing", source_mixing),
]

#: The stages' models, permutations and surrogates are beyond SQL; tests/llm holds them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = tables.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = tables.written(stage(spark, docs, sf_dir), name)
        if last is not None:
            tables.removed(last)
        last = docs
    return docs
