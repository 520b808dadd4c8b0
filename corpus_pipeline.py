"""The corpus pipeline: language, near-duplicates, long repeats, benchmark passages, ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents. A null text is rejected by the first stage; what each stage does in other odd cases is told by
its operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelake.llm import decontaminate, language_id, order_minhash, sentencepiece_codec, suffix_dedup
from scorelake.llm.common import discard, discard_paths, kept, table, written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language_id.known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest doc_id."""
    return order_minhash.dedup(docs)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 200-byte strings that occur again."""
    return suffix_dedup.remove(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_ids of each text."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("language_id", languages),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", long_repeats),
    ("decontamination", benchmark_passages),
    ("sentencepiece", ids),
]
#: Order MinHash and the trained languages have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Each one's table, and what it wrote on the way, goes when the next one has read it."""
    docs = table(spark, sf_dir, "documents", "*")
    for k, (_, stage) in enumerate(STAGES):
        before, last = set(kept), docs
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            discard_paths(spark, [p for p in kept if p not in before and p != docs.written_to])
            discard(last)
    return docs
