"""Corpus pipeline: quality rules, near-duplicates, repeated passages, source
mix and packing.  Each stage works on all its predecessor kept, written as
Parquet; all but the last return the columns of ``documents``.

Texts go to Python ``ROWS_PER_BATCH`` rows at a time (a setting of the session),
which bounds what both sides hold of them.

A stage's intermediate tables are deleted when the next one begins: its result
has been written by then.  They stay if the next stage's input still reads
them.

Defined cases, over all stages: null texts, ids, languages and sources, empty
and very long texts, repeated rows, extra columns of any name and empty tables
go through; what becomes of them in a stage stands in its operator's module.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from wavelake.llm import mixing, packing, quality, queries, simhash, suffix_dedup
from wavelake.session import drop_scratch, recorded_scratch, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

ROWS_PER_BATCH = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_HELD: dict[str, list[str]] = {}   # tables of the last stage, by application


def _stage(fn: Stage) -> Stage:
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_BATCH)) <= ROWS_PER_BATCH:
            spark.conf.set(_BATCH, str(ROWS_PER_BATCH))
        held = _HELD.setdefault(spark.sparkContext.applicationId, [])
        if held:
            read = docs.inputFiles()
            # a table's folder has a name of its own, however its path is written
            for path in [p for p in held if not any(os.path.basename(p) in f for f in read)]:
                drop_scratch(spark, path)
                held.remove(path)
        with recorded_scratch() as made:
            out = fn(spark, docs, sf_dir)
        held += made
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break the base limits or lie far from their language
    and source go."""
    return quality.keep_quality(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.drop_near_duplicates(docs)


@_stage
def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 100-byte string that starts earlier are cut out."""
    return suffix_dedup.remove_repeats(docs)


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, as their source's target asks."""
    return mixing.apply_mix(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: one row per piece with its place
    and its ids."""
    return packing.pack_documents(docs, queries.tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("source_mix", source_mix),
    ("pack", pack),
]

# The later stages (SimHash components, spans, byte-level tokens) have no SQL
# form; the pipeline is tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each one's rows written to the
    shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
