"""Corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each
result as Parquet to the shared scratch folder and reads it as the next docs;
what a stage wrote on its way is deleted then, and so is its input.
A stage works on all rows its predecessor kept, and all but the last return
the columns of documents.

Defined cases: rows without doc_id are judged by quality and by decontamination, and kept by
near-duplicates, where rows that share a doc_id share the decision on it; an empty table gives an
empty one; further columns, whatever their names, go through to the last stage.  The mix judges rows:
it leaves out or repeats whole documents until a source's words meet its target,
so a doc_id stands in the output 0, 1 or 2 times for each of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulegrain.llm import decontam, minhash, mixing, quality, sharding
from rulegrain.llm.common import discard, keep, materialise, read_table, released


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The quality model and the near-duplicate classes can't be stated in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with released(spark):
            docs = keep(materialise(stage(spark, docs, sf_dir), f"stage-{name}"))
        if last:
            discard(spark, last)
        last = docs.scratch_path
    return STAGES[-1][1](spark, docs, sf_dir)
