"""A training corpus from raw documents: score, deduplicate, mix and pack.

Each stage takes what the one before wrote and works on all of it. A stage deletes the tables that the stages before it
left in the shared folder for their own use; their results must have been written by then, as ``run`` does.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from hearthway.llm import exact_dedup, minhash_dedup, mixing, packing, toxicity
from hearthway.llm.common import collecting, forget, release, settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_held: list[str] = []


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _held)
        with collecting(_held):
            return f(spark, docs, sf_dir)

    return run



@_stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_on(docs, labels, toxicity.severity())
    return toxicity.drop_toxic(docs, model)


@_stage
def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text: that with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


@_stage
def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each group linked by a similarity of 0.8 or more on five-word shingles."""
    return minhash_dedup.drop_near_copies(docs, threshold=80)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mix(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: its sequence of at most 1024 tokens and its place there."""
    return packing.pack(docs, packing.byte_bpe()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact),
    ("minhash near-dedup", drop_near),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: No SQL: a fitted model and a search decide; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each settled for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, settle(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        forget(last)
    return STAGES[-1][1](spark, docs, sf_dir)
